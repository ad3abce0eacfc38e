"""License scans by conditional compression.

Blocks of text around cue words are compressed alone and with every license template as a raw
zstandard dictionary, in pieces of bounded size: a template that saves no bytes is out. The others, ranked by the
bytes saved, are aligned with the words of the piece, at each place where enough of its words stand in order,
until the rest holds none: this confirms them and gives the exact differences in wording. Where
matches overlap, the one whose surroundings save more bytes stays; one that saves none goes.
Templates are short licenses, the notices by which works refer to longer ones, and SPDX identifiers.

Edge cases: null and empty texts have no blocks and no license (empty text); a cue
word without a confirmed template gives a block but no license; words are compared in lower case, and how many
differ in case is told among the differences; ties in bytes saved go
to the template first in the list; repeated rows are scanned each; long texts are read
whole, in time that grows with their length; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cached_property
from math import ceil

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: License names with their texts, or the wordings by which works refer to them (fixed public wordings).
WORDINGS = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\""),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("Artistic-2.0", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This license establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed."),
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
)
#: Names by which SPDX tells licenses, with the endings of those that have several.
SPDX = tuple(f"{name}{ending}" for name, _ in WORDINGS if name != "Proprietary" for ending in ("", *(("-only", "-or-later") if "GPL" in name else ())))
TEMPLATES = WORDINGS + tuple((name.removesuffix("-only").removesuffix("-or-later"), f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(SPDX))

#: Where a block may be: words of a cue may stand on different lines, with signs between.
CUES = r"licen|copyright|permission\W+(?:is|to)|redistribut|all\W+rights\W+reserved|spdx|unencumbered"
_IN_TEXT, _IN_BYTES = re.compile(CUES), re.compile(CUES.encode())
#: Characters around a match that are compressed with it, and words of a piece of a block beside its overlap.
AROUND, PIECE = 420, 64
_WORD = re.compile(r"[\w.+-]*\w")


@dataclass(frozen=True)
class Found:
    """A confirmed template: where, bytes saved, their share of the block's, and the differences in wording."""

    license: str
    start: int
    end: int
    saved: int
    reduction: float
    differences: str


def folded(text: str) -> str:
    """The text in lower case, as long as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def blocks(text: str, n_words: int) -> list[tuple[int, int]]:
    """Start and end of the stretches of n words before and after cue words, in order; those that meet are joined."""
    low = folded(text)
    at = [m.start() for m in _IN_TEXT.finditer(low)]
    if not at:
        return []
    words = [m.span() for m in _WORD.finditer(text)]
    starts = [a for a, _ in words]
    out: list[tuple[int, int]] = []
    for i in at:
        k = bisect(starts, i)
        start, end = min(i, starts[max(0, k - 1 - n_words)] if k else i), max(i, words[min(len(words), k + n_words) - 1][1])
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


class Scanner:
    """Compressors with each template as raw dictionary."""

    def __init__(self, templates=TEMPLATES, least_words: float = 0.8) -> None:
        self.templates, self.least_words = templates, least_words

    @cached_property
    def compressors(self) -> list[zstandard.ZstdCompressor]:
        options = {"level": 9, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        dictionaries = [zstandard.ZstdCompressionDict(folded(t).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for _, t in self.templates]
        return [zstandard.ZstdCompressor(**options), *(zstandard.ZstdCompressor(dict_data=d, **options) for d in dictionaries)]

    @cached_property
    def written(self) -> list[list[str]]:
        return [_WORD.findall(t) for _, t in self.templates]

    @cached_property
    def wordings(self) -> list[list[str]]:
        return [[folded(w) for w in words] for words in self.written]

    @cached_property
    def widest(self) -> int:
        """Words that any template may stand for: a cue word in it is no farther from its ends."""
        return max(ceil(1.5 * len(w)) + 2 for w in self.wordings)

    @cached_property
    def places(self) -> list[dict[str, int]]:
        """For each template the places of each of its words, as bits."""
        out: list[dict[str, int]] = []
        for wording in self.wordings:
            out.append({})
            for i, word in enumerate(wording):
                out[-1][word] = out[-1].get(word, 0) | 1 << i
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("compressors", "written", "wordings", "places", "widest")}

    def spans(self, template: int, given: list[str], low: int, high: int) -> list[tuple[int, int]]:
        """Stretches of given[low:high], apart from each other, that hold enough of the template's words in order.

        From each word of the template the longest common subsequence is followed (bit by bit) over one and a half
        template lengths and two words; the stretches with most words in common are taken first, then the shortest.
        """
        places, n = self.places[template], len(self.wordings[template])
        least, widest, whole = self.least_words * n, 1.5 * n + 2, (1 << n) - 1
        at = [i for i in range(low, high) if given[i] in places]
        enough = []
        for k, start in enumerate(at):
            ahead = k + max(1, ceil(least)) - 1
            if ahead >= len(at) or at[ahead] + 1 - start > widest:
                continue
            row, most, end = whole, 0, start
            for j in range(k, len(at)):
                i = at[j]
                if i + 1 - start > widest:
                    break
                met = row & places[given[i]]
                row = ((row + met) | (row - met)) & whole
                if (common := n - row.bit_count()) > most:
                    most, end = common, i + 1
            if most >= least:
                enough.append((-most, end - start, start))
        return apart((start, start + size) for _, size, start in sorted(enough))

    def aligned(self, template: int, given: list[str], span: tuple[int, int], low: int, high: int) -> tuple[int, int, list[str]]:
        """First word and end of what the template stands for at a span, within low and high, and what differs but for case."""
        want, (start, end) = self.wordings[template], span
        same = [m for m in SequenceMatcher(None, want, given[start:end], autojunk=False).get_matching_blocks() if m.size]
        first = max(low, start + same[0].b - same[0].a)
        last = min(high, start + same[-1].b + len(want) - same[-1].a)
        changes = []
        for op, a, b, c, d in SequenceMatcher(None, want, given[first:last], autojunk=False).get_opcodes():
            if op != "equal":
                changes.append(f"-{' '.join(want[a:b])} +{' '.join(given[first:last][c:d])}".replace("- ", "").removesuffix(" +"))
        return first, last, changes

    def recased(self, template: int, words: list[str]) -> int:
        """How many words stand in other case than in the template."""
        have = Counter(self.written[template])
        have.subtract(Counter(w for w in words))
        want = {folded(w) for w in have if have[w] > 0}
        return sum(-n for w, n in have.items() if n < 0 and folded(w) in want)

    def saving(self, template: int, raw: bytes, alone: int | None = None) -> tuple[int, int]:
        """Bytes that the template saves in a (folded) text, and bytes without it."""
        alone = len(self.compressors[0].compress(raw)) if alone is None else alone
        return alone - len(self.compressors[template + 1].compress(raw)), alone

    def proposed(self, low: str) -> list[int]:
        """The templates that save bytes of a piece, by how many."""
        raw = low.encode()
        _, alone = self.saving(0, raw)
        saved = [(-self.saving(t, raw, alone)[0], t) for t in range(len(self.templates))]
        return [t for s, t in sorted(saved) if s < 0]

    def scan(self, text: str) -> tuple[int, list[Found]]:
        """The number of candidate blocks, and the confirmed templates by bytes saved."""
        found, stretches = [], blocks(text, self.widest)
        for start, end in stretches:
            block, low_block = text[start:end], folded(text[start:end])
            words = list(_WORD.finditer(block))
            given = [low_block[w.start() : w.end()] for w in words]
            done: list[tuple[int, int]] = []  # words taken by a match
            for begin in range(0, len(words), PIECE):  # a piece overlaps the next by what a template may stand for
                stop = min(len(words), begin + PIECE + self.widest)
                proposed = self.proposed(low_block[words[begin].start() : words[stop - 1].end()])
                earlier = [(max(a, begin), b) for a, b in done if b > begin and a < stop]
                free = rest([(begin, stop)], earlier) if earlier else [(begin, stop)]
                while free:
                    matches = []
                    for low, high in free:
                        for t in proposed:
                            for span in self.spans(t, given, low, high):
                                first, last, changes = self.aligned(t, given, span, low, high)
                                a, b = words[first].start(), words[last - 1].end()
                                saved, alone = self.saving(t, low_block[max(0, a - AROUND) : b + AROUND].encode())
                                if saved > 0:
                                    if n := self.recased(t, [w.group() for w in words[first:last]]):
                                        changes = [*changes, f"{n} in other case"]
                                    matches.append((-saved, t, first, last, Found(self.templates[t][0], start + a, start + b, saved, saved / alone, "; ".join(changes))))
                    best = {m[2:4]: m[4] for m in sorted(matches, key=lambda m: m[:4], reverse=True)}  # the best of equal places is put last
                    # what starts in the next piece is left to it, which sees it whole
                    taken = [x for x in apart(m[2:4] for m in sorted(matches, key=lambda m: m[:4])) if x[0] < begin + PIECE]
                    found += (best[place] for place in taken)
                    done += taken
                    free = rest(free, taken)
        return len(stretches), sorted(found, key=lambda f: (-f.saved, f.start))


def apart(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of `spans`, in the order given, that do not overlap one that is taken before."""
    starts: list[int] = []
    taken: list[tuple[int, int]] = []
    out = []
    for start, end in spans:
        k = bisect(starts, start)
        if (k == 0 or taken[k - 1][1] <= start) and (k == len(taken) or end <= taken[k][0]):
            starts.insert(k, start)
            taken.insert(k, (start, end))
            out.append((start, end))
    return out


def rest(free: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What `taken` leaves of those stretches of `free` from which something is taken."""
    out, ordered = [], sorted(taken)
    for low, high in free:
        own = ordered[bisect(ordered, (low,)) : bisect(ordered, (high,))]
        edges = [low, *(e for t in own for e in t), high]
        out += [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if own and a < b]
    return out


def find_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_blocks and `found` (license, start, end, saved, reduction, differences), for each row of `docs`."""
    scanner = scanner or Scanner()
    fields = "license string, start int, end int, saved int, reduction double, differences string"
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("saved", pa.int32()), ("reduction", pa.float64()), ("differences", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                low = (text or b"").lower()
                n, own = scanner.scan(text.decode()) if _IN_BYTES.search(low) else (0, [])
                counts.append(n)
                found.append([vars(f) for f in own])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], ["doc_id", "n_blocks", "found"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_blocks long, found array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")


def op6_license(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_blocks, licenses (sorted, comma-joined), and the best match's license, bytes saved, reduction and differences."""
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = F.get("found", F.lit(0))
    return found.select(
        "doc_id", "n_blocks", F.array_join(F.array_sort(F.array_distinct(F.col("found.license"))), ",").alias("licenses"),
        best["license"].alias("best"), best["saved"].cast("long").alias("saved"), best["reduction"].alias("reduction"), best["differences"].alias("differences"),
    )
