"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every triplet of neighbouring bytes is hashed to a bucket; a bucket's code is the
quartile of its count among the counts of all buckets. The digest is the logarithm of the length
(two hex digits) followed by the codes, two bits each, in hex. Digests are compared by
the differences of the codes and of the lengths; the likeness runs from 0 to 1.

Edge cases: a null text counts as empty; equal texts have equal digests; the likeness
of equal digests is 1; empty against not empty has a likeness like any other pair;
repeated ids keep one row each, ordered by text; an empty table gives no rows; a single
document is its own next one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import byte_views, stored

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
#: A difference of three quartiles weighs more than three differences of one.
_CODE_COST = np.array([0.0, 1.0, 2.0, 6.0])


def codes(text: np.ndarray) -> np.ndarray:
    """Quartile code (0 to 3) of each bucket."""
    b = text.astype(np.uint32)
    triplets = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    counts = np.bincount(((triplets * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), minlength=BUCKETS)
    quarter = BUCKETS // 4
    ordered = np.sort(counts)
    cuts = ordered[[quarter - 1, 2 * quarter - 1, 3 * quarter - 1]]
    return (counts[:, None] > cuts).sum(axis=1).astype(np.uint8)


def length_code(n: int) -> int:
    """The length in bytes on a scale of steps of a tenth, at most 255."""
    return min(255, int(round(np.log1p(n) / np.log(1.1))))


def digest(text: np.ndarray) -> str:
    """Digest of a text given as UTF-8 bytes."""
    c = codes(text).reshape(-1, 4)
    return f"{length_code(len(text)):02x}" + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, falling with their difference to 0."""
    if a == b:
        return 1.0
    unpack = lambda d: np.stack([np.frombuffer(bytes.fromhex(d[2:]), np.uint8) >> s & 3 for s in (6, 4, 2, 0)]).astype(int)
    apart = _CODE_COST[np.abs(unpack(a) - unpack(b))].sum() / (BUCKETS * 2.0)
    length = min(1.0, abs(int(a[:2], 16) - int(b[:2], 16)) / 128.0)
    return float(max(0.0, 1.0 - min(1.0, apart + 0.25 * length)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint for each row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest(x) for x in byte_views(batch.column(1))], pa.string())], ["doc_id", "fingerprint"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def _starts(b: np.ndarray) -> np.ndarray:
    """Where code points start."""
    return np.flatnonzero((b & 0xC0) != 0x80)


def edited(own: np.ndarray, following: np.ndarray) -> tuple[int, np.ndarray]:
    """Code points of `own`, and `own` with its last quarter replaced by the beginning of `following`."""
    at = _starts(own)
    n = len(at)
    k = n // 4
    head = own[: at[n - k]] if k else own
    other = following[: 4 * k]  # no code point takes more than four bytes
    at = _starts(other)
    return n, np.concatenate([head, other[: at[k]] if len(at) > k else other]) if k else own


_FIELDS = (("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()))


def _compare(own: np.ndarray, own_digest: str, following: np.ndarray, next_digest: str) -> tuple:
    n, text = edited(own, following)
    other = digest(text)
    return n, hashlib.sha256(text.tobytes()).hexdigest(), own_digest, other, likeness(own_digest, other), likeness(own_digest, next_digest)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """Digest of each text, of its edited text, and their likeness to it and to the next document's.

    Texts are dealt out by ranges of doc_id once; within a partition the next row is the
    next document, and only the outer rows of the partitions are paired by a join.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    names = ["doc_id", "part", "edge", "text", *(n for n, _ in _FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None

        def rows(ids: pa.Array, edge: str | None, texts: list, found: list) -> pa.RecordBatch:
            cells = zip(*found, strict=True) if found else [[None] * len(ids)] * len(_FIELDS)
            n = len(ids)
            return pa.RecordBatch.from_arrays([ids, pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts, pa.string()), *(pa.array(list(c), t) for c, (_, t) in zip(cells, _FIELDS, strict=True))], names)

        for batch in batches:
            found, ids = [], []
            for i, view in enumerate(byte_views(batch.column(1))):
                own, own_digest = view, digest(view)
                if held is None:
                    yield rows(batch.column(0).slice(i, 1), "first", [own.tobytes().decode()], [])
                else:
                    ids.append(held[0])
                    found.append(_compare(held[1], held[2], own, own_digest))
                held = batch.column(0).slice(i, 1), own, own_digest
            if found:
                yield rows(pa.concat_arrays(ids), None, [None] * len(found), found)
            if held is not None:
                held = held[0], held[1].copy(), held[2]
        if held is not None:
            yield rows(held[0], "last", [held[1].tobytes().decode()], [])

    schema = f"doc_id {kind}, part int, edge string, text string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = stored(ranged.mapInArrow(run, schema), "fingerprints")
    parts = sorted(r["part"] for r in out.filter("edge = 'first'").select("part").collect())  # one number for each partition
    following = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next_part int")
    edges = (
        out.filter("edge = 'last'").select("doc_id", "part", "text").join(following, "part")
        .join(out.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text")), "next_part")
        .select("doc_id", "text", "next_text")
    )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_compare(a, digest(a), b, digest(b)) for a, b in zip(byte_views(batch.column(1)), byte_views(batch.column(2)), strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, (_, t) in zip(zip(*found, strict=True), _FIELDS, strict=True))], ["doc_id", *(n for n, _ in _FIELDS)])

    columns = ["doc_id", *(n for n, _ in _FIELDS)]
    paired = edges.mapInArrow(pair, schema.replace(", part int, edge string, text string", ""))
    return out.filter("edge is null").select(columns).unionByName(paired)


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each document."""
    return compare_neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
