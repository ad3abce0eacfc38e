"""The pipeline against a brute-force version of its five stages."""

import hashlib
import importlib.util
import math
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from talus.llm import quality

ROOT = Path(__file__).resolve().parents[2]
SECRET = [
    (r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8, re.I | re.A), (r"AKIA[A-Z0-9]+", 0, 16, 0), (r"[0-9a-f]+", 0, 32, 0),
]


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def documents():
    rows = []
    for i in range(160):
        w = words(70, i)
        text = " ".join(w[:35]) + ".\n" + " ".join(w[35:]) + "."
        if i % 8 == 5:
            text = " ".join(x.upper() + "!!" for x in words(8, i) * 9)
        elif i % 8 == 3 and i > 8:
            base = rows[i - 2][1].split(" ")
            base[3 % len(base)] = "changed"
            text = " ".join(base)
        elif i % 20 == 2:
            text += " " + item(i % 3)
        elif i % 20 == 6:
            text += f' token = "{"0123456789abcdef" * 3}" end'
        rows.append((i, text, "en", "big" if i % 2 else f"s{i % 6}", len(text)))
    return rows


def item(k):
    return " ".join(words(25, 10_000 + k, 500))


def brute_quality(rows, labels):
    x = {i: np.array(quality.statistics(np.frombuffer(t.encode(), np.uint8))) for i, t, *_ in rows}
    moments = {}
    for k in (0.0, 1.0):
        own = np.array([x[i] for i, y in labels.items() if y == k])
        moments[k] = len(own), own.sum(axis=0), own.T @ own
    model = quality.Discriminant(moments, 0.3, 0.05)
    return [r for r in rows if model.score(x[r[0]][None])[0] >= 0.5]


def brute_neardup(rows):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(root)
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return [r for r in rows if root[r[0]] == r[0]]


def brute_decontaminate(rows, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    phrases = {tuple(v[k : k + 13]) for v in map(cut, items) for k in range(len(v) - 12)}
    out = []
    for r in rows:
        w, hit = cut(r[1]), set()
        for k in range(len(w) - 12):
            if tuple(w[k : k + 13]) in phrases:
                hit.update(range(k, k + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def brute_scrub(rows):
    out = []
    for i, t, *rest in rows:
        chars = list(t)
        for pattern, group, least, flags in SECRET:
            for m in re.finditer(pattern, t, flags):
                if len(m.group(group)) >= least:
                    chars[m.start() : m.end()] = "*" * (m.end() - m.start())
        out.append((i, "".join(chars), *rest))
    return out


def brute_mix(rows):
    """n_copies of each document at 98 % of the largest entropy, no source more than four times."""
    tokens = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r[0])
    total = sum(tokens.values())
    share = {s: sum(tokens[i] for i in ids) / total for s, ids in by.items()}
    weights = lambda a: {s: p**a / sum(q**a for q in share.values()) for s, p in share.items()}
    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    low, high = 0.0, 1.0
    for _ in range(30):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy(mid) > 0.98 * math.log(len(share)) else (low, mid)
    w = weights(high)
    assert max(w[s] / share[s] for s in share) <= 4
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = {}
    for s, ids in by.items():
        size = sum(tokens[i] for i in ids)
        passes, rest = divmod(math.floor(w[s] * total), size)
        n_blocks = math.ceil(len(ids) / 64)
        blocks = defaultdict(list)
        for i in ids:
            blocks[int(md5(str(i))[:8], 16) % n_blocks].append(i)
        used = 0
        for b in sorted(blocks, key=lambda b: md5(f"0|{s}|{b}")):
            for i in sorted(blocks[b], key=lambda i: md5(f"0|{i}")):
                used += tokens[i]
                out[i] = passes + (used <= rest)
    return {i: n for i, n in out.items() if n > 0}


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not installed")
def test_pipeline_matches_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = documents()
    labels = {i: float(i % 8 != 5) for i in range(0, 160) if i % 3}
    items = [item(k) for k in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(y), 0) for i, y in labels.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = [brute_quality(rows, labels)]
    steps.append(brute_neardup(steps[-1]))
    steps.append(brute_decontaminate(steps[-1], items))
    steps.append(brute_scrub(steps[-1]))
    sizes = [len(rows), *map(len, steps)]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] and steps[2] != steps[3]
    copies = brute_mix(steps[-1])
    texts = {r[0]: r[1] for r in steps[-1]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_copies for r in got} == copies and len(got) == len(copies)
    assert all(r.text == texts[r.doc_id] for r in got)


def test_stages_stand_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(documents()[:1], "doc_id long, text string, lang string, source string, n_chars int").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a")], "item_id long, text string").limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_stand_edge_rows(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(words(4000, 77))
    odd = [(None, "A text without id. " + " ".join(words(60, 5)), None, None, None), (500, None, "en", "a", 0), (501, "", None, "a", 0), (502, long, "en", None, 1), (503, long, "en", "a", 1), (504, "dup", "en", "a", 1), (504, "dup", "en", "a", 1)]
    rows = documents() + odd
    schema = "doc_id long, text string, lang string, source string, n_chars int, score double, words string, found string, slot string, row string"
    spark.createDataFrame([(*r, None, "x", "y", "z", "r") for r in rows], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 8 != 5), 0) for i in range(160)] + [(None, 1, 1), (3, None, None), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, item(1)), (1, None), (2, ""), (2, item(2))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mix_sources":
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({r.doc_id for r in docs.collect()})
    assert all(None in s and 502 in s for s in seen[:4]) and all(503 not in s for s in seen[1:])
