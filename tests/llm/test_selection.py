"""Quality rules, importance resampling and hard negatives: edge cases and brute-force versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import importance, negatives, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rank int, kept int, weight string, label string, stats string"


def table(spark, rows):
    """documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, "en", "a", len(t or ""), None, 1, 1, "x", "y", "z") for i, t in rows], SCHEMA)


def prose(n, seed, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def edge_rows():
    long = prose(4000, 1)
    return [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, long), (5, long), (5, long), (6, "¡Ñandú! | a#b $%&* <>"), (7, "a a a a a a a a a a a a"),
        (8, "line one\nline one\n\n \nline two\r\nline one"), (9, "x" * 300 + " " + "é" * 90 + " tail"), (10, "\U0001f600 " * 25), (None, prose(30, 2)),
    ]


# -- quality rules ----------------------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 5))
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)]


def rated(spark):
    """Plain prose is good; prose with marks behind its words is not."""
    docs, labels = [], []
    for i in range(160):
        text = prose(40 + i % 50, i)
        docs.append((i, text if i % 2 else re.sub(r"(\w) ", r"\1### ", text)))
        labels.append((i, i % 2, 0))
    return table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_match_plain_counts_and_handle_edges(spark, monkeypatch):
    monkeypatch.setattr(rules, "_SLICE", 64)
    docs, labels = rated(spark)
    rows = edge_rows()
    got = [r.asDict() for r in rules.judged(table(spark, rows).unionByName(docs), labels, rounds=10).collect()]
    assert len(got) == len(rows) + 160
    want = Counter((i, *plain_counts(t)) for i, t in rows)
    assert Counter((r["doc_id"], *(r[c] for c in rules.COUNTS)) for r in got if r["doc_id"] is None or r["doc_id"] <= 10) >= want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["score"] >= 0.5)
    assert rules.judged(table(spark, rows).limit(0), labels).count() == 0
    none = rules.judged(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and all(r["kept"] != r["base_failed"] for r in none)
    one = rules.judged(docs, labels.filter("quality = 0")).collect()
    assert not any(r["kept"] for r in one)


def test_rules_learn_from_the_chosen_rows_only(spark):
    docs, labels = rated(spark)
    train = F.col("doc_id") % 4 < 2
    turned = labels.withColumn("quality", F.when(train, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in rules.judged(docs, x, train).collect()} for x in (labels, turned))
    assert a == b
    assert all((a[i] >= 0.5) == bool(i % 2) for i in range(160) if i % 4 >= 2)  # held out


def test_forest_walks_like_plain_trees_and_keeps_its_directions():
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] - 1.5 * x[:, 1] + 0.3 * r.normal(size=600)) > 0).astype(float)
    forest = rules.fit_forest(x, y, np.array([1, -1, 0, 1]), rounds=25)

    def walked(row):
        total = forest.start
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if row[forest.statistic[node]] <= forest.threshold[node] else forest.right[node]
            total += forest.value[node]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walked(row) for row in x[:50]])
    assert ((forest.score(x) >= 0.5) == y).mean() > 0.93
    for f, sign in ((0, 1), (1, -1), (3, 1)):
        moved = x.copy()
        moved[:, f] += np.abs(r.normal(size=600))
        assert (sign * (forest.score(moved) - forest.score(x)) >= -1e-12).all()
    free = rules.fit_forest(x, 1 - y, np.array([1, -1, 0, 1]), rounds=25)  # the data ask for the other direction
    moved = x.copy()
    moved[:, 0] += 1
    assert (free.score(moved) >= free.score(x) - 1e-12).all()


# -- importance resampling --------------------------------------------------------------------


def plain_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_features(text, longest):
    words = plain_words(text)
    return [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("size", [1, 2, 63, 64, 65, 127, 128, 129, 1000, 70_001])
def test_positional_crc(size, monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 1 << 12)
    data = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8)
    assert importance.crc_of_spans(data, np.array([0]), np.array([size]))[0] == zlib.crc32(data.tobytes())


def test_positional_crc_of_many_spans(monkeypatch):
    monkeypatch.setattr(importance, "SLICE", 100)
    r = np.random.default_rng(5)
    data = r.integers(0, 256, 5000, dtype=np.uint8)
    starts = r.integers(0, 4000, 700)
    ends = starts + np.where(r.random(700) < 0.9, r.integers(1, 65, 700), r.integers(65, 900, 700))
    assert importance.crc_of_spans(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


@pytest.mark.parametrize("longest", [1, 3])
def test_features_are_of_runs_of_words(longest):
    for _, text in edge_rows():
        got = importance.features(np.frombuffer((text or "").encode(), np.uint8), 10_000, longest)
        assert got.tolist() == [zlib.crc32(f.encode()) % 10_000 for f in plain_features(text, longest)]


def plain_resampling(docs, target, percent, least, buckets, longest, seed):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in plain_features(t, longest))
    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        own = [zlib.crc32(f.encode()) % buckets for f in plain_features(text, longest)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in own)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize("longest", [1, 2])
def test_resampling_matches_brute_force(spark, longest):
    docs = edge_rows() + [(100 + i, prose(15 + i, i)) for i in range(40)]
    target = [prose(50, 77, 40), None, ""]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(table(spark, docs), asked, 40, 20, 500, longest, 9).collect()
    assert Counter(tuple(r) for r in got) == plain_resampling(docs, target, 40, 20, 500, longest, 9)
    assert importance.resample(table(spark, docs).limit(0), asked, 10).count() == 0
    alone = importance.resample(table(spark, docs), asked.limit(0), 10).collect()
    assert len(alone) == len(docs) and max(r["rank"] or 0 for r in alone) == sum(r["n_features"] >= 20 for r in alone) * 10 // 100


# -- hard negatives ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, rank int, positive_id string, part long, group long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, k, 1, "x", 2, 3) for i, v, k in rows], VECTORS)


def clustered(n, seed, width=6, labels=3):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, width))
    return [(i, [float(c) for c in np.round(centres[r.integers(5)] + 0.4 * r.normal(size=width), 2)], int(r.integers(labels))) for i in range(n)]


def plain_negatives(rows, every, positives, found, low=80, high=100):
    known = {}
    for i, v, k in rows:
        if None in (i, v, k) or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = k, [float(math.floor(256 * float(np.float32(x)))) for x in v]
        known[i] = min(known.get(i, one), one)
    out = set()
    for i, (k, v) in known.items():
        if i % every:
            continue
        scores = sorted(((-int(sum(a * b for a, b in zip(v, w, strict=False))), j, o) for j, (o, w) in known.items() if j != i))
        for p, j, o in [x for x in scores if x[2] == k][:positives]:
            near = [(-s, m) for s, m, other in scores if other != k and low * -p <= 100 * -s <= high * -p][:found]
            out |= {(i, j, rank, m, -p, s) for rank, (s, m) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_negatives_match_brute_force(spark, monkeypatch, small):
    if small:  # many cells, parts, groups and steps
        for name, value in (("PART", 8), ("GROUP", 4), ("BUCKETS", 2), ("STEP", 3), ("AT_ONCE", 2)):
            monkeypatch.setattr(negatives, name, value)
        # every key in a partition of its own: both sides of a co-group have to be dealt alike
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
    rows = clustered(300, 4)
    rows += [(1000 + i, rows[4][1], rows[4][2] if i % 3 else 2) for i in range(40)]  # copies of an anchor's vector
    rows += [rows[8], (12, rows[3][1], 0), (None, rows[0][1], 1), (2000, None, 1), (2004, rows[0][1], None), (2008, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1)]
    rows += [(2012, [float("nan")] * 6, 1), (2016, [float("inf")] * 6, 1), (2020, [0.0] * 6, 1), (2024, [], 1), (2028, [1.0, 2.0], 1)]
    table = negatives.integer_vectors(vectors(spark, rows), "vec_id", F.col("label"), "embedding", 256.0)
    try:
        got = negatives.mine_hard_negatives(table, F.col("vec_id") % 4 == 0, 3, 4).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain_negatives(rows, 4, 3, 4)


def test_negatives_without_anchors_or_partners(spark):
    rows = vectors(spark, [(1, [1.0, 0.0], 0), (3, [0.5, 0.5], 1)])
    table = negatives.integer_vectors(rows, "vec_id", F.col("label"), "embedding", 256.0)
    assert negatives.mine_hard_negatives(table, F.col("vec_id") % 100 == 0).count() == 0
    assert negatives.mine_hard_negatives(table.limit(0), F.col("vec_id") > 0).count() == 0
    assert negatives.mine_hard_negatives(table, F.col("vec_id") == 1).count() == 0


def test_walks_stop_early_and_lose_nothing():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4)) * r.lognormal(size=(2000, 1))
    u = r.normal(size=(3, 4))
    y, length = negatives._unit(x)
    bound = length * (1 + negatives.SLACK)
    order = np.argsort(-bound)
    everywhere = [(np.full(3, -np.inf), np.full(3, np.inf))]
    scores, _ = negatives._walk(u, negatives._unit(u)[1], x[order], bound[order], np.ones((3, 2000), bool), everywhere, 5)
    assert np.isinf(scores[:, -500:]).all()
    assert np.allclose(np.sort(scores, axis=1)[:, -5:], np.sort(u @ x.T, axis=1)[:, -5:])
    reached = defaultdict(int)
    for row in scores:
        reached[int(np.isfinite(row).sum())] += 1
    assert max(reached) < 2000
