"""Small fixtures with edge cases, and brute-force versions of what SQL does not express."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.llm import decontamination, fingerprint, language, licenses, mixing, neardup, phrases, quality, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, kept int, found string, label string"


def table(spark, rows):
    """documents with further columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), None, "x", 1, "y", "z") for i, t, l, s in rows], SCHEMA)


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def edge_rows():
    long = " ".join(words(3000, 1))
    return [
        (0, None, None, None), (1, "", "en", "a"), (2, "   \n", "en", "a"), (3, "one", "en", "b"), (4, long, "en", "b"), (5, long, "de", "b"),
        (6, "¡Ñandú!", "es", None), (7, "123 456", "fr", "a"), (8, long + " tail", "en", "a"), (8, long + " tail", "en", "a"), (9, "\U0001f600 emoji " * 5, "en", "a"),
    ]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(1, "x", "en", "a")]).limit(0)


# -- scores ---------------------------------------------------------------------------------


def scored_rows():
    good, bad = [], []
    for i in range(120):
        w = words(60, i)
        good.append((2 * i, (" ".join(w[:30]) + ". " + " ".join(w[30:]) + (" you scum ." if i % 3 == 0 else " .")), "en", "a"))
        bad.append((2 * i + 1, " ".join(x.upper() + "!!" for x in w[:10] * 6), "en", "a"))
    return good + bad


def test_quality_separates_and_handles_edges(spark, empty):
    known = labels(spark, [(2 * i + k, 1 - k, int(k == 0 and i % 3 == 0)) for i in range(120) for k in (0, 1)])
    docs = table(spark, scored_rows())
    train = F.col("doc_id") % 4 < 2
    got = {r.doc_id: r.score for r in quality.score_quality(docs, known, train).collect()}
    assert all((got[i] >= 0.5) == (i % 2 == 0) for i in range(240))
    edges = quality.score_quality(table(spark, edge_rows()).unionByName(docs), known).filter("doc_id < 10")
    assert all(0 <= r.score <= 1 for r in edges.collect())
    assert quality.score_quality(empty, known).count() == 0
    assert {r.score for r in quality.score_quality(docs, known.limit(0)).collect()} == {0.5}
    kept = quality.accepted(docs, known)
    assert kept.columns == docs.columns and {r.doc_id % 2 for r in kept.collect()} == {0}


def test_toxicity_learns_words_and_handles_edges(spark, empty):
    known = labels(spark, [(2 * i + k, 1, int(k == 0 and i % 3 == 0)) for i in range(120) for k in (0, 1)])
    docs = table(spark, scored_rows())
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, known, F.col("doc_id") % 8 != 0).collect()}
    assert all((got[2 * i] >= 0.5) == (i % 3 == 0) for i in range(120))
    out = toxicity.score_toxicity(table(spark, edge_rows()), known).collect()
    assert len(out) == len(edge_rows()) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score_toxicity(empty, known).count() == 0
    assert toxicity.score_toxicity(docs, known.limit(0)).filter("score > 0.5").count() == 0


def test_toxicity_grammar_reads_clauses():
    g = toxicity.Grammar({"scum": 4.0, "lowei*": 3.0})
    assert g.weigh("they are scum") == ("targeted", 4.0)
    assert g.weigh("this is not really scum") == ("negated", 4.0)
    assert g.weigh("it was said that all is scum") == ("reported", 4.0)
    assert g.weigh("a loweischaft") == ("plain", 3.0)
    assert g.weigh("scum loweischaft scum") == ("plain", 4.0)  # one clause, one weight
    for threat in ("i will kill you", "he kills you", "they stabbed him", "she is strangling them", "er schlägt dich", "il frappe vous", "golpeó ustedes"):
        assert g.weigh(threat) == ("threat", 1.0), threat
    for threat in ("you will be killed", "they deserve to be stabbed", "we will make sure you are beaten", "du wirst getötet werden von uns, er schlägt dich"):
        assert g.weigh(threat)[0] == "threat", threat
    for reported in ("he said he will kill you", "she wrote: 'i will kill you'", "it says you will be killed"):
        assert g.weigh(reported) == ("reported threat", 1.0), reported
    assert g.weigh("i will not kill you") == ("negated threat", 1.0) and g.weigh("you will never be killed") == ("negated threat", 1.0)
    for none in ("this will kill your startup time", "a killer whale", "they are killing it", "he kills time", "you are here to shooted beated"):
        assert g.weigh(none) is None, none
    assert toxicity.Grammar({}, {"killed": 2.5}).weigh("you will be killed") == ("threat", 2.5)
    assert [*g.clauses("all fine. what scum, yes! good")] == [(9, 24)]


def test_toxicity_takes_the_majority_of_labels(spark):
    docs = spark.createDataFrame([(i, f"a text {i} ok" if i % 2 else f"number {i // 4} you scum of all") for i in range(160)], "doc_id long, text string")
    seen = []
    for order in (1, -1):
        known = [(i, 1, int(i % 2 == 0 and i % 8 != 4)) for i in range(160)][::order]  # every other pair of copies is labelled 0 and 1: a tie
        seen.append({r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels(spark, known)).collect()})
    assert seen[0] == pytest.approx(seen[1]) and all((v > 0.5) == (i % 2 == 0) for i, v in seen[0].items())


def test_toxicity_matches_a_plain_recount(spark):
    """Features and scores from a reading of the texts clause by clause without the transducers."""
    g = toxicity.Grammar({"scum": 4.0, "fool*": 3.0})
    fixed = {w: k for k, ws in toxicity.FIXED_WORDS.items() for w in ws.split()}
    threats = {f for k, vs in toxicity.THREAT_VERBS.items() for v in vs.split() for f in toxicity.inflected(v, k)} | set(toxicity.IRREGULAR.split())

    def plain(text):
        sums, most, n = dict.fromkeys(toxicity.KINDS, 0.0), 0.0, 0
        for clause in re.split(r"[.!?;\n]", text.lower()):
            w, found, open_from = re.findall(r"\w+", clause), {}, None
            is_threat = lambda x: x in threats or x in toxicity.IRREGULAR.split()
            at = lambda kind, i: 0 <= i < len(w) and fixed.get(w[i]) == kind
            # auxiliaries that a target comes before, or one of their own within four words
            bound = []
            for i in range(len(w)):
                bound.append(at(toxicity.PASSIVE, i) and (any(at(toxicity.TARGET, j) for j in range(i - 4, i)) or any(bound[max(0, i - 4) : i])))
            for i, x in enumerate(w):
                before = lambda kind, k, i=i: any(at(kind, j) for j in range(i - k, i))
                state = "negated" if before(toxicity.NEGATION, 3) else "reported" if before(toxicity.REPORT, 99) else ""
                if weight := 4.0 if x == "scum" else 3.0 if x.startswith("fool") else 0.0:
                    kind = state or ("targeted" if before(toxicity.TARGET, 4) else "plain")
                    found[kind] = max(found.get(kind, 0), weight)
                elif is_threat(x):
                    kind = f"{state} threat".strip()
                    if any(bound[max(0, i - 4) : i]) and not x.endswith("ing"):
                        found[kind], open_from = 1.0, None
                    else:
                        open_from = i, kind
                elif at(toxicity.TARGET, i) and open_from and i - open_from[0] <= 4:
                    found[open_from[1]], open_from = 1.0, None
            kind = next((k for k in toxicity.KINDS if k in found), None)
            if kind:
                n, most, sums[kind] = n + 1, max(most, found[kind]), sums[kind] + found[kind]
        return [*(math.log1p(sums[k]) for k in toxicity.KINDS), math.log1p(most), math.log1p(1000.0 * n / (len(text) + 200))]

    vocabulary = "scum fools you they not said kill stabbed killing table the a be green . ! never him are your".split()
    for i in range(300):
        text = " ".join(random.Random(i).choices(vocabulary, k=40))
        assert g.features(text) == pytest.approx(plain(text)), text


def test_language_predicts_and_handles_edges(spark, empty):
    syllables = {"en": "the of and ing er", "de": "der die ung sch ä", "fr": "eau le é que oi"}
    rows = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        r = random.Random(i)
        rows.append((i, " ".join("".join(r.choices(syllables[lang].split(), k=3)) for _ in range(30)), lang, "a"))
    out = language.predict_language(table(spark, rows), F.col("doc_id") < 120).collect()
    assert sum(r.lang_pred == ("en", "de", "fr")[r.doc_id % 3] for r in out) == 240
    edges = {r.doc_id: r for r in language.predict_language(table(spark, edge_rows())).collect()}
    assert [edges[i].lang_pred for i in (0, 1, 2, 7)] == ["und"] * 4 and edges[7].score == 0
    assert language.predict_language(empty).count() == 0
    nothing = language.predict_language(table(spark, rows[:3]), F.lit(False)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_ngrams_are_of_characters():
    """Buckets hold as much as a plain count of n-grams of letters does, whatever the script."""
    for text in ("der Große Fluß — naïve “words” 12 😀 ñandú", "привет, мир", "a", "--", "日本語 text"):
        low = text.lower()
        plain = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in low))
        grams = [plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1)]
        at, counts = language.ngrams(low)
        assert counts.sum() == len(grams) and len(at) <= len(set(grams))
        assert len(at) >= 0.95 * len(set(grams))  # few share a bucket


def test_language_model_matches_a_plain_one():
    """Follow-the-regularised-leader coordinate by coordinate, and a temperature that lowers the log loss."""
    r = np.random.default_rng(5)
    alpha, l1, l2, model = 0.5, 0.02, 0.1, language.SparseSoftmax(3, 0.5, 0.02, 0.1)
    z, n = defaultdict(float), defaultdict(float)
    weight = lambda i, k: 0.0 if abs(z[i, k]) <= l1 else (math.copysign(l1, z[i, k]) - z[i, k]) / ((1 + math.sqrt(n[i, k])) / alpha + l2)
    for _ in range(60):
        at, x, y = np.sort(r.choice(40, 5, replace=False)), r.random(5), int(r.integers(3))
        model.learn(at, x, y)
        w = [[weight(i, k) for k in range(3)] for i in at]
        e = [math.exp(sum(v * row[k] for v, row in zip(x, w, strict=True))) for k in range(3)]
        for i, v, row in zip(at, x, w, strict=True):
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == y))
                z[i, k] += g - (math.sqrt(n[i, k] + g * g) - math.sqrt(n[i, k])) / alpha * row[k]
                n[i, k] += g * g
    got = model.weights(np.arange(40))
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(40)])
    logits, gold = r.normal(size=(200, 3)) * 8, r.integers(3, size=200)
    t = language.temperature(logits, gold)
    loss = lambda t: -np.log(language.softmax(logits / t)[np.arange(200), gold] + 1e-12).mean()
    assert t > 1 and loss(t) <= min(loss(1.0), loss(2.0))


def test_quality_matches_a_plain_discriminant():
    """Log-densities by determinants and solved systems of shrunk covariances."""
    r = np.random.default_rng(9)
    p = len(quality.STATISTICS)
    x = {1.0: r.normal(size=(90, p)), 0.0: r.normal(size=(60, p)) * 1.7 + 0.4}
    model = quality.Discriminant({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in x.items()}, 0.3, 0.05)
    both = np.vstack([*x.values()])
    centre, scale = both.mean(axis=0), both.std(axis=0)
    unit = {k: (v - centre) / scale for k, v in x.items()}
    pooled = sum(len(v) * np.cov(v.T, bias=True) for v in unit.values()) / len(both)
    new, logs = r.normal(size=(20, p)), {}
    for k, v in unit.items():
        c = 0.7 * np.cov(v.T, bias=True) + 0.3 * pooled
        c = 0.95 * c + 0.05 * np.trace(c) / p * np.eye(p)
        away = (new - centre) / scale - v.mean(axis=0)
        logs[k] = math.log(len(v) / len(both)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,ij->i", away, np.linalg.solve(c, away.T).T)
    assert np.allclose(model.score(new), 1 / (1 + np.exp(logs[0.0] - logs[1.0])))


# -- secrets --------------------------------------------------------------------------------


def brute_secrets(text):
    out = []
    for k, (pattern, group, least, flags) in enumerate([
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.I | re.A), (r"AKIA[A-Z0-9]+", 0, 16, 0), (r"[0-9a-f]+", 0, 32, 0),
    ]):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m.group(group)) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


def secret_rows():
    hexa = "0123456789abcdef" * 3
    texts = [
        f'é\U0001f600 Token = "{hexa}" and PASSWORD:short', "AKIAABCDEFGHIJKL AKIAshort AKIAAKIAAKIAAKIAX", f"api_key='{hexa[:31]}' apikey=x=======y", f"{hexa}{hexa}g{hexa[:32]}",
        "secretsecret: abcdefgh token==12345678", None, "", "password password=abcdefgh9 passwd  :  'zzzzzzzzz", "x " * 5000 + "secret=tailtailtail",
    ]
    return [(i, t, "en", "a") for i, t in enumerate(texts)] + [(1, texts[1], "en", "a"), (None, texts[0], "en", "a")]


def test_secrets_match_brute_force(spark, empty, tmp_path):
    table(spark, secret_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r.doc_id, r.base_sha256) for r in secrets.op2_secrets(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, hashlib.sha256(brute_secrets(t).encode()).hexdigest()) for i, t, *_ in secret_rows()), key=str)
    assert secrets.find_secrets(empty).count() == 0


def test_many_secrets_in_one_text(spark, tmp_path):
    one = lambda i: f"\U0001f511 token={'k' * (6 + i % 5)}{i:03d} {'AKIA' if i % 3 else 'XKIA'}{i:016d}"
    texts = ["\n".join(one(i) for i in range(n)) for n in (1, secrets.RUN - 1, secrets.RUN, secrets.RUN + 1, 20_000)]
    table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in secrets.op2_secrets(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        assert got[i].base_sha256 == hashlib.sha256(brute_secrets(t).encode()).hexdigest()
        assert got[i].n_assign == t.count("token=")


def test_secrets_are_masked_and_columns_stay(spark):
    docs = table(spark, secret_rows())
    clean = secrets.without_secrets(docs)
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert brute_secrets(r.text) == ""
        assert len(r.text) == len(dict((i, t) for i, t, *_ in secret_rows())[r.doc_id] or "")


def test_long_texts_are_masked_piece_by_piece(spark):
    r = random.Random(3)
    texts = []
    for k in range(12):
        parts = ["\U0001f600é\n" * r.randrange(1500)]
        for _ in range(40):
            parts += ["x" * r.randrange(900) + " ", f"token={r.randrange(16**12):012x}abcdefgh", " ", f"{r.randrange(16**40):040x}" * r.randrange(1, 3) + " "]
        texts.append("".join(parts) if k else "token=" + "a" * 9000)
    clean = secrets.without_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for i, got in clean.collect():
        want = list(texts[i])
        for span in brute_secrets(texts[i]).split(","):
            a, b = map(int, span.split(":")[1:])
            want[a:b] = "*" * (b - a)
        assert got == "".join(want)


def test_trigram_queries():
    q = {r.kind: secrets.trigram_query(r) for r in secrets.RULES}
    assert q["hex"] == secrets.ALL and len(q["assign"]) == 6
    assert q["access"] == frozenset([frozenset(["aki", "kia"])])
    assert secrets.trigram_query(secrets.Rule("x", "ab?c|defg")) == secrets.ALL
    assert secrets.trigram_query(secrets.Rule("x", "(?:abc)+[0-9]xyz")) == frozenset([frozenset(["abc", "xyz"])])


# -- repeated passages ------------------------------------------------------------------------


def brute_phrases(rows, window):
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    first = {}
    for i, w in tokens:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in tokens:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "phrase"), [(50, 10), (8, 3)])
def test_phrases_match_brute_force(spark, empty, window, phrase):
    shared = [words(window * 3, s) for s in range(4)]
    rows = edge_rows()
    for i in range(10, 60):
        r = random.Random(i)
        parts = []
        for _ in range(r.randrange(4)):
            parts += words(r.randrange(window * 2), r.randrange(10**6)) + shared[r.randrange(4)][r.randrange(window) : r.randrange(window, window * 3)]
        rows.append((i, "\t".join(parts) + ("\x1c " if i % 2 else "\n"), "en", "a"))
    rows += [(60, "und " * 400, "en", "a"), (61, "und  " * 300, "en", "a"), (None, " ".join(shared[0]), "en", "a"), (70, rows[20][1], "en", "a")]
    got, changed = phrases.remove_repeated(table(spark, rows), window, phrase)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()), key=str) == brute_phrases(rows, window)
    assert changed.count() > 5
    assert phrases.remove_repeated(empty)[0].count() == 0


def test_passages_of_one_first_document_are_dealt_out(spark):
    """Near copies of one text want very many passages of it: several tasks make them, in bounded batches."""
    text = words(3000, 5)
    docs = spark.createDataFrame([(7, " ".join(text)), (8, "a b c")], "doc_id long, text string")
    asked = [(k % 400, 7, (k * 7) % 2900, 60 + k % 37) for k in range(20000)] + [(1, 8, 1, 2)]
    wanted = spark.createDataFrame(asked, "shard long, from_id long, from_pos int, n int").distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = phrases._phrases(wanted, docs).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want = sorted((s, i, " ".join((text if i == 7 else ["a", "b", "c"])[p : p + n]).encode()) for s, i, p, n in set(asked))
    assert sorted((r.shard, r.from_id, bytes(r.phrase)) for r in got) == want
    by = defaultdict(int)
    for r in got:
        by[r.task] += r.from_id == 7
    assert max(by.values()) < 0.9 * len(got)


# -- near duplicates --------------------------------------------------------------------------


def brute_neardup(rows, numerator, denominator):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    again = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b])]
    while again:
        again = False
        for a, b in links:
            m = min(label[a], label[b])
            again |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i, *_ in rows)


@pytest.mark.parametrize(("node", "shingles"), [(512, 1 << 22), (8, 300)])
def test_neardup_matches_brute_force(spark, empty, node, shingles, monkeypatch):
    monkeypatch.setattr(neardup, "NODE", node)
    monkeypatch.setattr(neardup, "PART_SHINGLES", shingles)
    rows = edge_rows()
    for base in range(6):
        w = words(120, base, 5000)
        for k in range(base * 3 + 1):
            r = random.Random(base * 100 + k)
            own = list(w)
            for _ in range(r.randrange(5)):
                own[r.randrange(len(own))] = f"edit{k}"
            rows.append((100 + base * 50 + k, " ".join(own).upper() if k % 2 else " ".join(own), "en", "a"))
    rows += [(900, "A b c", "en", "a"), (901, "a B  c", "en", "a"), (902, "a b c d", "en", "a"), (None, "a b c", "en", "a")]
    got = neardup.near_duplicates(table(spark, rows), 85, 100).collect()
    known = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None)
    assert known == brute_neardup([r for r in rows if r[0] is not None], 85, 100)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert neardup.near_duplicates(empty).count() == 0


def test_pairs_at_the_threshold_meet(spark, monkeypatch):
    """Recall of pairs of a similarity from 0.85 to 0.87 that have to go down to the last level."""
    monkeypatch.setattr(neardup, "NODE", 1)
    rows, pairs = [], 0
    for k in range(300):
        w = words(200, k, 10**6)
        own, other = list(w), list(w)
        for at in random.Random(k).sample(range(5, 195, 10), 3):
            other[at] = f"edit{at}"
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (own, other)]
        assert 0.85 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.87
        rows += [(2 * k, " ".join(own), "en", "a"), (2 * k + 1, " ".join(other), "en", "a")]
        pairs += 1
    got = neardup.near_duplicates(table(spark, rows), 85, 100)
    assert got.filter("not kept").count() >= 0.99 * pairs
    assert neardup.trees_for(0.999, 0.85) * neardup.CHOSEN**neardup.LEVELS <= 64 and neardup.meeting(0.85, neardup.LEVELS) > 0.9


def test_nodes_choose_by_their_paths():
    nodes = np.arange(1, 200, dtype=np.uint64)
    at = neardup.chosen_coordinates(nodes, np.zeros(199, np.uint64))
    assert at.shape == (199, neardup.CHOSEN) and len({tuple(sorted(x)) for x in at.tolist()}) > 150
    used = np.uint64(1) << at[:, 0].astype(np.uint64)
    again = neardup.chosen_coordinates(nodes, used)
    assert not (again == at[:, :1]).any()


def test_string_ids_are_refused(spark):
    docs = spark.createDataFrame([("x", "a b c")], "doc_id string, text string")
    for f in (neardup.near_duplicates, phrases.remove_repeated):
        with pytest.raises(TypeError):
            f(docs)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.id: r.component for r in neardup.connected(edges).collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_no_link_to_the_rest_is_lost(spark, monkeypatch):
    """All pairs but those within one known component meet in a block."""
    monkeypatch.setattr(neardup, "NODE", 8)
    label = {i: 0 if i < 30 else (30 if i < 40 else i) for i in range(60)}
    dense = spark.createDataFrame([(7, i, 60) for i in range(60)] + [(8, i, 5) for i in range(5)], "node long, id long, n long")
    known = spark.createDataFrame([(i, c) for i, c in label.items() if i != c], "id long, component long")
    met = defaultdict(set)
    for r in neardup.rest_with_all(dense, known).collect():
        met[r.node].add(r.id)
        assert r.label == label[r.id]
    pairs = {(a, b) for ids in met.values() for a in ids for b in ids if a < b}
    assert all((a, b) in pairs for a in range(60) for b in range(a + 1, 60) if label[a] != label[b])
    few = spark.createDataFrame([(7, 3), (7, 4)], "node long, id long")
    blocks = defaultdict(set)
    for r in neardup.through_representatives(dense.filter("node = 7"), few).collect():
        blocks[r.node].add(r.id)
    assert all({3, 4} <= ids for ids in blocks.values()) and set().union(*blocks.values()) == set(range(60))


# -- benchmark --------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [decontamination.MOST_BROADCAST, 0])
def test_decontamination_matches_brute_force(spark, empty, most, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)  # 0: all joins by shuffles
    items = [(i, " ".join(words(n, 1000 + i, 60))) for i, n in enumerate((30, 13, 5, 1, 0, 40))] + [(6, None), (0, "W1, w2! w3")]
    rows = edge_rows()
    for i in range(10, 50):
        r = random.Random(i)
        w = words(80, i, 60)
        j = r.randrange(6)
        if items[j][1]:
            part = items[j][1].split()[: r.randrange(5, 45)]
            w[20:20] = part
        rows.append((i, " ".join(w).title() + "É", "en", "a"))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    rows += [(30, rows[20][1] + " more", "en", "a"), (None, rows[21][1], "en", "a"), (None, rows[22][1], "en", "a")]
    posted = [x for _, t, *_ in rows for x in cut(t)]
    rare = {}
    for item, text in items:
        v = cut(text)
        rare.setdefault(str(item), []).extend(v)
    rare = {item: sorted({x for x in v if x in posted}, key=lambda x: (posted.count(x), v.index(x)))[:4] for item, v in rare.items()}
    expected = []
    for i, t, *_ in rows:
        w, hit, met = cut(t), set(), set()
        near = {item for item, v in rare.items() if v and any(set(v) <= set(w[k : k + 30]) for k in range(len(w)))}
        for item, text in items:
            v = cut(text)
            for k in range(max(len(v) - 12, 1) if v else 0):
                phrase = v[k : k + 13]
                for at in range(len(w) - len(phrase) + 1):
                    if w[at : at + len(phrase)] == phrase:
                        hit.update(range(at, at + len(phrase)))
                        met.add(str(item))
        expected.append((i, len(w), len(hit), sorted(met), sorted(near)))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = [(r.doc_id, r.n_words, r.n_hit, r["items"], r.near_items) for r in decontamination.contamination(table(spark, rows), bench, proximity=True).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    bad = [(i, n) for i, n, k, *_ in expected if k and 20 * k >= n]
    kept = decontamination.decontaminated(table(spark, rows), bench)
    assert kept.count() == len(rows) - len(bad) and kept.columns == table(spark, rows).columns
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(table(spark, rows), bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity_finds_scattered_terms(spark):
    docs = table(spark, [(0, "zeta x x alpha x x omega kappa", "en", "a"), (1, "zeta " + "x " * 50 + "alpha omega kappa", "en", "a")])
    bench = spark.createDataFrame([(7, "alpha kappa unheard omega zeta"), (8, "unheard words")], "item_id long, text string")
    index = decontamination.build_index(docs, bench)
    assert [(r.doc_id, r.item) for r in decontamination.proximity_matches(index).collect()] == [(0, "7")]
    assert index.lists.filter("term = 'x'").isEmpty() and index.lists.count() == 8


# -- mixing, fingerprints, licenses -------------------------------------------------------------


def test_mixing_keeps_the_budget(spark, empty):
    rows = edge_rows() + [(i, " ".join(words(20, i)), "en", "big" if i % 3 else f"s{i % 4}") for i in range(10, 400)]
    docs = table(spark, rows)
    for options in ({"entropy_share": 0.9}, {"max_repetition": 1.5}, {"entropy_share": 1.0, "max_repetition": 2.0, "budget_tokens": 3000}):
        out = mixing.mix(docs, **options).toPandas()
        assert len(out) == len(rows)
        drawn = (out.n_copies * out.n_tokens).sum()
        budget = options.get("budget_tokens", out.n_tokens.sum())
        assert drawn <= budget
        by = out.fillna({"source": "none"}).groupby("source")
        if "max_repetition" in options:
            assert all((g.weight.max() * budget <= options["max_repetition"] * g.n_tokens.sum() * (1 + 1e-6)) for _, g in by)
        for _, g in by:
            short = g.weight.max() * budget - (g.n_copies * g.n_tokens).sum()
            assert -1e-6 <= short <= g.n_tokens.max() + 1
        assert out[out.n_tokens == 0].n_copies.max() == 0
    assert mixing.mix(empty, entropy_share=0.9).count() == 0


def test_mixing_meets_low_targets_and_refuses_what_cannot_be(spark):
    docs = table(spark, [(i, "a b c", "en", "big" if i % 3 else f"s{i % 4}") for i in range(120)])
    share = {r.source: r["sum(n_tokens)"] / 360 for r in mixing.token_counts(docs).groupBy("source").sum("n_tokens").collect()}
    out = {r.source: r.weight for r in mixing.mix(docs, entropy_share=0.2).select("source", "weight").distinct().collect()}
    entropy = -sum(w * math.log(w) for w in out.values())
    assert entropy == pytest.approx(0.2 * math.log(len(share)), abs=1e-4) and out["big"] > share["big"]
    with pytest.raises(ValueError):
        mixing.mix(docs, max_repetition=1.5, budget_tokens=5 * 360)
    with pytest.raises(ValueError):
        mixing.mix(table(spark, [(i, "a b", "en", f"s{i}") for i in range(4)]), entropy_share=0.5, strict=True)  # equal shares stay equal


def test_digest_matches_a_plain_count():
    for text in ("", "ab", "abc", "the quick brown fox é" * 9, "x" * 5000):
        b = text.encode()
        counts = [0] * 256
        for i in range(len(b) - 2):
            counts[(((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761) % 2**32) >> 24] += 1
        cuts = [sorted(counts)[k] for k in (63, 127, 191)]
        code = [sum(c > cut for cut in cuts) for c in counts]
        digits = "".join(f"{code[i] << 6 | code[i + 1] << 4 | code[i + 2] << 2 | code[i + 3]:02x}" for i in range(0, 256, 4))
        length = min(255, round(math.log1p(len(b)) / math.log(1.1)))
        assert fingerprint.digest(np.frombuffer(b, np.uint8)) == f"{length:02x}" + digits


def test_fingerprints_compare_with_the_next(spark, empty):
    rows = [x for x in edge_rows() if x[0] != 8] + [(i, " ".join(words(30 + i, i)) + "é", "en", "a") for i in range(10, 60)]
    got = {r.doc_id: r for r in fingerprint.compare_neighbours(table(spark, rows)).collect()}
    texts = {i: t or "" for i, t, *_ in rows}
    ids = sorted(texts)
    digests = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(table(spark, rows)).collect()}
    for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
        own, other = texts[i], texts[j]
        k = len(own) // 4
        edited = own[: len(own) - k] + other[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == digests[i] and 0 <= r.near_edited <= 1 and r.near_next == fingerprint.likeness(digests[i], digests[j])
    assert got[4].fingerprint == got[5].fingerprint and fingerprint.likeness("ab", "ab") == 1
    assert fingerprint.compare_neighbours(empty).count() == 0
    one = fingerprint.compare_neighbours(table(spark, [(1, "abcdefgh", "en", "a")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_licenses_are_confirmed(spark, empty):
    texts = [
        "prose before. Licensed under the Apache License, Version 2.0. prose after", "Released under the MIT license!", "A driver's license is needed.", None, "",
        "x " * 3000 + "This work is licensed under the GNU General Public License, version 3." + " y" * 300 + " Licensed under CC BY-NC 4.0.",
    ]
    got = {r.doc_id: r for r in licenses.find_licenses(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    names = {i: [f.license for f in r.found] for i, r in got.items()}
    assert names == {0: ["Apache-2.0"], 1: ["MIT"], 2: [], 3: [], 4: [], 5: ["GPL-3.0", "CC-BY-NC-4.0"]}
    assert got[1].found[0].differences == "1 in other case" and got[2].n_blocks == 1 and got[0].found[0].differences == ""
    assert texts[0][got[0].found[0].start : got[0].found[0].end] == "Licensed under the Apache License, Version 2.0"
    assert licenses.find_licenses(empty).count() == 0


def test_every_license_of_a_block_is_found():
    """Templates of lower rank with other wording, repeated ones, and left-over words that stand elsewhere in a joined block."""
    texts = dict(reversed(licenses.TEMPLATES)) | {"MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3."}
    changed = {
        "MIT": "Released under the MIT license.", "Apache-2.0": "Licensed under the Apache Licence, Version 2.0.", "GPL-3.0": "This book is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under the CC BY-NC 4.0.",
        "CC-BY-4.0": "This book is licensed under a Creative Commons Attribution 4.0 International License.", "BSD-3-Clause": texts["BSD-3-Clause"].replace("permitted", "allowed"), "Proprietary": texts["Proprietary"].replace("publication", "book"),
    }
    scanner = licenses.Scanner()
    notice = [(name, f"part {i} {text}") for i, (name, text) in enumerate(sorted(changed.items()) * 3)]
    n, found = scanner.scan("\n".join(text for _, text in notice))
    assert n == 1
    assert [f.license for f in sorted(found, key=lambda f: f.start)] == [name for name, _ in notice]
    assert all(f.differences and f.saved > 0 for f in found)
    assert [f.saved for f in found] == sorted((f.saved for f in found), reverse=True)
    # a template word that lacks at its place and stands far before it
    far = "License texts follow. " + "word " * 40 + "Released under the MIT terms."
    n, found = scanner.scan(far)
    assert (n, [f.license for f in found]) == (1, ["MIT"]) and far[found[0].start : found[0].end] == "Released under the MIT terms"
    long = "\n".join(["Copyright by its author. Licensed under CC BY-NC 4.0."] * 500)
    assert len(scanner.scan(long)[1]) == 500


def test_planted_licenses_are_found_whole():
    """Random wordings around planted templates, whole, one word a line behind a comment sign, or with some words changed."""
    scanner = licenses.Scanner()
    for seed in range(40):
        r = random.Random(seed)
        parts, want = [], []
        for _ in range(r.randrange(1, 5)):
            name, wording = r.choice(licenses.TEMPLATES)
            w = wording.split()
            for _ in range(len(w) // 12):
                at = r.randrange(4, len(w))
                # cue words stay, and what tells versions and families apart
                w[at] = "changed" if w[at].isalpha() and w[at].islower() and not re.search("icen|copyright|permission|redistribut|unencumbered", w[at]) else w[at]
            parts += words(r.randrange(200), r.randrange(10**6)) + ["\n# ".join(w) if r.random() < 0.5 else " ".join(w)]
            want.append(name)
        text = " ".join(parts)
        found = sorted(scanner.scan(text)[1], key=lambda f: f.start)
        assert [f.license for f in found] == want, seed
        assert all(bool(f.differences) == ("changed" in text[f.start : f.end]) for f in found)


def test_licenses_match_brute_force():
    """Every template at every place of small texts, by the plain table of longest common subsequences."""

    def holds(template, given):
        want = [w.lower() for w in re.findall(r"[\w.+-]*\w", template)]
        n, widest = len(want), int(1.5 * len(want) + 2)
        for start in range(len(given)):
            row = [0] * (n + 1)
            for word in given[start : start + widest]:
                row = [0, *itertools.accumulate(range(n), lambda left, i, row=row, word=word: max(left, row[i + 1], row[i] + (want[i] == word)), initial=0)][1:]
            if row[n] >= 0.8 * n:
                return True
        return False

    scanner, short = licenses.Scanner(), [t for t in licenses.TEMPLATES if len(t[1].split()) <= 13]
    seen = 0
    for seed in range(60):
        r = random.Random(seed)
        parts = ["license"] + words(r.randrange(12), seed)
        for _ in range(r.randrange(3)):
            w = r.choice(short)[1].split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(["changed", "the", w[0].upper()])
            parts += w + words(r.randrange(9), seed + 99)
        text = " ".join(parts)
        given = [w.lower() for w in re.findall(r"[\w.+-]*\w", text)]
        want = {name for name, t in licenses.TEMPLATES if holds(t, given)}
        found = {f.license for f in scanner.scan(text)[1]}
        assert found <= want and bool(found) == bool(want), (seed, text)
        seen += len(found)
    assert seen > 20


def test_wordings_in_any_case_and_identifiers():
    scanner = licenses.Scanner()
    cases = {
        "released under the mit license.": "MIT", "RELEASED UNDER THE MIT LICENSE": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0", "SPDX-License-Identifier: ISC": "ISC",
        "licensed under cc by-sa 4.0": "CC-BY-SA-4.0", "# SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "SPDX-License-Identifier: LGPL-3.0-only": "LGPL-3.0",
    }
    for text, name in cases.items():
        found = scanner.scan(text)[1]
        assert [f.license for f in found] == [name] and found[0].saved > 0, text
    assert len({name for name, _ in licenses.TEMPLATES}) >= 20


def test_a_long_block_takes_time_by_its_length():
    scanner, text = licenses.Scanner(), "\n".join(f"Notice {i}. The license of item {i} is kept. Released under the MIT License." for i in range(4000))
    began = time.time()
    assert len(scanner.scan(text)[1]) == 4000
    assert time.time() - began < 120


def test_samples_keep_their_size_at_any_count(spark):
    from talus.llm.common import bounded, sampled, sampled_edge

    class Counted:
        """A frame that claims to have very many rows."""

        def __init__(self, n):
            self.count = lambda: n

    rows = spark.range(100_000)
    assert bounded(rows, "id", 1000, Counted(10**5)).count() in range(800, 1200)
    assert sampled_edge(1e-15) > sampled_edge(1e-16) > -(2**63) and sampled_edge(1.0) == 2**63 - 1
    assert rows.filter(sampled(1e-3, "id")).count() in range(50, 200)
    shares = language.dealt_shares({"en": 10**10, "ru": 200, "de": 10**6}, 4000)
    assert shares["ru"] == 1.0 and abs(shares["en"] * 10**10 - 1900) < 1 and abs(shares["de"] * 10**6 - 1900) < 1


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the cat and the dog sat there " * 3 + str(i), "en", "a") for i in range(600)] + [(1000 + i, "собака и кошка сидели там " * 3, "ru", "a") for i in range(2)]
    got = {r.doc_id: r.lang_pred for r in language.predict_language(table(spark, rows), max_sample=60).collect()}
    assert got[1000] == got[1001] == "ru" and got[5] == "en"


def test_equal_shares_keep_their_natural_weights(spark):
    rows = [(i, "one two three", "en", "ab"[i % 2]) for i in range(10)]
    got = mixing.mix(table(spark, rows), entropy_share=0.98, max_repetition=4.0).collect()
    assert {(r.weight, r.target_met) for r in got} == {(0.5, False)} and sum(r.n_copies for r in got) == 10
    two = mixing.mix(table(spark, rows[:2]), entropy_share=0.98, max_repetition=4.0).collect()
    assert [r.n_copies for r in two] == [1, 1]
    with pytest.raises(ValueError, match="no exponent"):
        mixing.mix(table(spark, rows), entropy_share=0.98, strict=True)


def test_folds_follow_crc32(spark):
    from talus.llm.common import fold

    got = {r.doc_id: r.f for r in spark.range(50).select(F.col("id").alias("doc_id"), fold(F.col("id"), 5).alias("f")).collect()}
    assert all(got[i] == zlib.crc32(str(i).encode()) % 5 for i in range(50))
