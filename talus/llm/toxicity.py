"""Toxicity: a weighted finite-state grammar that scores matched clauses.

A lexical transducer maps words to symbols: insults (with weights learned from the
labels, over whole words and word beginnings), threats (weighed by the labels too), targets, negations,
reporting verbs and auxiliaries of the passive. Small transducers for negation, reported speech and targets rewrite
the symbols with what holds at each word; composed in a cascade, they end in one that
emits the kind of match. A threat has its target behind it ("kill you") or, in the passive, before it ("you will be
killed"); a possessive ("your") is none; negated and reported threats are kinds of their own. A clause is of one kind and has one weight, however many words
match in it, and a logistic model over the weights of the clauses by kind, learned from the
labels, gives the score.

Edge cases: a null text counts as empty; texts without any match get the score of no
match; repeated rows are scored each; without labels of both classes the grammar has
its fixed words only and the score is the share of label 1 (0 if there is none);
long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.common import bounded, fold, majority

INSULT, THREAT, GERUND, TARGET, PASSIVE, NEGATION, REPORT, OTHER = "insult", "threat", "gerund", "target", "passive", "negation", "report", "other"

#: Verbs of threats, in the languages served (they are inflected by rule), and forms that the rules do not make.
THREAT_VERBS = {
    "en": "kill hurt destroy beat punch stab shoot murder strangle smash",
    "de": "töten schlagen umbringen verletzen erschießen zerstören",
    "fr": "tuer frapper détruire poignarder",
    "es": "matar golpear destruir apuñalar",
}
IRREGULAR = "beaten shot schlägst schlägt schlug bringe bringst bringt erschoss détruis détruit destruye destruyo"
#: Words of the other fixed classes; insults are learned.
FIXED_WORDS = {
    TARGET: "you yourself he she they him her them people du dich ihr euch sie er tu toi vous ils elles tú usted ustedes ellos",
    PASSIVE: "be been is are was were get gets got deserve deserves wird wirst werdet werden wurde wurden est êtes sera seras serez seront être es son será serás serán ser fue fueron",
    NEGATION: "not no never neither nor nobody without nicht kein keine nie niemals ohne ne pas jamais sans nunca jamás sin tampoco",
    REPORT: "said says say wrote writes claimed claims reported quoted called sagte sagt schrieb behauptet dit écrit affirme prétend dijo dice escribió afirma",
}


def inflected(verb: str, language: str) -> set[str]:
    """The regular forms of a verb."""
    if language == "en":
        stem = verb.removesuffix("e")
        doubled = verb + verb[-1] if verb[-1] in "bpt" and verb[-2] in "aeiou" and verb[-3] not in "aeiou" else stem
        past = {"beat": set(), "shoot": set()}.get(verb, {stem + "ed", doubled + "ed"})
        return {verb, verb + "s", verb + "es", stem + "ing", doubled + "ing", stem + "er"} | past
    cut, endings = {"de": (2, "e st est t et en te test tet ten end"), "fr": (2, "e es ons ez ent er ir re é ée és ai as a ait"), "es": (2, "o as a amos an ar ir é aste ó aron ando ado aré")}[language]
    return {verb} | {verb[:-cut] + e for e in endings.split()}


#: What the last transducer emits.
KINDS = ("threat", "targeted", "plain", "reported", "reported threat", "negated", "negated threat")

_WORD = re.compile(r"\w+")
_ENDS = ".!?;\n"  # not a colon: what is said behind it is still reported
_CLAUSE_END = re.compile(f"[{_ENDS}]")

Machine = Callable[[int, tuple], tuple[int, tuple]]


def _negation(state: int, x: tuple) -> tuple[int, tuple]:
    """Marks what stands within three words after a negation."""
    if x[0] == NEGATION:
        return 3, x
    return max(state - 1, 0), (*x, "negated") if state else x


def _reported(state: int, x: tuple) -> tuple[int, tuple]:
    """Marks all that follows a reporting verb in the clause."""
    return int(state or x[0] == REPORT), (*x, "reported") if state else x


def _target(state: int, x: tuple) -> tuple[int, tuple]:
    """Marks what stands within four words after a target."""
    if x[0] == TARGET:
        return 4, x
    return max(state - 1, 0), (*x, "targeted") if state else x


def _suffering(state: int, x: tuple) -> tuple[int, tuple]:
    """Marks what stands within four words after an auxiliary of the passive that a target comes before."""
    if x[0] == PASSIVE and ("targeted" in x or state):
        return 4, x
    return max(state - 1, 0), (*x, "suffered") if state else x


#: What is open while a target is awaited: the words left, and the kind that the threat is of.
_OPEN = [(n, kind) for kind in ("threat", "reported threat", "negated threat") for n in range(5)]


def _match(state: int, x: tuple) -> tuple[int, tuple]:
    """Emits the kind of each match; a threat counts if it is suffered by a target, or once a target follows within four words."""
    left, kind = _OPEN[state]
    after = _OPEN.index((max(left - 1, 0), kind))
    if x[0] == INSULT:
        return after, ("negated" if "negated" in x else "reported" if "reported" in x else "targeted" if "targeted" in x else "plain",)
    if x[0] in (THREAT, GERUND):
        kind = "negated threat" if "negated" in x else "reported threat" if "reported" in x else "threat"
        if x[0] == THREAT and "suffered" in x:
            return 0, (kind,)
        return _OPEN.index((4, kind)), ()
    if x[0] == TARGET and left:
        return 0, (kind,)
    return after, ()


class Cascade:
    """Composition of transducers; the states and arcs of the product are made as they are met."""

    def __init__(self, *machines: Machine) -> None:
        self.machines = machines
        self.states = {(0,) * len(machines): 0}
        self.tuples = [*self.states]
        self.arcs: dict[tuple[int, str], tuple[int, tuple]] = {}

    def step(self, state: int, symbol: str) -> tuple[int, tuple]:
        if (arc := self.arcs.get((state, symbol))) is None:
            now, x, after = self.tuples[state], (symbol,), []
            for machine, s in zip(self.machines, now, strict=True):
                s, x = machine(s, x)
                after.append(s)
            if (to := tuple(after)) not in self.states:
                self.states[to] = len(self.tuples)
                self.tuples.append(to)
            arc = self.arcs[state, symbol] = self.states[to], x
        return arc


class Grammar:
    """The lexical transducer composed with the cascade."""

    def __init__(self, insults: dict[str, float], threats: dict[str, float] | None = None) -> None:
        """insults: weight of each whole word, or of each beginning of a word if it ends in `*`; threats: weight of each form, 1 for others."""
        self.insults, self.threats = insults, threats or {}
        self.fixed = {f: GERUND if k == "en" and f.endswith("ing") else THREAT for k, verbs in THREAT_VERBS.items() for v in verbs.split() for f in inflected(v, k)}
        self.fixed |= dict.fromkeys(IRREGULAR.split(), THREAT) | {w: c for c, ws in FIXED_WORDS.items() for w in ws.split()}
        self.lengths = sorted({len(k) - 1 for k in insults if k.endswith("*")}, reverse=True)
        self.cascade = Cascade(_negation, _reported, _target, _suffering, _match)
        triggers = [re.escape(k[:-1]) if k.endswith("*") else re.escape(k) + r"\b" for k in insults] + sorted({w[:4] for w, c in self.fixed.items() if c in (THREAT, GERUND)})
        self.trigger = re.compile(rf"\b(?:{'|'.join(sorted(triggers))})")

    def symbol(self, word: str) -> tuple[str, float]:
        if (w := self.insults.get(word)) is not None:
            return INSULT, w
        for n in self.lengths:
            if len(word) >= n and (w := self.insults.get(word[:n] + "*")) is not None:
                return INSULT, w
        return self.fixed.get(word, OTHER), self.threats.get(word, 1.0)

    def clauses(self, text: str) -> Iterator[tuple[int, int]]:
        """Start and end of each clause that holds a trigger."""
        at = 0
        while m := self.trigger.search(text, at):
            start = max(map(lambda c: text.rfind(c, at, m.start()), _ENDS)) + 1 or at
            end = e.start() if (e := _CLAUSE_END.search(text, m.end())) else len(text)
            yield start, end
            at = end

    def matches(self, clause: str) -> Iterator[tuple[str, str, float]]:
        """Kind, word and weight of each match of a clause; a threat's word is its verb."""
        state, verb = 0, ("", 1.0)
        for word in _WORD.findall(clause):
            symbol, weight = self.symbol(word)
            if symbol in (THREAT, GERUND):
                verb = word, weight
            state, kinds = self.cascade.step(state, symbol)
            for k in kinds:
                yield (k, *verb) if k.endswith("threat") else (k, word, weight)

    def weigh(self, clause: str) -> tuple[str, float] | None:
        """What one clause is: the strongest of the kinds that its matches are of (the first of KINDS), and its largest weight; None without a match."""
        out: dict[str, float] = {}
        for k, _, weight in self.matches(clause):
            out[k] = max(out.get(k, 0.0), weight)
        return next(((k, out[k]) for k in KINDS if k in out), None)

    def threatening(self, text: str | None) -> set[str]:
        """The verbs of the threats of a text that are neither negated nor reported."""
        low = (text or "").lower()
        return {word for a, b in self.clauses(low) for k, word, _ in self.matches(low[a:b]) if k == "threat"}

    def features(self, text: str | None) -> list[float]:
        """Weights of the clauses added up by kind, the largest clause, and matched clauses, each on a log scale."""
        low = (text or "").lower()
        sums, most, matched = dict.fromkeys(KINDS, 0.0), 0.0, 0
        for start, end in self.clauses(low):
            if found := self.weigh(low[start:end]):
                kind, weight = found
                matched += 1
                most = max(most, weight)
                sums[kind] += weight
        return [*(np.log1p(sums[k]) for k in KINDS), np.log1p(most), np.log1p(1000.0 * matched / (len(low) + 200))]


def _units(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) >= n}


def learn_insults(sample: DataFrame, evidence: float, least_weight: float) -> dict[str, float]:
    """Words and word beginnings that mark label 1, with the log ratio of their shares among documents of either label.

    `sample` has text and label and is bounded. Kept is what weighs `least_weight` at least
    and whose log-likelihood ratio against the overall share of label 1 exceeds the
    logarithm of the number of words and beginnings tried by `evidence`.
    """

    def count(keep: set[str] | None) -> Callable:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            for frame in frames:
                for text in frame["text"]:
                    units = _units(text)
                    seen.update(units if keep is None else units & keep)
            yield pd.DataFrame({"unit": list(seen), "n": list(seen.values())}).astype({"unit": str, "n": "int64"})

        return run

    rows = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(rows) != {0.0, 1.0}:
        return {}
    of = lambda label, keep: sample.filter(F.col("label") == label).select("text").mapInPandas(count(keep), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    tried = of(1.0, None).persist()
    least = np.log(max(tried.count(), 1)) + evidence
    base = rows[1.0] / (rows[0.0] + rows[1.0])
    marked = {r["unit"]: r["n"] for r in tried.filter(F.col("n") * F.lit(float(-np.log(base))) > F.lit(float(least))).collect()}
    tried.unpersist()
    clean = {r["unit"]: r["n"] for r in of(0.0, set(marked)).collect()}
    weights = {}
    for u, n in marked.items():
        m = clean.get(u, 0)
        told = n * np.log(n / ((n + m) * base)) + (m * np.log(m / ((n + m) * (1 - base))) if m else 0.0)
        if told > least:
            weights[u] = float(np.log((n + 0.5) / (rows[1.0] + 1.0)) - np.log((m + 0.5) / (rows[0.0] + 1.0)))
    kept: dict[str, float] = {}
    for u in sorted((u for u, w in weights.items() if w >= least_weight), key=lambda u: (len(u.rstrip("*")), not u.endswith("*"), u)):
        shorter = [kept[p] for n in (4, 5, 6) if n <= len(u.rstrip("*")) and (p := u[:n] + "*") in kept]
        if not shorter or max(shorter) < weights[u] - 1.0:
            kept[u] = weights[u]
    return kept


def learn_threats(sample: DataFrame, least: float = 0.1, most: float = 6.0) -> dict[str, float]:
    """The weight of each verb form that threatens in the sample: the log ratio of its shares among documents of either label.

    Forms that never do keep their weight of 1.
    """
    grammar = Grammar({})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for label, text in zip(frame["label"], frame["text"], strict=True):
                seen.update((label, w) for w in grammar.threatening(text))
        yield pd.DataFrame({"label": [k for k, _ in seen], "word": [w for _, w in seen], "n": list(seen.values())}).astype({"label": float, "word": str, "n": "int64"})

    rows = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if set(rows) != {0.0, 1.0}:
        return {}
    counts: dict[str, dict[float, int]] = {}
    for r in sample.select("label", "text").mapInPandas(run, "label double, word string, n long").groupBy("label", "word").agg(F.sum("n").alias("n")).collect():  # as many as forms of verbs
        counts.setdefault(r["word"], {})[r["label"]] = r["n"]
    share = lambda c, k: np.log((c.get(k, 0) + 0.5) / (rows[k] + 1.0))
    return {w: float(np.clip(share(c, 1.0) - share(c, 0.0), least, most)) for w, c in counts.items()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Coefficients (intercept last) of a ridge logistic regression, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_toxicity(docs: DataFrame, labels: DataFrame, train_on=None, max_labelled: int = 8000, evidence: float = 2.0, least_weight: float = 2.0) -> DataFrame:
    """doc_id, score (probability that toxic is 1) and matched kinds for each row of `docs`.

    `train_on` is a condition on doc_id: only labels of rows that meet it are learned, and
    of those about `max_labelled` at most.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = majority(labels, "toxic")
    if train_on is not None:
        known = known.filter(train_on)
    sample = docs.join(bounded(known, "doc_id", max_labelled), "doc_id").groupBy("text").agg(F.when(F.avg("label") >= 0.5, 1.0).otherwise(0.0).alias("label")).persist()
    grammar = Grammar(learn_insults(sample, evidence, least_weight), learn_threats(sample))

    def matches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "x": [grammar.features(t) for t in frame["text"]]})

    fitted = sample.mapInPandas(matches, "label double, x array<double>").toPandas()  # about max_labelled rows
    sample.unpersist()
    y = fitted["label"].to_numpy(float)
    width = len(KINDS) + 2
    if len(set(y)) == 2:
        beta = fit_logistic(np.vstack(fitted["x"].to_list()), y)
    else:
        share = float(y.mean()) if len(y) else 0.0
        beta = np.zeros(width + 1)
        beta[-1] = np.log((share + 1e-6) / (1 - share + 1e-6))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([grammar.features(t) for t in frame["text"]], float).reshape(-1, width)
            score = 1 / (1 + np.exp(-np.clip(x @ beta[:-1] + beta[-1], -500, 500)))
            sums = np.expm1(x[:, : len(KINDS)])
            of = [sums[:, [i for i, k in enumerate(KINDS) if k.endswith("threat") == threat]].sum(axis=1) for threat in (False, True)]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": score, "insults": of[0], "threats": of[1]})

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, insults double, threats double")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each document, and the weights of its matches."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold(F.col("doc_id"), 5) == 0
    return score_toxicity(docs, labels, ~held_out).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "insults", "threats"
    )
