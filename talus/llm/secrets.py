"""Secret scans with a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: which
trigrams every match must hold. Postings of those trigrams (trigram, document) are
made from the lower-cased texts and intersected, which leaves the candidates of each
rule; a rule without mandatory trigrams has all documents as candidates. The rule is
then run on the whole text of its candidates.

Edge cases: a null text counts as empty; a null doc_id is a document of its own;
repeated rows are scanned each; empty tables give no rows; long texts are read whole;
matches that fail a rule's least length are dropped; matches of different rules may
overlap; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """`group` of a match must have `least` characters; both Java and Python read `pattern` alike."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosted", r"(?:ghp|gho|ghs|ghr|github_pat)_[A-Za-z0-9_]{20,}"),
)
RULES = BASE_RULES + MORE_RULES

#: Sets of strings that grow beyond this are given up for what they imply.
_MOST_STRINGS = 16

Query = frozenset  # alternatives, each a frozenset of trigrams that must all be there
ALL: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    every = {x | y for x, y in product(a, b)}
    return frozenset(x for x in every if not any(y < x for y in every))


def _of_strings(strings: set[str]) -> Query:
    """What a text must hold that holds one of the strings."""
    if any(len(s) < 3 for s in strings):
        return ALL
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


@dataclass
class _Part:
    """What is known of the matches of a part: all of them if few, how they begin and end, and a query."""

    exact: set[str] | None
    first: set[str]
    last: set[str]
    query: Query = ALL

    def settled(self) -> Query:
        return self.query if self.exact is None else _both(self.query, _of_strings(self.exact))


_ANY = _Part(None, {""}, {""})


def _part(exact: set[str]) -> _Part:
    return _Part(exact, {s[:2] for s in exact}, {s[-2:] for s in exact})


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _MOST_STRINGS:
        return _part({x + y for x, y in product(a.exact, b.exact)})
    cross = lambda x, y: {p + q for p, q in product(x, y)}
    first = {s[:2] for s in cross(a.exact, b.first)} if a.exact is not None and len(a.exact) <= _MOST_STRINGS else a.first
    last = {s[-2:] for s in cross(a.last, b.exact)} if b.exact is not None and len(b.exact) <= _MOST_STRINGS else b.last
    return _Part(None, first, last, _both(_both(a.settled(), b.settled()), _of_strings(cross(a.last, b.first))))


def _read(items, any_case: bool) -> _Part:
    out = _part({""})
    for op, value in items:
        if op is sre.LITERAL:
            part = _part({chr(value).lower()})
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in value) and len(value) <= 4:
            part = _part({chr(v).lower() for _, v in value})
        elif op is sre.SUBPATTERN:
            part = _read(value[-1], any_case)
        elif op is sre.BRANCH:
            parts = [_read(x, any_case) for x in value[1]]
            if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _MOST_STRINGS:
                part = _part(set().union(*(p.exact for p in parts)))
            else:
                part = _Part(None, set().union(*(p.first for p in parts)), set().union(*(p.last for p in parts)), frozenset().union(*(p.settled() for p in parts)))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = value
            one = _read(inner, any_case)
            if least == 0:
                part = _part(one.exact | {""}) if most == 1 and one.exact is not None else _ANY
            else:
                part = one if least == most == 1 else _Part(None, one.first, one.last, one.settled())
        else:
            part = _ANY
        out = _then(out, part)
    return out


def trigram_query(rule: Rule) -> Query:
    """Alternatives of lower-case trigrams; each match holds all trigrams of one alternative. ALL: no trigram is mandatory."""
    query = _read(sre_parser.parse(rule.pattern), rule.any_case).settled()
    return ALL if frozenset() in query else query


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index of the given trigrams: trigram, doc_id for each text that holds it in either case."""
    vocabulary = F.array(*(F.lit(t) for t in trigrams))
    held = F.transform(F.array(F.lower("text")), lambda low: F.filter(vocabulary, lambda t: F.contains(low, t)))[0]
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id and `kinds`, the rules with mandatory trigrams that the document may match."""
    spark = docs.sparkSession
    queries = {r.kind: q for r in rules if (q := trigram_query(r)) != ALL}
    terms = [(kind, i, len(each), t) for kind, q in queries.items() for i, each in enumerate(sorted(q, key=sorted)) for t in sorted(each)]
    index = postings(docs, sorted({t for *_, t in terms}))
    wanted = spark.createDataFrame(terms, "kind string, alternative int, n_terms int, trigram string")
    return (
        index.join(F.broadcast(wanted), "trigram")  # a few rows for each rule
        .groupBy("doc_id", "kind", "alternative").agg(F.count_distinct("trigram").alias("n"), F.first("n_terms").alias("n_terms"))
        .filter("n = n_terms").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    )


#: Matches of a text whose spans are gathered before they join the others.
RUN = 256


def _spans(rule: Rule, rank: int, at: str) -> Column:
    """The rule's matches as structs of start, rank, end (code points), from columns m, g and p of the rule.

    They are gathered in runs, so that each match adds to a short array, however many the text holds.
    """
    m, g, p = (f"{x}_{at}" for x in "mgp")
    struct = "struct<start:int,rank:int,end:int>"
    none, no_runs = f"cast(array() as array<{struct}>)", f"cast(array() as array<array<{struct}>>)"
    span = f"named_struct('start', a.at + length({p}[i]), 'rank', {rank}, 'end', a.at + length({p}[i]) + length({m}[i]))"
    step = (
        f"(a, i) -> named_struct('at', a.at + length({p}[i]) + length({m}[i]), "
        f"'found', if(length({g}[i]) >= {rule.least}, concat(a.found, array({span})), a.found))"
    )
    run = (
        f"aggregate(sequence(k, least(k + {RUN - 1}, size({m}) - 1)), named_struct('at', b.at, 'found', {none}), {step}, "
        f"a -> named_struct('at', a.at, 'found', concat(b.found, array(a.found))))"
    )
    return F.expr(
        f"if(coalesce(size({m}), 0) <= 0, {none}, aggregate(sequence(0, size({m}) - 1, {RUN}), "
        f"named_struct('at', 0, 'found', {no_runs}), (b, k) -> {run}, b -> flatten(b.found)))"
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text, `row` (the other columns of the input) and `found`, an array of start, rank (of the rule in `rules`), end, for each row of `docs`."""
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"))
    few = candidates(docs.select("doc_id", "text"), rules).withColumnRenamed("doc_id", "candidate_id")
    rows = docs.join(few, F.col("doc_id").eqNullSafe(F.col("candidate_id")), "left").drop("candidate_id")
    columns = {}
    for rule in rules:
        pattern = F.lit(("(?i)" if rule.any_case else "") + rule.pattern)
        active = F.lit(True) if trigram_query(rule) == ALL else F.array_contains("kinds", rule.kind)
        columns[f"m_{rule.kind}"] = F.when(active, F.regexp_extract_all("text", pattern, F.lit(0)))
        if rule.group:
            columns[f"g_{rule.kind}"] = F.when(active, F.regexp_extract_all("text", pattern, F.lit(rule.group)))
    rows = rows.withColumns(columns)
    rows = rows.withColumns({f"p_{r.kind}": F.when(F.size(f"m_{r.kind}") > 0, F.split("text", ("(?i)" if r.any_case else "") + r.pattern, -1)) for r in rules})
    rows = rows.withColumns({f"g_{r.kind}": F.col(f"m_{r.kind}") for r in rules if not r.group})
    found = F.array_sort(F.concat(*(_spans(r, k, r.kind) for k, r in enumerate(rules))))
    return rows.select("doc_id", "text", "row", found.alias("found"))


def _joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat(F.element_at(kinds, s["rank"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


#: Characters of the pieces in which a text is masked.
PIECE = 4096


def redacted(text: Column, found: Column) -> Column:
    """`text` with each found span made asterisks, piece by piece, so that many spans do not copy a long text each."""

    def masked(piece: Column, k: Column) -> Column:
        begin = k * PIECE
        low = lambda s: F.greatest(s["start"] - begin, F.lit(0))
        high = lambda s: F.least(s["end"] - begin, F.lit(PIECE))
        mask = lambda t, s: F.concat(F.substring(t, F.lit(1), low(s)), F.repeat(F.lit("*"), high(s) - low(s)), F.substring(t, high(s) + 1, F.length(t)))
        return F.aggregate(F.filter(found, lambda s: (s["start"] < begin + PIECE) & (s["end"] > begin)), piece, mask)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(found) == 0, text).otherwise(F.array_join(F.transform(pieces, masked), ""))


def without_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `docs`, with all their columns, in which each found span is made asterisks; a null text becomes empty."""
    found = find_secrets(docs, rules)
    clean = redacted(F.col("text"), F.col("found")).alias("text")
    return found.select(*(clean if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each document."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    counts = [F.expr(f"cast(size(filter(found, s -> s.rank = {k})) as long)").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(_joined(base, RULES), 256).alias("base_sha256"), _joined(F.col("found"), RULES).alias("spans"))


def _sql() -> str:
    part = lambda k, r: f"""
    list_filter(list_transform(range(len(m{k})), lambda i: {{
      's': coalesce(list_sum(list_transform(p{k}[1:i + 1], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(m{k}[1:i], lambda x: length(x))), 0)::BIGINT,
      'r': {k}, 'n': length(m{k}[i + 1]), 'g': length(g{k}[i + 1])}}), lambda x: x.g >= {r.least})"""  # noqa: E731
    cells = []
    for k, r in enumerate(RULES):
        pattern = (("(?i)" if r.any_case else "") + r.pattern).replace("'", "''")
        cells.append(f"regexp_extract_all(t, '{pattern}') AS m{k}, regexp_extract_all(t, '{pattern}', {r.group}) AS g{k}, string_split_regex(t, '{pattern}') AS p{k}")
    show = lambda x: f"array_to_string(list_transform({x}, lambda x: ['{"', '".join(r.kind for r in RULES)}'][x.r + 1] || ':' || x.s || ':' || (x.s + x.n)), ',')"
    return f"""
WITH cut AS (SELECT doc_id, {", ".join(cells)} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
spans AS (SELECT doc_id, list_sort(list_concat({", ".join(part(k, r) for k, r in enumerate(RULES))})) AS f FROM cut)
SELECT doc_id, {", ".join(f"len(list_filter(f, lambda x: x.r = {k}))::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE_RULES))},
       sha256(coalesce({show(f"list_filter(f, lambda x: x.r < {len(BASE_RULES)})")}, '')) AS base_sha256, coalesce({show("f")}, '') AS spans
FROM spans
"""


SQL = _sql()
