"""Operators on networks of image pairs: pair building, deduplication, components, bridges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talus.operators.forest import eldest_in, histories, merge_forest
from talus.sources.storage import stored


def band_pairs(scenes: DataFrame, by: list[str], time: str, scene: str, n_neighbours: int, max_days: int) -> DataFrame:
    """Pairs of each scene with the next n of its series, one to max_days days apart."""
    series = Window.partitionBy(*by).orderBy(time, scene)
    each = F.array(*(F.struct(F.lead(scene, k).over(series).alias("sec"), F.lead(time, k).over(series).alias("sec_ts")) for k in range(1, n_neighbours + 1)))
    rows = scenes.select(*by, F.col(scene).alias("ref"), F.col(time).alias("ref_ts"), each.alias("x")).select(*by, "ref", "ref_ts", F.explode("x").alias("x")).select(*by, "ref", "ref_ts", "x.*")
    days = F.floor((F.unix_timestamp("sec_ts") - F.unix_timestamp("ref_ts")) / 86400).cast("int")
    return rows.withColumn("days", days).filter(F.col("days").between(1, max_days))


def new_pairs(pairs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pairs (a, b in either order) that no job has yet: neither done nor running, nor failed twice."""
    key = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    tally = jobs.groupBy(*key).agg(F.count_if(F.col("status") == "FAILED").alias("failed"), F.count_if(F.col("status") != "FAILED").alias("other"))
    done = tally.filter((F.col("other") > 0) | (F.col("failed") >= 2)).select("lo", "hi")
    keyed = pairs.withColumns({"lo": F.least("a", "b"), "hi": F.greatest("a", "b")})
    return keyed.join(done, ["lo", "hi"], "left_anti").drop("lo", "hi")


def components(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """`component`, the smallest node that each node reaches; nodes (node), edges (a, b), each with `by`.

    Labels spread to neighbours and then jump to the label of their label, until nothing
    changes, with each round written out. Joins are merge joins at every size: labels grow with the input, and none are gathered in the driver.
    """
    both = edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both)
    labels = stored(nodes.select(*by, "node", F.col("node").alias("component")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b").hint("merge"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = labels.join(seen.hint("merge"), [*by, "node"], "left").select(*by, "node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = low.select(*by, F.col("node").alias("component"), F.col("component").alias("further"))
        new = stored(low.join(jump.hint("merge"), [*by, "component"], "left").select(*by, "node", "old", F.least("component", "further").alias("component")))
        if new.filter("old <> component").isEmpty():
            return new.drop("old")
        labels = new.drop("old")


def bridging_edges(edges: DataFrame, labels: DataFrame, by: list[str]) -> DataFrame:
    """Edges whose ends lie in different components."""
    at = lambda end: labels.select(*by, F.col("node").alias(end), F.col("component").alias(f"{end}_component")).hint("merge")
    return edges.join(at("a"), [*by, "a"]).join(at("b"), [*by, "b"]).filter("a_component <> b_component")


GATE = {"max_r2": 0.5, "min_coherence": 0.6, "min_pct": 30.0, "max_bperp": None}


def gate_failure(df: DataFrame, gate: dict) -> DataFrame:
    """`failure`: the first measure that fails; what is missing does not fail."""
    first = F.coalesce(
        F.when(F.col("r2") > gate["max_r2"], F.lit("atmos_r2")), F.when(F.col("coherence") < gate["min_coherence"], F.lit("coherence")),
        F.when(F.col("pct") < gate["min_pct"], F.lit("surviving_pct")), F.when(F.col("bperp") > F.lit(gate["max_bperp"]).cast("double"), F.lit("bperp")),
    )
    return df.withColumn("failure", first)


def select_bridges(pairs: DataFrame, stack: str = "stack", gate: dict | None = None) -> DataFrame:
    """Candidates that join separate parts of their stack's network, as if chosen one after the other.

    Kept pairs are the base; pairs of concern, and kept ones that were rescued before,
    are candidates, best coverage first, then lowest r2, then dates. The base and the candidates that pass the
    gate make one merge tree, whose height is the place in the order, the base in one place before all: the candidates
    that join parts in it are selected. One that fails the gate is told if its ends are
    in different parts at its own place in the order.
    """
    gate = GATE | (gate or {})
    by = [stack]
    rescued = F.contains(F.coalesce("reasons", F.lit("")), F.lit("RESCUED_FOR_CONNECTIVITY"))
    candidate = (F.col("decision") == "CONCERN") | ((F.col("decision") == "KEEP") & rescued)
    role = F.when(candidate, "candidate").when(F.col("decision") == "KEEP", "base")
    order = {"coverage": -F.coalesce("pct", F.lit(-1.0)), "r2": F.coalesce("r2", F.lit(1.0)), "ref": F.col("ref"), "sec": F.col("sec"), "product": F.col("product")}
    later = F.col("role") != "base"
    place = F.struct(later.alias("later"), *(F.when(later, c).alias(n) for n, c in order.items()))
    rows = gate_failure(pairs, gate).withColumn("role", role).filter("role is not null").withColumn("height", place)
    rows = stored(rows.select(stack, "role", "height", F.col("ref").alias("a"), F.col("sec").alias("b"), "failure"), "bridge-rows")
    tree = stored(merge_forest(rows.filter("role = 'base' or failure is null").select(stack, "a", "b", "height"), by), "bridge-tree")
    chosen = tree.filter("height.later").select(stack, "height.product", F.lit(True).alias("selected"), F.lit(None).cast("string").alias("failure"))
    apart, known = rows.filter("role = 'candidate' and failure is not null and a <> b"), histories(tree, by)
    for end in ("a", "b"):
        apart = eldest_in(apart, known, by, end, "height").withColumnRenamed("eldest", f"{end}_part")
    told = apart.filter("a_part <> b_part").select(stack, "height.product", F.lit(False).alias("selected"), "failure")
    return chosen.unionByName(told)


def baseline_difference(pairs: DataFrame, scenes: DataFrame, by: list[str]) -> DataFrame:
    """`bperp`: distance of the baselines of a pair's ends; null if one is unknown."""
    at = lambda end: scenes.select(*by, F.col("scene").alias(end), F.col("bperp").alias(f"_{end}"))
    return pairs.join(at("ref"), [*by, "ref"], "left").join(at("sec"), [*by, "sec"], "left").withColumn("bperp", F.abs(F.col("_sec") - F.col("_ref"))).drop("_ref", "_sec")
