"""Steps that must not grow with pairs, with single tasks or with the order of rows."""

import itertools
import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import functions as F

from talus.operators import areas, audit, exposure, forest, network, raster, validation, zones


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_points_meet_one_row_of_a_cell(spark):
    px = spark.range(40).select(F.format_string("s%02d", "id").alias("stack"), F.lit(1).alias("row"), F.lit(2).alias("col"), F.when(F.col("id") >= 3, F.col("id").cast("double")).alias("v"))
    points = spark.createDataFrame([(1, 1, 2), (2, 1, 2), (3, 9, 9)], "point long, row int, col int")
    out = raster.sample_points(points, px, ["stack"], "v", "point", "stack")
    assert sorted(map(tuple, out.collect())) == [(1, "s03", 3.0), (2, "s03", 3.0)]
    plan = plan_of(out)
    assert plan.index("Join") < plan.index("Aggregate")  # the grids of a cell are one row before points meet it
    of_stack = raster.sample_points(points.withColumn("stack", F.lit("s07")), px, ["stack"], "v", "point", "stack")
    assert sorted(map(tuple, of_stack.collect())) == [(1, "s07", 7.0), (2, "s07", 7.0)]


def test_zones_on_a_limit_do_not_depend_on_the_order_of_rows(spark):
    values = [10.0 - 80.0 * (k / 211.0) for k in (168, 67, 195, 116, 172, 186, 201, 161)]  # their exact mean is -50
    orders = list(itertools.permutations(values))[::371]
    assert len({reduce(add, o) for o in orders}) > 1  # plain sums differ
    rows = [("s", k, i, 0, v, 0.9, 30.0) for k, o in enumerate(orders) for i, v in enumerate(o)]
    px = spark.createDataFrame(rows, "stack string, zone int, row int, col int, velocity double, fs double, slope_deg double").coalesce(1)
    out = zones.describe(px, ["stack"], 80.0).select("mean_velocity", "severity").distinct().collect()
    assert [tuple(r) for r in out] == [(-50.0, "CRITICAL")]


def test_cells_in_sight_are_dealt_to_tasks(spark, monkeypatch):
    parts, stored = {}, validation.stored

    def counted(df, name="step"):
        parts[name] = df.rdd.getNumPartitions()
        return stored(df, name)

    monkeypatch.setattr(validation, "stored", counted)
    at = lambda n, a, b: spark.range(n).select(F.col("id").alias("k"), (F.col("id") * a % 997 / 997.0 + 75.0).alias("lon"), (F.col("id") * b % 991 / 991.0 + 33.0).alias("lat"))
    points, places = at(300, 7919, 6007).withColumnRenamed("k", "point"), at(60, 317, 419).withColumnRenamed("k", "zone")
    out = validation.nearest_zone(points, places, [], "point", "zone").collect()
    assert parts["nearest-cells"] == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1  # not one task, however few bytes these are
    held = places.collect()
    for r in out:
        d = lambda z, r=r: (z["lon"] - r["lon"]) ** 2 * 0.7 + (z["lat"] - r["lat"]) ** 2
        assert r["nearest_km"] <= 111.4 * min(map(d, held)) ** 0.5 * 1.05


def test_differences_count_both_tables_once(spark):
    a = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (2,), (3,), (None,)], "k int")
    out = audit.differences(a, b)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(1, "left"), (1, "left"), (None, "left"), (3, "right")]))
    assert plan_of(out).count("Aggregate") == 1


def broadcasts_of(run, monkeypatch, *modules):
    """Results of `run`, and how many of its tables (written on the way, or its result) plan to gather a table in the driver."""
    found, plain = [], {m: m.stored for m in modules}
    planned = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    for m in modules:
        monkeypatch.setattr(m, "stored", lambda df, name="step", m=m: (found.append(planned(df)), plain[m](df, name))[1])
    out = run()
    return out.collect(), sum(found) + planned(out)


def test_labels_and_components_gather_no_table(spark, monkeypatch):
    nodes = spark.range(40).select(F.lit("s").alias("stack"), F.col("id").alias("node"))
    edges = spark.range(39).filter("id % 10 <> 9").select(F.lit("s").alias("stack"), F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    rows, gathered = broadcasts_of(lambda: network.components(nodes, edges, ["stack"]), monkeypatch, network)
    assert {r["node"]: r["component"] for r in rows} == {k: k // 10 * 10 for k in range(40)} and gathered == 0
    px = spark.range(60).select(F.lit("s").alias("stack"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    rows, gathered = broadcasts_of(lambda: raster.label_zones(px, ["stack"], F.col("col") % 4 != 3), monkeypatch, network, raster)
    assert {(r["col"] // 4, r["zone"]) for r in rows} == {(0, 0), (1, 4), (2, 8)} and len(rows) == 48 and gathered == 0
    labels = nodes.withColumn("component", F.floor(F.col("node") / 10))
    rows, gathered = broadcasts_of(lambda: network.bridging_edges(spark.createDataFrame([("s", 9, 10), ("s", 1, 2)], "stack string, a long, b long"), labels, ["stack"]), monkeypatch, network)
    assert [(r["a"], r["b"]) for r in rows] == [(9, 10)] and gathered == 0


def test_merge_trees_gather_no_table(spark, monkeypatch):
    cells = spark.range(60).select(F.lit("s").alias("stack"), (F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"))
    rows, gathered = broadcasts_of(lambda: forest.zones_at_levels(cells, ["stack"], F.when(F.col("col") % 4 != 3, F.col("col") * 0.01), [0.05, 1.0]), monkeypatch, forest)
    assert len(rows) == 6 * 4 + 48 and len({(r["at"], r["zone"]) for r in rows}) == 5 and gathered == 0
    rows, gathered = broadcasts_of(lambda: raster.flow_accumulation(cells.withColumn("z", F.col("col") * 1.0), ["stack"], "z"), monkeypatch, raster)
    assert sum(r["accum"] for r in rows if r["col"] == 0) == 60 and gathered == 0


def squares(spark, rows):
    at = lambda a, b: F.struct((F.col("x") + a).alias("lon"), (F.col("y") + b).alias("lat"))
    vertices = F.array(at(0.0, 0.0), at(2.0, 0.0), at(2.0, 2.0), at(0.0, 2.0))
    return spark.createDataFrame(rows, "district string, region long, ring int, x double, y double").select("district", "region", "ring", vertices.alias("vertices"))


def test_places_in_polygons_are_judged_where_they_meet(spark):
    rings = squares(spark, [("d", 1, 0, 0.0, 0.0), ("d", 1, 1, 1.0, 1.0), ("d", 2, 0, 10.0, 0.0)])
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 2.5, 2.5), (4, 5.0, 1.0), (5, 11.0, 1.0), (6, None, 1.0)], "point int, lon double, lat double")
    out = exposure.points_in_polygons(points, exposure.polygon_edges(rings, ["region"]), ["region"], "point", 0.7)
    assert sorted(map(tuple, out.collect())) == [(1, 1), (1, 2), (1, 3), (2, 5)]  # inside two rings of a group: one row
    assert "Aggregate" not in plan_of(out).split("Join")[0]  # no shuffle of pairs


def test_pieces_of_a_boundary_meet_their_own_group(spark):
    rings = squares(spark, [("d", 1, 0, 0.0, 0.0), ("d", 2, 0, 1.0, 1.0), ("e", 3, 0, 0.5, 0.5)])
    out = areas.union_boundary(rings, ["district"], "region", 0.7)
    got = {r["district"]: (round(r["area"], 9), round(r["length"], 9)) for r in areas.enclosed_area(out, ["district"]).collect()}
    assert got == {"d": (7.0, 12.0), "e": (4.0, 8.0)}
    plan = plan_of(out)
    assert plan.count("Join") == 1 and "LeftAnti" in plan and "district" in plan.split("Join LeftAnti")[1].split("\n")[0]


def test_ranges_of_ranks_are_found_by_halving(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 50 != 0, F.col("id") * 37 % 101).alias("score"))
    out = validation.ordinal_ranks(df, [], "score", "id", cuts=16)
    rows = sorted(out.collect(), key=lambda r: (r["score"] is not None, r["score"] or 0, r["id"]))
    assert [r["rank"] for r in rows] == list(range(1, 1001))
    assert "filter(" not in plan_of(out).lower()  # no walk over all cuts


def test_points_meet_one_list_of_zones(spark, monkeypatch):
    at = lambda n, a, b: spark.range(n).select(F.col("id").alias("k"), (F.col("id") * a % 97 / 97.0 + 75.0).alias("lon"), (F.col("id") * b % 89 / 89.0 + 33.0).alias("lat"))
    points = at(150, 31, 17).withColumnRenamed("k", "point").unionByName(spark.createDataFrame([(999, None, 33.0)], "point long, lon double, lat double"))
    places = at(70, 41, 23).withColumnRenamed("k", "zone").withColumn("rung", F.explode(F.when(F.col("zone") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    monkeypatch.setattr(validation, "HOT", 1)  # full cells are dealt to several tasks
    plain = {}
    for most in (1024, 1):  # lists in one row, and cut
        monkeypatch.setattr(validation, "LIST", most)
        out = validation.nearest_zone(points, places, ["rung"], "point", "zone")
        rows = {(r["rung"], r["point"]): (r["nearest_km"], r["nearest_zone"]) for r in out.collect()}
        assert len(rows) == out.count() == 2 * 151 and rows["b", 999] == (None, None)
        assert plain.setdefault("rows", rows) == rows
        if most > 1:
            assert "Aggregate" not in plan_of(out).split("Join")[0]  # nothing is gathered by pairs of points and zones
    held = places.collect()
    for r in points.filter("lon is not null").collect():
        for rung in "ab":
            near = [validation_km(r, z) for z in held if z["rung"] == rung]
            assert abs(rows[rung, r["point"]][0] - min(near)) < 1e-9


def validation_km(p, z) -> float:
    rad = math.radians
    a = math.sin(rad(z["lat"] - p["lat"]) / 2) ** 2 + math.cos(rad(p["lat"])) * math.cos(rad(z["lat"])) * math.sin(rad(z["lon"] - p["lon"]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(a)))


def test_tiles_of_any_side_label_and_drain_alike(spark, monkeypatch):
    height = F.pmod(F.col("row") * 37 + F.col("col") * 61 + F.col("row") * F.col("col") * 7, F.lit(41)) * 1.0 + F.col("row") * 5.0
    px = spark.range(15 * 13).select(F.lit("s").alias("stack"), (F.col("id") / 13).cast("int").alias("row"), (F.col("id") % 13).cast("int").alias("col")).filter("row <> 4 or col <> 4").withColumn("z", height)
    px = px.withColumns({"row": F.col("row") - 3, "seen": F.lit(None).cast("int")})
    labels, drained = {}, {}
    for side in (3, 5, 64):
        monkeypatch.setattr(raster, "TILE", side)
        zones_, flow = raster.label_zones(px, ["stack"], F.col("z") % 3 < 2), raster.flow_accumulation(px, ["stack"], "z")
        assert zones_.columns == [*px.columns, "zone"] and dict(flow.dtypes) == {"stack": "string", "row": "int", "col": "int", "accum": "bigint"}
        assert labels.setdefault("all", sorted(map(str, zones_.collect()))) == sorted(map(str, zones_.collect()))
        assert drained.setdefault("all", sorted(map(tuple, flow.collect()))) == sorted(map(tuple, flow.collect()))
    low = {(r["row"], r["col"]): r for r in raster.flow_receivers(px, ["stack"], "z").collect()}
    plain = dict.fromkeys(low, 0)
    for at in low:
        while at is not None:
            plain[at] += 1
            at = (low[at]["to_row"], low[at]["to_col"]) if low[at]["to_row"] is not None else None
    assert {(r, c): n for _, r, c, n in drained["all"]} == plain and max(plain.values()) > 9


def test_pixels_are_shuffled_once_to_label_and_drain(spark, monkeypatch):
    plans, plain = [], raster.stored
    monkeypatch.setattr(raster, "stored", lambda df, name="step": (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, name))[1])
    px = spark.range(3000).select(F.lit("s").alias("stack"), (F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col")).withColumn("z", F.col("row") * 2.0 + F.col("col") % 7)
    for out in (raster.label_zones(px, ["stack"], F.col("z") > 9), raster.flow_accumulation(px, ["stack"], "z")):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4 and sum(p.count("Exchange") for p in plans) == 2


def test_a_tree_is_asked_for_many_levels_without_copies(spark, monkeypatch):
    base = [("s", f"k{i:02}", "KEEP", i, i + 1, 0.1, 0.9, 90.0) for i in range(29) if i % 10 != 9]
    good = [("s", "g0", "CONCERN", 9, 10, 0.1, 0.9, 50.0), ("s", "g1", "CONCERN", 3, 25, 0.1, 0.9, 40.0)]
    bad = [("s", f"b{i:02}", "CONCERN", i % 30, i * 7 % 30, 0.9, 0.9, 31.0 + i) for i in range(60)]
    rows = base + good + good[:1] + bad + bad[11:12]  # a row that is there twice is chosen once, and told twice if it fails
    df = spark.createDataFrame([(*r, "", None) for r in rows], "stack string, product string, decision string, ref long, sec long, r2 double, coherence double, pct double, reasons string, bperp double")
    want, label = [], [i // 10 for i in range(30)]
    for r in sorted(good + good[:1] + bad + bad[11:12], key=lambda r: -r[7]):
        a, b = label[r[3]], label[r[4]]
        if a != b:
            want.append((r[1], r[1][0] == "g"))
            if r[1][0] == "g":
                label = [a if x == b else x for x in label]
    written, plain = [], forest.stored
    monkeypatch.setattr(forest, "stored", lambda d, name="step": (out := plain(d, name), written.append((out.count(), name)))[0])
    out = network.select_bridges(df)
    assert sorted((r["product"], r["selected"]) for r in out.collect()) == sorted(want) and sum(s for _, s in want) == 2
    assert max(written)[0] <= len(rows), max(written)  # not the tree for each level


def test_zones_of_masks_are_those_of_each_mask_and_pixels_move_once(spark, monkeypatch):
    px = spark.range(2 * 400).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("stack"), (F.col("id") / 2 % 400 / 20).cast("int").alias("row"), (F.floor(F.col("id") / 2) % 20).cast("int").alias("col"), (F.col("id") * 7919 % 101).alias("v")
    )
    masks = [F.col("v") < 60, F.col("v") < 0, F.col("v") % 3 != 0, F.when(F.col("v") > 5, F.col("v") < 90)]
    want = set()
    for k, m in enumerate(masks):
        plain = raster.label_zones(px, ["stack"], m).groupBy("stack", "zone").agg(F.count("*").alias("n"), F.avg("row").alias("row"), F.avg("col").alias("col"))
        want |= {(r["stack"], k, r["zone"], r["n"], r["row"], r["col"]) for r in plain.collect()}
    assert len({k for _, k, *_ in want}) == 3
    for side in (64, 5, 3):
        monkeypatch.setattr(raster, "TILE", side)
        got = [(r["stack"], r["mask"], r["zone"], r["n"], r["row"], r["col"]) for r in raster.zones_of_masks(px, ["stack"], masks).collect()]
        assert len(got) == len(want) and set(got) == want, side
    shuffled, stored = [], raster.stored
    monkeypatch.setattr(raster, "TILE", 64)
    monkeypatch.setattr(raster, "stored", lambda df, name="step": (shuffled.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hash")), stored(df, name))[1])
    raster.zones_of_masks(px, ["stack"], masks).collect()
    assert shuffled == [1]


def test_many_points_of_a_cell_are_asked_together(spark, monkeypatch):
    at = lambda n, a, b: spark.range(n).select(F.col("id").alias("k"), (F.col("id") * a % 9973 / 9973.0 + 75.0).alias("lon"), (F.col("id") * b % 9967 / 9967.0 + 33.0).alias("lat"))
    points, places = at(3000, 7919, 6007).withColumnRenamed("k", "point"), at(900, 317, 419).withColumnRenamed("k", "zone").withColumn("rung", F.explode(F.array(F.lit("a"), F.lit("b"))))
    written, stored = {}, validation.stored
    monkeypatch.setattr(validation, "FEW", 4)
    monkeypatch.setattr(validation, "stored", lambda df, name="step": (out := stored(df, name), written.update({name: out.count()}))[0])
    rows = validation.nearest_zone(points, places, ["rung"], "point", "zone").collect()
    assert written["nearest-sights"] * 100 < 3000 and written["nearest-cells"] < 3000  # not cells of each point and group
    held = places.filter("rung = 'a'").collect()
    assert len(rows) == 2 * 3000
    for r in rows[::97]:
        assert abs(r["nearest_km"] - min(validation_km(r, z) for z in held)) < 1e-9


def test_covered_stretches_go_before_they_meet(spark, monkeypatch):
    at = [(0.137 * i + 0.0011 * j, 0.149 * j + 0.0013 * i) for i in range(10) for j in range(10)]  # no two edges on one line
    rings = squares(spark, [("d", k, 0, x, y) for k, (x, y) in enumerate(at)] + [("e", 999, 0, 0.0, 0.0), ("e", 998, 0, 1.03, 0.5)])
    written, stored = {}, areas.stored
    monkeypatch.setattr(areas, "stored", lambda df, name="step": (out := stored(df, name), written.update({name: out.filter("district = 'd'").count()}))[0])
    out = {r["district"]: (r["area"], r["length"]) for r in areas.enclosed_area(areas.union_boundary(rings, ["district"], "region", 1.0), ["district"]).collect()}
    xs, ys = (np.unique([v + d for v in c for d in (0.0, 2.0)]) for c in zip(*at, strict=True))
    held = np.zeros((len(xs) + 1, len(ys) + 1), bool)  # the cells between the lines of all edges, with a frame
    for x, y in at:
        held[np.searchsorted(xs, x) + 1 : np.searchsorted(xs, x + 2.0) + 1, np.searchsorted(ys, y) + 1 : np.searchsorted(ys, y + 2.0) + 1] = True
    inner, w, h = held[1:-1, 1:-1], np.diff(xs), np.diff(ys)
    length = ((held[1:, 1:-1] != held[:-1, 1:-1]) * h).sum() + ((held[1:-1, 1:] != held[1:-1, :-1]) * w[:, None]).sum()
    assert np.allclose(out["d"], ((inner * w[:, None] * h).sum(), length)) and np.allclose(out["e"], (8 - 0.97 * 1.5, 16 - 2 * (0.97 + 1.5)))
    assert written["union-pieces"] < 3000, written  # 20200 when covered edges are cut too
