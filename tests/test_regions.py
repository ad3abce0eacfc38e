"""Merge trees, greedy merging, bridges, masks, distances, areas, common grids, projections and window stores against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions import geo
from talus.operators import areas, exposure, forest, grids, network, validation, zones
from talus.operators import rain as O
from talus.sources.windows import WindowStore, missing_windows


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1.0, math.sqrt(h)))


def rings(spark, *rows):
    """(group, part, [vertices])"""
    return spark.createDataFrame([(g, p, 0, [(float(x), float(y)) for x, y in v]) for g, p, v in rows], "g string, part string, ring int, vertices array<struct<lon:double,lat:double>>")


# -- merge trees ------------------------------------------------------------------------------


def parts(n, edges, level):
    label = list(range(n))
    for _ in range(n):
        for a, b, h in edges:
            if h < level:
                label[a] = label[b] = min(label[a], label[b])
    return label


def test_merge_forest_tells_the_parts_at_every_level(spark):
    r = random.Random(7)
    edges = [(r.randrange(60), r.randrange(60), round(r.random() * 20) / 20) for _ in range(110)]
    chain = [(i, i + 1, (40 - i) / 10) for i in range(40)]  # each part's lowest edge leads to a younger one
    rows = [("x", a, b, h) for a, b, h in edges] + [("y", a, b, float(h)) for a, b, h in chain]
    df = spark.createDataFrame(rows, "g string, a int, b int, height double")
    tree = forest.merge_forest(df, ["g"]).persist()
    assert tree.groupBy("g", "node").count().filter("count > 1").isEmpty()
    levels = [0.0, 0.05, 0.3, 0.5, 1.1, 2.05, 9.0]
    asked = spark.createDataFrame([(g, i, v) for g, n in (("x", 60), ("y", 41)) for i in range(n) for v in levels], "g string, node int, level double")
    got = {(r.g, r.node, r.level): r.eldest for r in forest.eldest_at(asked, tree, ["g"], "node", "level").collect()}
    for g, n, es in (("x", 60, edges), ("y", 41, chain)):
        for v in levels:
            assert [got[g, i, v] for i in range(n)] == parts(n, es, v), (g, v)
    assert forest.merge_forest(df.limit(0), ["g"]).isEmpty()


def test_zones_at_levels_match_labels_at_each(spark):
    r = np.random.default_rng(4)
    z = np.round(r.random((14, 11)), 1)  # many ties
    z[r.random(z.shape) < 0.1] = np.nan
    df = spark.createDataFrame([("g", i, j, None if np.isnan(z[i, j]) else float(z[i, j])) for i in range(14) for j in range(11) if (i, j) != (3, 3)], "g string, row int, col int, z double")
    z[3, 3] = np.nan
    levels = [0.0, 0.3, 0.55, 2.0]
    got = {}
    for c in forest.zones_at_levels(df, ["g"], F.col("z"), levels, 2).collect():
        got.setdefault((c["at"], c.zone), set()).add((c.row, c.col))
    want = set()
    for v in levels:
        on = {(i, j) for i in range(14) for j in range(11) if z[i, j] < v}
        while on:
            todo, seen = [on.pop()], set()
            while todo:
                i, j = todo.pop()
                seen.add((i, j))
                for n in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                    if n in on:
                        on.remove(n)
                        todo.append(n)
            if len(seen) >= 2:
                want.add((v, frozenset(seen)))
    assert {(v, frozenset(cells)) for (v, _), cells in got.items()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_bridges_are_those_of_a_sequential_choice(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(140):
        decision = r.choice(["KEEP", "CONCERN", "CONCERN", "QUARANTINE"])
        rows.append((r.choice("st"), f"p{k:03}", decision, r.randrange(25), r.randrange(25), r.choice([None, 0.1, 0.4, 0.9]), r.choice([None, 0.5, 0.9]), r.choice([None, 10.0, 60.0, 80.0]), r.choice(["", "", "RESCUED_FOR_CONNECTIVITY (was CONCERN)"]), None))
    df = spark.createDataFrame(rows, "stack string, product string, decision string, ref long, sec long, r2 double, coherence double, pct double, reasons string, bperp double")
    want = set()
    for stack in "st":
        own = [x for x in rows if x[0] == stack]
        label = list(range(25))

        def join(a, b, label=label):
            old, new = label[b], label[a]
            label[:] = [new if x == old else x for x in label]

        candidate = lambda x: x[2] == "CONCERN" or (x[2] == "KEEP" and "RESCUED" in x[8])
        for x in own:
            if x[2] == "KEEP" and not candidate(x):
                join(x[3], x[4])
        for x in sorted((x for x in own if candidate(x)), key=lambda x: (1.0 if x[7] is None else -x[7], 1.0 if x[5] is None else x[5], x[3], x[4], x[1])):
            if label[x[3]] != label[x[4]]:
                failure = "atmos_r2" if (x[5] or 0) > 0.5 else "coherence" if x[6] == 0.5 else "surviving_pct" if x[7] == 10.0 else None
                want.add((stack, x[1], failure is None, failure))
                if failure is None:
                    join(x[3], x[4])
    assert {tuple(x) for x in network.select_bridges(df).collect()} == want and len(want) > 15


@pytest.mark.parametrize("order", ["id", "turned"])
def test_greedy_merging_is_that_of_a_sequential_choice(spark, order):
    r = random.Random(3)
    rows = [("x", i, (i * 37) % 211, 75 + r.random() * 0.1, 33 + r.random() * 0.1) for i in range(200)]
    rows += [("y", i, -i, 75 + i * 0.004, 33.0) for i in range(30)]  # a chain
    z = spark.createDataFrame(rows, "site string, id int, turned int, lon double, lat double")
    got = {(x.site, x.id): x.seed for x in zones.merge_groups(z, ["site"], [order], 0.01).collect()}
    names = {(x.site, x.id): x.node for x in z.select("site", "id", F.xxhash64(order).alias("node")).collect()}
    for site in "xy":
        own = sorted((x for x in rows if x[0] == site), key=lambda x: x[1] if order == "id" else x[2])
        free = dict.fromkeys(x[1] for x in own)
        for x in own:
            if x[1] in free:
                for y in own[own.index(x) :]:
                    if y[1] in free and abs(y[3] - x[3]) < 0.01 and abs(y[4] - x[4]) < 0.01:
                        del free[y[1]]
                        assert got[site, y[1]] == names[site, x[1]], (site, y)
    assert zones.merge_groups(z.limit(0), ["site"], ["id"]).count() == 0


# -- nearest zones ----------------------------------------------------------------------------


def test_nearest_zones_in_dense_areas_and_far_north(spark, monkeypatch):
    monkeypatch.setattr(validation, "LEAF", 3)
    r = random.Random(11)
    zs = [("d", 75 + r.random() * 1e-4, 33 + r.random() * 1e-4) for _ in range(60)] + [("d", 75.0, 33.0)] * 9
    zs += [("n", r.uniform(-180, 180), r.uniform(75, 85)) for _ in range(60)] + [("n", 179.9, 80.0), ("s", 10.0, -60.0)]
    zs = [(g, i, a, b, r.random() * 3) for i, (g, a, b) in enumerate(zs)] + [("n", 999, None, 1.0, 1.0)]
    pts = [("d", 75 + r.random() * 2e-4, 33 + r.random() * 2e-4) for _ in range(40)] + [("d", -100.0, -20.0)]
    pts += [("n", r.uniform(-180, 180), r.uniform(74, 86)) for _ in range(60)] + [("n", -179.9, 80.0), ("s", 0.0, 0.0), ("e", 0.0, 0.0), ("n", None, 1.0)]
    pts = [(g, i, a, b) for i, (g, a, b) in enumerate(pts)]
    z = spark.createDataFrame(zs, "g string, zone int, lon double, lat double, radius double")
    p = spark.createDataFrame(pts, "g string, point int, lon double, lat double")
    near = {x.point: x for x in validation.nearest_zone(p, z, ["g"], "point", "zone").collect()}
    edge = {x.point: x for x in validation.nearest_edge(p, z, ["g"], "point", "radius").collect()}
    assert len(near) == len(edge) == len(pts)
    for g, i, a, b in pts:
        own = [(km((a, b), (x, y)), k, rad) for h, k, x, y, rad in zs if h == g and x is not None] if a is not None else []
        if not own:
            assert near[i].nearest_km is None and edge[i].edge_km is None
            continue
        assert near[i].nearest_km == pytest.approx(min(own)[0], abs=1e-6)
        assert edge[i].edge_km == pytest.approx(min(d - rad for d, _, rad in own), abs=1e-6)


# -- polygons and grids -----------------------------------------------------------------------

STAR = [(2.0, 1.0), (9.0, 1.5), (6.0, 4.0), (9.5, 8.7), (5.0, 6.0), (1.2, 9.1)]
HOLE = [(3.0, 3.0), (5.0, 3.0), (5.0, 5.0), (3.0, 5.0)]


def odd(ring, x, y):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            inside = not inside
    return inside


@pytest.mark.parametrize("dy", [0.25, -0.25])
def test_masks_hold_what_a_ray_finds(spark, dy):
    grid = grids.Grid(0.0, 0.0 if dy > 0 else 10.0, 0.3, dy, 40, 30)
    tiny, far = [(7.01, 7.01), (7.03, 7.01), (7.02, 7.04)], [(50.0, 50.0), (51.0, 50.0), (50.0, 51.0)]
    rows = rings(spark, ("star", "a", STAR), ("star", "a", HOLE), ("star", "b", [(0.0, 0.0), (2.5, 0.0), (0.0, 2.5)]), ("tiny", "a", tiny), ("far", "a", far), ("wide", "a", [(-5.0, -5.0), (50.0, -5.0), (20.0, 50.0)]))
    got = {}
    for c in grids.polygon_mask(rows, exposure.polygon_edges(rows, ["g", "part"]), ["g"], "part", grid).collect():
        assert (c.row, c.col) not in got.setdefault(c.g, set())
        got[c.g].add((c.row, c.col))
    middles = {(r, c): (0.3 * (c + 0.5), grid.y0 + (r + 0.5) * dy) for r in range(40) for c in range(30)}
    star = {k for k, (x, y) in middles.items() if (odd(STAR, x, y) != odd(HOLE, x, y)) or odd([(0.0, 0.0), (2.5, 0.0), (0.0, 2.5)], x, y)}
    assert got["star"] == star and len(star) > 100
    assert got["tiny"] == {(int((7.02 - grid.y0) / dy), 23)} and "far" not in got
    assert got["wide"] == {k for k, (x, y) in middles.items() if odd([(-5.0, -5.0), (50.0, -5.0), (20.0, 50.0)], x, y)}


def test_zonal_series_needs_enough_cells(spark):
    mask = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("b", 5, 5)], "g string, row int, col int")
    layers = spark.createDataFrame([("x", 0, 0, 1.0), ("x", 0, 1, 3.0), ("x", 0, 2, None), ("x", 9, 9, 8.0), ("y", 0, 0, 2.0)], "layer string, row int, col int, v double")
    got = {(r.g, r.layer): (r.n_cells, round(r.valid_share, 3), r.v, r.relative) for r in grids.zonal_series(mask, layers, ["g"], ["layer"], "v").collect()}
    assert got == {("a", "x"): (3, 0.667, 2.0, -2.0), ("a", "y"): (3, 0.333, None, None)}


def test_distance_transform_matches_brute_force(spark):
    r = np.random.default_rng(6)
    rows = [("a", i, j, bool(r.random() < 0.04)) for i in range(3, 30) for j in range(-4, 25) if r.random() < 0.8]
    rows += [("b", i, 0, i in (2, 7)) for i in range(10)] + [("c", 0, j, False) for j in range(4)] + [("a", 100, 3, None)]
    df = spark.createDataFrame(rows, "g string, row int, col int, on boolean")
    got = {(x.g, x.row, x.col): x.square for x in grids.distance_transform(df, ["g"], F.col("on")).collect()}
    assert len(got) == len(rows)
    for g, i, j, _ in rows:
        want = min(((i - p) ** 2 + (j - q) ** 2 for h, p, q, on in rows if h == g and on), default=None)
        assert got[g, i, j] == want, (g, i, j)
    every = grids.distance_transform(df.filter("g = 'b'"), ["g"], F.col("on"), every=True).collect()
    assert {(x.row, x.square) for x in every} == {(i, min((i - 2) ** 2, (i - 7) ** 2)) for i in range(10)}


# -- areas and common grids -------------------------------------------------------------------


def test_union_area_of_overlapping_rings(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows = rings(
        spark, ("two", "a", square(0, 0, 4)), ("two", "b", square(2, 1, 4)[::-1]), ("inside", "a", square(0, 0, 9)), ("inside", "b", square(2, 2, 3)), ("apart", "a", square(0, 0, 1)),
        ("apart", "b", square(5, 5, 2)), ("cross", "a", [(0, 3), (10, 3), (10, 5), (0, 5)]), ("cross", "b", [(4, 0), (6, 0), (6, 9), (4, 9)]), ("ring", "a", [(0, 0), (6, 0), (6, 1), (0, 1)]),
        ("ring", "b", [(0.2, 0.5), (1, 0.5), (1, 6), (0.2, 6)]), ("ring", "c", [(0.1, 5), (6.5, 5), (6.5, 6.2), (0.1, 6.2)]), ("ring", "d", [(5, 0.3), (5.9, 0.3), (5.9, 5.9), (5, 5.9)]), ("alone", "a", STAR),
    )
    got = {x.g: (x.area, x.length) for x in areas.enclosed_area(areas.union_boundary(rows, ["g"], "part", 1.5), ["g"]).collect()}
    star = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(STAR, STAR[1:] + STAR[:1], strict=True))) / 2
    want = {"two": 16 + 16 - 6, "inside": 81.0, "apart": 5.0, "cross": 20 + 18 - 4, "alone": star}
    for g, area in want.items():
        assert got[g][0] == pytest.approx(area), g
    assert got["apart"][1] == pytest.approx(12) and got["inside"][1] == pytest.approx(36)
    cells = [(0.005 + 0.01 * i, 0.005 + 0.01 * j) for i in range(700) for j in range(660)]
    boxes = [(0, 0, 6, 1), (0.2, 0.5, 1, 6), (0.1, 5, 6.5, 6.2), (5, 0.3, 5.9, 5.9)]  # a hole in the middle
    assert got["ring"][0] == pytest.approx(sum(any(a < x < c and b < y < d for a, b, c, d in boxes) for x, y in cells) / 10_000, rel=2e-3)


def test_common_grids_tell_why_there_is_none(spark):
    g = [("ok", 1, 0.0, 100.0, 80.0, 10.0, 10.0, 1), ("ok", 2, 20.0, 90.0, 100.0, 0.0, 10.0, 1), ("ok", 3, 25.0, 90.0, 100.0, 0.0, 10.0, 1), ("mixed", 1, 0.0, 10.0, 10.0, 0.0, 1.0, 1), ("mixed", 2, 0.0, 10.0, 10.0, 0.0, 2.0, 1)]
    g += [("apart", 1, 0.0, 10.0, 10.0, 0.0, 1.0, 1), ("apart", 2, 50.0, 10.0, 60.0, 0.0, 1.0, 1), ("off", 1, 0.0, 10.0, 10.0, 0.0, 1.0, 1)]
    df = spark.createDataFrame(g, "s string, k int, left double, top double, right double, bottom double, res double, epsg int")
    area = spark.createDataFrame([("ok", 33.0, 33.0, 58.0, 58.0), ("mixed", 0.0, 0.0, 9.0, 9.0), ("apart", 0.0, 0.0, 99.0, 99.0), ("off", 500.0, 500.0, 600.0, 600.0)], "s string, minx double, miny double, maxx double, maxy double")
    got = {(x.s, x.k): tuple(x)[8:] for x in grids.common_grid(df, ["s"], area, 5.0, "k").collect()}
    assert got["ok", 1] == ("ok", 30.0, 60.0, 3, 3, 3, 4) and got["ok", 2] == ("ok", 30.0, 60.0, 3, 3, 1, 3)
    assert got["ok", 3] == ("misaligned", *[None] * 6)
    assert {got[k][0] for k in got if k[0] == "mixed"} == {"mixed"} and {got[k][0] for k in got if k[0] in ("apart", "off")} == {"apart"}


def test_projection_goes_forth_and_back(spark):
    pts = spark.createDataFrame([(float(a), float(b)) for a in (72.5, 74.1, 75.0, 77.9) for b in (0.0, 12.3, 33.5, 60.0, 79.0)], "lon double, lat double")
    e, n = geo.lonlat_to_utm(F.col("lon"), F.col("lat"), 43)
    there = pts.withColumns({"e": e, "n": n})
    lon, lat = geo.utm_to_lonlat(F.col("e"), F.col("n"), 43)
    for x in there.withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(x.lon - x.lon2) < 3e-7 and abs(x.lat - x.lat2) < 1e-7
        if x.lon == 75.0:
            assert x.e == pytest.approx(500_000.0)
    one = there.filter("lon = 75.0 and lat = 60.0").first()
    assert one.n == pytest.approx(6_651_411.2, abs=1.0)  # arc of the meridian to 60 degrees, times 0.9996


def test_freezing_share_matches_a_count(spark):
    r = random.Random(5)
    heights = [("a", r.uniform(500, 4000)) for _ in range(300)] + [("a", 0.0), ("a", -9999.0), ("a", None), ("b", 1000.0)]
    days = [("a", d, r.uniform(-15, 10), r.uniform(-5, 25)) for d in range(40)] + [("a", 90, None, 5.0), ("b", 1, -1.0, 1.0), ("c", 1, -1.0, 1.0)]
    h = spark.createDataFrame(heights, "site string, h double")
    d = spark.createDataFrame(days, "site string, day int, tmin_c double, tmax_c double")
    known = {s: [x for t, x in heights if t == s and x is not None and x > -1000 and x != 0] for s in "abc"}
    for x in grids.freezing_share(h, d, ["site"], "h").collect():
        own = known[x.site]
        if x.tmin_c is None or not own:
            assert x.share is None
            continue
        z = sum(own) / len(own)
        shift = lambda v, z=z: 6.5 * (v - z) / 1000
        assert x.share == pytest.approx(sum(x.tmin_c - shift(v) < 0 < x.tmax_c - shift(v) for v in own) / len(own))


def test_exceedance_within_the_day(spark):
    steps = [("s", 86400 - 1800, 10.0), ("s", 86400, 20.0), ("s", 86400 + 1800, 4.0), ("s", 86400 + 6 * 3600, 8.0)]
    df = spark.createDataFrame(steps, "s string, slot long, rate_mm_h double")
    got = {x.date.isoformat(): x.max_e for x in O.day_exceedance(df, ["s"], "slot", 3.0, 0.5, (0.5, 1.0, 12.0)).collect()}
    of = lambda mm, h: mm / (h * 3.0 * h**-0.5)
    assert got["1970-01-01"] == pytest.approx(max(of(5.0, h) for h in (0.5, 1.0, 12.0)))
    assert got["1970-01-02"] == pytest.approx(max(of(10.0, 0.5), of(12.0, 1.0), of(16.0, 12.0)))


# -- windows ----------------------------------------------------------------------------------


def test_missing_windows(spark):
    asked = [("k", 0, 10), ("k", 5, 20), ("k", 20, 25), ("k", 40, 50), ("k", 60, 60), ("l", 0, 3), ("k", 44, 46)]
    held = [("k", 3, 6), ("k", 6, 8), ("k", 24, 42), ("m", 0, 99), ("k", 45, None)]
    frame = lambda rows: spark.createDataFrame(rows, "key string, start int, end int")
    got = sorted(tuple(r) for r in missing_windows(frame(asked), frame(held), ["key"]).collect())
    assert got == [("k", 0, 3), ("k", 8, 24), ("k", 42, 50), ("l", 0, 3)]
    assert missing_windows(frame(asked), frame(asked), ["key"]).isEmpty()


def test_window_store_fetches_once(spark, tmp_path):
    store = WindowStore(spark, str(tmp_path / "w"), ["key"], "key string, t int, v double", "t", "int")
    calls = []

    def fetch(windows):
        calls.append(sorted((r.key, r.start, r.end) for r in windows.collect()))
        # a source that gives more than it is asked for
        return windows.select("key", F.explode(F.sequence(F.col("start") - 1, F.col("end") + 1)).alias("t")).withColumn("v", F.col("t") * 2.0)

    ask = lambda *rows: store.ensure(spark.createDataFrame(rows, "key string, start int, end int"), fetch)
    assert ask(("k", 0, 5), ("k", 3, 8), ("l", 2, 4)).count() == 2
    assert ask(("k", 1, 7)).count() == 0 and len(calls) == 1
    assert [tuple(r) for r in ask(("k", 6, 12), ("k", 8, 9)).select("key", "start", "end").collect()] == [("k", 8, 12)]
    assert calls == [[("k", 0, 8), ("l", 2, 4)], [("k", 8, 12)]]
    # an attempt that broke off behind its rows
    spark.createDataFrame([("k", 30, 1.0, "broken")], "key string, t int, v double, attempt string").write.mode("append").parquet(str(tmp_path / "w" / "rows"))
    rows = sorted(tuple(r) for r in store.rows().collect())
    assert rows == [("k", t, 2.0 * t) for t in range(12)] + [("l", t, 2.0 * t) for t in range(2, 4)]
