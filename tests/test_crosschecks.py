"""Cross-checks of products and the manifest against plain versions."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions import physics as P
from talus.operators import crosscheck
from talus.sources import manifest

GRID = "g string, row int, col int, v double"


def grid(spark, seed, rows=9, cols=7, holes=0.2, missing=0.1):
    """Cells of two groups, some absent, some without a value."""
    r = random.Random(seed)
    cells = [(g, i, j, None if r.random() < missing else round(r.uniform(-40, 20), 3)) for g in "ab" for i in range(rows) for j in range(cols) if r.random() > holes]
    return spark.createDataFrame(cells, GRID), cells


def corr(x, y):
    x, y = np.array(x, float), np.array(y, float)
    return np.corrcoef(x, y)[0, 1] if len(x) > 1 and x.std() and y.std() else None


def test_exact_quantiles_match_numpy(spark):
    r = random.Random(3)
    rows = [(g, None if r.random() < 0.1 else float(r.randrange(12))) for g in "abc" for _ in range(r.randrange(1, 90))] + [("one", 4.5), ("none", None)]
    out = crosscheck.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p05": 0.05, "median": 0.5, "p90": 0.9}).collect()
    assert {x.g for x in out} == {"a", "b", "c", "one"}
    for x in out:
        v = [b for a, b in rows if a == x.g and b is not None]
        assert [x.p05, x.median, x.p90] == pytest.approx(list(np.quantile(v, [0.05, 0.5, 0.9])))


def test_slope_velocity_report_matches_plain(spark):
    r = random.Random(5)
    some = lambda a, b: None if r.random() < 0.1 else r.uniform(a, b)
    rows = [(g, some(-60, 20), some(-1, 1), some(0, 40)) for g in "ab" for _ in range(80)] + [("blind", -20.0, 0.1, 30.0), ("void", None, 0.5, 30.0)]
    out = {x.g: x for x in crosscheck.slope_velocity_report(spark.createDataFrame(rows, "g string, v double, c double, s double"), ["g"], "v", "c", "s").collect()}
    assert set(out) == {"a", "b", "blind"}
    for g in "ab":
        ok = [(v, c, s) for k, v, c, s in rows if k == g and None not in (v, c, s)]
        seen = [(v, v / c) for v, c, s in ok if abs(c) >= 0.3 and s >= 10.0]
        x = out[g]
        assert (x.n_valid, x.n_observed) == (len(ok), len(seen))
        assert (x.n_los_creep, x.n_slope_creep) == (sum(v < -15 for v, _, _ in ok), sum(w > 15 for _, w in seen))
        assert x.blind_share == pytest.approx(1 - len(seen) / len(ok))
        assert x.median_sensitivity == pytest.approx(np.median([abs(c) for _, c, _ in ok]))
        assert x.median_amplification == pytest.approx(np.median([abs(w) / abs(v) for v, w in seen if v < -15]))
        assert x.max_v_slope == pytest.approx(max(abs(w) for _, w in seen))
    assert (out["blind"].blind_share, out["blind"].max_v_slope, out["blind"].median_amplification) == (1.0, None, None)


def test_velocity_inspection_matches_numpy(spark):
    r = random.Random(29)
    rows = [(g, r.choice([None, 0.5, 0.9]), None if r.random() < 0.1 else r.uniform(-150, 90)) for g in "ab" for _ in range(60)] + [("dim", 0.1, 3.0), ("void", 0.9, None)]
    out = {(x.g, x["set"]): x for x in crosscheck.velocity_inspection(spark.createDataFrame(rows, "g string, coh double, v double"), ["g"], "v", "coh", 0.7, 100.0).collect()}
    assert set(out) == {("a", "all"), ("a", "coherent"), ("b", "all"), ("b", "coherent"), ("dim", "all")}
    for (g, kept), x in out.items():
        v = np.array([b for k, c, b in rows if k == g and b is not None and (kept == "all" or (c or 0) >= 0.7)])
        assert (x.n, x.n_fast) == (len(v), int((abs(v) > 100).sum()))
        assert [x.mean, x.std, x.p02, x.median, x.p98] == pytest.approx([v.mean(), v.std(), *np.quantile(v, [0.02, 0.5, 0.98])])


def test_delay_crosscheck_matches_plain(spark):
    r = random.Random(11)
    rows = [("s", e, i, j, r.uniform(2, 3), r.uniform(0.5, 0.9), 100.0 * i + r.random(), None if r.random() < 0.3 else r.uniform(-9, 9)) for e in (1, 4, 9) for i in range(8) for j in range(6) if r.random() > 0.3]
    rows.append(("alone", 1, 0, 0, 2.0, 0.7, 5.0, 1.0))
    df = spark.createDataFrame(rows, "g string, e int, row int, col int, zenith_m double, theta double, dem double, observed_mm double")
    out = {(x.ref, x.sec): x for x in crosscheck.delay_crosscheck(df, ["g"], "e", 2).collect()}
    assert set(out) == {(1, 4), (4, 9)}
    blocks = {}
    for _, e, i, j, *values in rows[:-1]:
        blocks.setdefault((e, i // 2, j // 2), []).append(values)
    mean = lambda k, n: np.mean([v[n] for v in blocks[k] if v[n] is not None]) if any(v[n] is not None for v in blocks[k]) else None
    for (ref, sec), x in out.items():
        both = [(i, j) for e, i, j in blocks if e == sec and (ref, i, j) in blocks]
        pred = [-(mean((sec, *b), 0) - mean((ref, *b), 0)) / np.sin(mean((sec, *b), 1)) * P.WAVELENGTH_M / (4 * np.pi) * 1000 for b in both]
        dem, seen = [mean((sec, *b), 2) for b in both], [mean((sec, *b), 3) for b in both]
        known = [(p, o) for p, o in zip(pred, seen, strict=True) if o is not None]
        assert (x.n_elev, x.n_obs) == (len(both), len(known))
        assert [x.r_elev, x.r_obs] == pytest.approx([corr(pred, dem), corr(*zip(*known, strict=True))])
        assert [x.least_mm, x.most_mm] == pytest.approx([min(pred), max(pred)])


def test_compare_methods_uses_the_same_pixels(spark):
    df, cells = grid(spark, 17, 10, 8)
    df = df.withColumn("ok", F.col("row") != 4).withColumn("gap", F.when(F.col("col") != 2, F.col("v") + F.col("row")))
    methods = {"same": F.col("v"), "twice": 2 * F.col("v") + 3, "gap": F.col("gap")}
    out = {(x.g, x.method): x for x in crosscheck.compare_methods(df, ["g"], methods, "twice", F.col("v"), F.col("ok"), 1.0).collect()}
    assert {m for _, m in out} == set(methods)
    for g in "ab":
        common = [(v, i) for k, i, j, v in cells if k == g and v is not None and i != 4 and j != 2]
        same, twice, gap = (out[g, m] for m in ("same", "twice", "gap"))
        assert same.n == twice.n == gap.n == len(common)
        v = np.array([a for a, _ in common])
        assert (same.std, twice.std, same.r_raw, same.rms) == pytest.approx((v.std(), 2 * v.std(), 1.0, 0.0))
        assert (same.reduction_pct, same.r_hp_hp) == pytest.approx((50.0, 1.0))
        assert gap.r_raw == pytest.approx(corr(v, v + np.array([i for _, i in common])))
        assert same.best_agreement and not twice.best_agreement  # a tie goes to the name that comes first
        assert sum(out[g, m].lowest_scatter for m in methods) == 1


def test_hazard_delta_of_two_velocities(spark):
    rows = [("g", 0, c, 0.8, -20.0, -20.0 if c < 3 else -5.0) for c in range(5)] + [("g", 2, 0, 0.8, None, -30.0), ("g", 3, 0, None, -40.0, -40.0), ("calm", 0, 0, 2.0, 1.0, 1.0)]
    out = {x.g: x for x in crosscheck.hazard_delta(spark.createDataFrame(rows, "g string, row int, col int, fs double, a double, b double"), ["g"], "fs", "a", "b").collect()}
    x = out["g"]
    assert (x.n_common, x.creep_a, x.creep_b, x.high_a, x.high_b, x.zones_a, x.zones_b) == (6, 6, 5, 5, 4, 1, 1)
    assert (x.creep_iou, x.high_iou) == pytest.approx((4 / 7, 3 / 6))
    assert (out["calm"].zones_a, out["calm"].high_iou, out["calm"].r) == (0, None, None)


def test_least_around_and_standing_of_scars_match_plain(spark):
    df, cells = grid(spark, 23)
    df = df.withColumnRenamed("v", "change").withColumn("change", F.round(F.col("change") / 100, 4))
    have = {(g, i, j): round(v / 100, 4) for g, i, j, v in cells if v is not None}
    scars = [("a", k, k % 9, k % 7) for k in range(20)] + [("b", 50, 3, 3), ("b", 51, 400, 3)]
    out = {(x.g, x.scar): x for x in crosscheck.scar_standing(df, spark.createDataFrame(scars, "g string, scar int, row int, col int"), ["g"], "scar", [0, 1, 3]).collect()}
    assert len(out) == len(scars)
    for g, k, row, col in scars:
        mine = sorted(v for (h, _, _), v in have.items() if h == g)
        inside = row <= 8
        near = {r: [v for (h, i, j), v in have.items() if inside and h == g and max(abs(i - row), abs(j - col)) <= r] for r in (0, 1, 3)}
        first = next((r for r in (0, 1, 3) if near[r]), None)
        x = out[g, k]
        assert x.radius == first
        if first is None:
            assert (x.grade, x.percentile, x.scar_change) == ("NO DATA", None, None)
            continue
        pct = 100 * sum(v < min(near[first]) for v in mine) / len(mine)
        assert (x.scar_change, x.percentile) == pytest.approx((min(near[first]), pct))
        assert x.grade == ("DETECTED" if pct <= 5 else "MARGINAL" if pct <= 10 else "NOT DETECTED")
        assert (x.n_cells, x.deficit) == (len(mine), pytest.approx(np.median(mine) - min(near[first])))


def test_library_watch_and_product_stream(spark):
    d = lambda k: dt.date(2031, 5, k)
    scenes = [("x", d(1), 7, "A"), ("x", d(9), 7, "B"), ("x", d(9), 8, "A"), ("x", d(4), 8, "C"), ("bare", d(2), 1, "A"), ("still", d(3), 1, "A")]
    library = [("x", d(4)), ("x", d(2)), ("still", d(3)), ("elsewhere", d(1))]
    out = {r.g: r for r in crosscheck.library_watch(spark.createDataFrame(scenes, "g string, t date, p int, u string"), spark.createDataFrame(library, "g string, t date"), ["g"], "t", "p", "u").collect()}
    assert (out["x"].library_through, out["x"].newest, out["x"].n_new, out["x"].new_units) == (d(4), d(9), 2, ["A", "B"])
    assert [tuple(p) for p in out["x"].per_path] == [(7, d(9)), (8, d(9))]
    assert (out["bare"].library_through, out["bare"].n_new, out["still"].n_new, out["still"].new_units) == (None, 1, 0, [])
    products = spark.createDataFrame([("x", d(1), "L2"), ("x", d(8), "L2"), ("x", d(8), "L1"), ("x", None, "L2"), ("y", d(1), None)], "g string, t date, level string")
    seen = {r.g: r for r in crosscheck.product_stream(products, ["g"], "t", "level", "L2", "2031-05-05").collect()}
    assert (seen["x"].n_products, seen["x"].n_wanted, seen["x"].n_new_dates, seen["x"].stream_started) == (4, 3, 1, True)
    assert (seen["y"].n_wanted, seen["y"].stream_started) == (0, False)


def test_manifest_batches_lookup_and_cover(spark, tmp_path):
    hours = [("000000", "120000", "DESC_path5_frame6"), ("120000", "200000", "ASC_path7_frame8")]
    name = lambda day, hms, day2: f"S1_202803{day:02}T{hms}_202803{day2:02}T{hms}_VV"
    early, noon, late = name(1, "115959", 13), name(1, "120000", 13), name(13, "230000", 25)
    held = manifest.Manifest(spark, f"{tmp_path}/manifest")
    assert held.load().count() == 0
    old = manifest.bootstrap(spark.createDataFrame([(early,), (noon,), (late,), ("nonsense",)], "product string"), hours)
    assert held.update(old) == 4 and held.update(old) == 0
    files = [("Site_ASC_path1_frame2", f"{late}.zip"), ("Site_odd", f"{noon}.zip"), ("Other_ASC_path9_frame9", f"{noon}.zip"), ("Site_desc_path3_frame4", None), ("Site_ASCENDING_path7_frame8", "new.zip")]
    jobs = manifest.entries_of_jobs(spark.createDataFrame(files, "name string, file string"), "Site")
    assert held.update(jobs) == 2 and held.update(jobs) == 0
    got = {x["product"]: x for x in held.load().collect()}
    assert {k: (x.stack, x.source) for k, x in got.items()} == {
        early: ("DESC_path5_frame6", "legacy_bootstrap"), noon: ("ASC_path7_frame8", "legacy_bootstrap"), late: ("ASC_path1_frame2", "metadata"),
        "nonsense": ("unknown", "legacy_bootstrap"), "new": ("ASC_path7_frame8", "metadata"),
    }
    assert (got[late].direction, got[late].path, got[late].frame, got["nonsense"].path) == ("ASCENDING", 1, 2, None)
    asked = spark.createDataFrame([(late,), (name(2, "130000", 14),), ("other",)], "product string")
    assert [x.stack for x in manifest.lookup(asked, held.load(), hours).orderBy("product").collect()] == ["ASC_path7_frame8", "ASC_path1_frame2", "unknown"]
    epochs = spark.createDataFrame([("DESC_path5_frame6", dt.date(2028, 3, 1)), ("DESC_path5_frame6", dt.date(2028, 3, 13)), ("ASC_path7_frame8", dt.date(2028, 3, 1))], "stack string, date date")
    assert [x["product"] for x in manifest.covered(held.load(), epochs).collect()] == [early]


def test_cross_checks_of_nothing(spark):
    empty, _ = spark.createDataFrame([], GRID), None
    assert crosscheck.exact_quantiles(empty, ["g"], "v", {"m": 0.5}).count() == 0
    assert crosscheck.compare_methods(empty, ["g"], {"v": F.col("v")}, "v", F.col("v"), F.col("v") > 0, 1.0).count() == 0
    assert crosscheck.hazard_delta(empty.withColumn("fs", F.col("v")), ["g"], "fs", "v", "v").count() == 0
    assert crosscheck.scar_standing(empty.withColumnRenamed("v", "change"), empty.drop("v").withColumn("scar", F.lit(1)), ["g"], "scar", [1]).count() == 0
