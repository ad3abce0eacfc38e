"""Readers, sinks and streams on small files."""

import json
import random
from datetime import date, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from talus.functions import rain as R
from talus.operators import rain as O
from talus.sources import files
from talus.streaming import rain as S

A, B = R.THRESHOLDS["nwhimalaya"]


def test_daily_csv_defaults(spark, tmp_path):
    (tmp_path / "d.csv").write_text("date,rain_mm,tmin_c\n2025-07-01,1.5,-2\n2025-07-02,,x\n")
    got = files.read_daily(spark, str(tmp_path / "d.csv")).orderBy("date").collect()
    assert (got[0].rain_mm, got[0].snowmelt_mm, got[0].tmin_c, got[0].tmax_c) == (1.5, 0.0, -2.0, None)
    assert (got[1].date, got[1].rain_mm, got[1].tmin_c) == (date(2025, 7, 2), None, None)


def test_alert_files_of_either_key(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"alerts": [{"id": 1, "centroid_lonlat": [75.1, 33.2]}]}))
    (tmp_path / "z.json").write_text(json.dumps({"zones": [{"id": 2, "n_looks": 3, "centroid_lonlat": [75.1, 33.2]}]}))
    a, z = (files.read_alerts(spark, str(tmp_path / f"{k}.json")).collect()[0] for k in "az")
    assert (a.id, a.n_looks, a.lon, z.id, z.n_looks, z.lat) == (1, 1, 75.1, 2, 3, 33.2)


def test_geojson_and_kml(spark, tmp_path):
    ring = [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
    feats = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [75.5, 33.5]}, "properties": {"name": "n", "date": "2025-08-26", "depth": "3 m"}},
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, [[0.5, 0.5], [1, 0.5], [1, 1]]]}, "properties": {}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, "properties": {}},
    ]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": feats}))
    p = files.read_points(spark, str(tmp_path / "g.json")).collect()
    assert len(p) == 1 and (p[0].lon, p[0].lat, p[0].name, p[0].date, p[0].extra) == (75.5, 33.5, "n", date(2025, 8, 26), {"depth": "3 m"})
    r = files.read_polygons(spark, str(tmp_path / "g.json")).collect()
    assert sorted((x.feature, x.ring, len(x.vertices)) for x in r) == [(1, 0, 5), (2, 0, 5), (2, 1, 5)]
    (tmp_path / "k.kml").write_text('<kml><Document><Placemark><name>a</name><Polygon><outerBoundaryIs><LinearRing><coordinates>75.0,33.0,0 75.1,33.0,0 75.1,33.1,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark><Placemark><name>line</name></Placemark></Document></kml>')
    k = files.read_kml(spark, str(tmp_path / "k.kml")).collect()
    assert len(k) == 1 and k[0].vertices[2].lat == 33.1


def test_events_are_checked(spark, tmp_path):
    ok = {"name": "a", "date": "2025-01-01", "lat": 33.0, "lon": 75.0, "deaths": 1, "sources": [{"label": "x", "url": "u"}]}
    (tmp_path / "e.json").write_text(json.dumps([ok, {**ok, "name": "b", "deaths": -1}, {**ok, "name": "c", "sources": []}, {**ok, "name": "c", "lat": None}]))
    bad = {(r.name, tuple(r.broken)) for r in files.event_violations(files.read_events(spark, str(tmp_path / "e.json"))).collect()}
    assert bad == {("b", ("negative_count",)), ("c", ("no_source", "duplicate_name")), ("c", ("no_place", "duplicate_name"))}


def test_float_grids(spark, tmp_path):
    np.array([[1, 0, 2], [3, 4, 5]], "<f4").tofile(tmp_path / "x.ztd")
    (tmp_path / "x.ztd.rsc").write_text("WIDTH   3\nFILE_LENGTH 2\n")
    (tmp_path / "y.ztd").write_bytes(b"abc")
    (tmp_path / "y.ztd.rsc").write_text("WIDTH 3\nFILE_LENGTH 2\n")
    got = {(r.row, r.col): r.value for r in files.read_float_grids(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.0, (0, 1): None, (0, 2): 2.0, (1, 0): 3.0, (1, 1): 4.0, (1, 2): 5.0}


def test_append_and_payload(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    files.append_new(df, path, ["k"])
    files.append_new(spark.createDataFrame([(2, "x"), (3, "c")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    out = files.json_payload(df.withColumn("g", F.lit("s")), ["g"], {"n": F.count("*")}, "k").collect()[0]
    assert json.loads(out.payload) == {"n": 2, "rows": [{"k": 1, "v": "a"}, {"k": 2, "v": "b"}]}
    assert files.union_of_columns(df, df.select("k")).filter("v is null").count() == 2


# -- streams ----------------------------------------------------------------------------------


def arrivals(spark, folder, cuts):
    g = np.random.default_rng(5)
    rows = [("s", datetime(2025, 7, 1) + timedelta(minutes=30 * i), float(g.random() * (20 if i % 37 == 0 else 1))) for i in range(48 * 4 - 10)]
    for n, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(rows[a:b], S.STEPS).coalesce(1).write.mode("append").parquet(f"{folder}/{n}")
    return spark.createDataFrame(rows, S.STEPS)


def days_of(rows):
    return sorted((r.date, r.n_steps, round(r.max_e, 9), r.duration_h, round(r.burst_mm, 9), r.window_end) for r in rows)


def test_burst_stream_equals_batch(spark, tmp_path):
    steps = arrivals(spark, str(tmp_path / "in"), [30, 100])
    want = days_of(O.bursts(steps, ["site"], A, B).collect())
    stream = S.read_steps(spark, str(tmp_path / "in/*"))
    S.run_available(S.burst_stream(stream, A, B), str(tmp_path / "c1"), "update", table="burst_updates")
    told = spark.table("burst_updates")
    last = told.groupBy("site", "date").agg(F.max_by(F.struct(*told.columns[2:]), "n_steps").alias("r")).select("site", "date", "r.*")
    assert days_of(last.collect()) == want


def test_days_written_twice_are_the_same(spark, tmp_path):
    steps = arrivals(spark, str(tmp_path / "in"), [30, 100])
    want = days_of(O.bursts(steps, ["site"], A, B).collect())
    stream = S.read_steps(spark, str(tmp_path / "in/*"))
    sink = S.upsert_days(str(tmp_path / "out"), A, B)
    S.run_available(stream, str(tmp_path / "c2"), "append", sink)
    sink(spark.read.schema(S.STEPS).parquet(str(tmp_path / "in/1")), 1)  # a batch that is run again
    got = spark.read.parquet(str(tmp_path / "out/days"))
    assert days_of(got.collect()) == want and spark.read.parquet(str(tmp_path / "out/steps")).count() == steps.count()


def test_final_days_follow_the_watermark(spark, tmp_path):
    arrivals(spark, str(tmp_path / "in"), [100, 150])
    stream = S.read_steps(spark, str(tmp_path / "in/*"))
    S.run_available(S.daily_steps(stream, "1 hour"), str(tmp_path / "c3"), "append", table="final_days")
    got = {r.date: (r.n_steps, r.provisional) for r in spark.table("final_days").collect()}
    assert got == {date(2025, 7, d): (48, False) for d in (1, 2, 3)}


def test_only_gapless_days_are_added_and_changes_told_once(spark, tmp_path):
    path = str(tmp_path / "days")
    sink = S.append_contiguous(path)
    day = lambda *ds: spark.createDataFrame([("s", date(2025, 7, d), "WATCH" if d > 2 else "DORMANT") for d in ds], "site string, date date, alarm_level string")
    sink(day(1, 2, 4), 0)
    sink(day(2, 3, 4, 6), 1)
    assert sorted(r.date.day for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4]
    source = spark.readStream.schema("site string, date date, alarm_level string").parquet(path)
    S.run_available(S.level_changes(source), str(tmp_path / "c4"), "append", table="changes")
    assert sorted((r.date.day, r.alarm_level, r.previous) for r in spark.table("changes").collect())[:1] == [(1, "DORMANT", None)]


def test_site_files(tmp_path, monkeypatch):
    import pytest

    from talus.sources.config import load_site

    (tmp_path / "a.json").write_text(json.dumps({"name": "A", "slug": "a", "start": "2025-05-01", "end": "2025-09-30T00:00:00Z", "soil": {"phi": 32}, "other": 1}))
    (tmp_path / "p.json").write_text(json.dumps({"site_file": "a.json"}))
    monkeypatch.setenv("TALUS_SITE", str(tmp_path / "p.json"))
    s = load_site()
    assert (s.slug, s.soil.phi, s.soil.depth, s.suction, s.operational_m) == ("a", 32, 3.0, None, 0.5)
    assert s.start.isoformat() == "2025-05-01T00:00:00+00:00" and s.end.tzinfo is not None
    (tmp_path / "b.json").write_text(json.dumps({"name": "B"}))
    with pytest.raises(ValueError, match="slug"):
        load_site(str(tmp_path / "b.json"))


def test_late_repeated_and_shuffled_steps_tell_what_the_batch_tells(spark, tmp_path):
    a, b = R.THRESHOLDS["nwhimalaya"]
    r = random.Random(4)
    rows = [(site, datetime(2025, 7, 1) + timedelta(minutes=30 * i), r.choice([0.0, 0.0, 1.5, 20.0])) for site in "xy" for i in range(48 * 4)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][1], r.random()))
    late = sorted(range(len(order)), key=lambda k: k + r.randrange(-150, 150))  # up to a day and a half out of order
    parts = [[rows[order[k]] for k in late[at : at + 80]] for at in range(0, len(rows), 80)]
    parts.insert(3, parts[1])  # a replay
    for n, part in enumerate(parts):
        spark.createDataFrame(part, S.STEPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "steps"))
        S.run_available(S.burst_stream(spark.readStream.schema(S.STEPS).parquet(str(tmp_path / "steps")), a, b), str(tmp_path / "check"), "update", S.told_to(str(tmp_path / "told")))
    told = spark.read.parquet(str(tmp_path / "told"))
    got = told.groupBy("site", "date").agg(F.max_by(F.struct("n_steps", "total_mm", "max_e", "duration_h"), "batch").alias("r")).select("site", "date", "r.*")
    want = O.bursts(spark.createDataFrame(rows, S.STEPS), ["site"], a, b)
    key = lambda df: sorted((x.site, x.date, x.n_steps, round(x.total_mm, 9), round(x.max_e, 9), x.duration_h) for x in df.collect())
    assert key(got) == key(want)
    n, again = told.count(), told.filter("batch = 0").drop("batch")
    S.told_to(str(tmp_path / "told"))(spark.createDataFrame(again.collect(), again.schema), 0)
    assert spark.read.parquet(str(tmp_path / "told")).count() == n


def test_level_changes_are_told_once(spark, tmp_path):
    schema = "site string, date date, alarm_level string"
    parts = [[("s", date(2025, 7, 1), "WATCH"), ("s", date(2025, 7, 2), "WATCH")], [("s", date(2025, 7, 2), "WATCH"), ("s", date(2025, 7, 1), "ALERT"), ("s", date(2025, 7, 3), "ALERT")]]
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "days"))
        S.run_available(S.level_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "days"))), str(tmp_path / "check"), "append", S.told_to(str(tmp_path / "told")))
    got = sorted((r.date.day, r.alarm_level, r.previous) for r in spark.read.parquet(str(tmp_path / "told")).collect())
    assert got == [(1, "WATCH", None), (3, "ALERT", "WATCH")]


def test_buildings_and_newest_season(spark, tmp_path):
    area = {"type": "way", "id": 2, "center": {"lat": 31.5, "lon": 77.5}, "tags": {"building": "barn"}}
    elements = [{"type": "node", "id": 1, "lat": 31.0, "lon": 77.0}, area, {"type": "way", "id": 3, "tags": {"building": "yes"}}, {"type": "node", "id": 4, "lat": 0.0, "lon": 0.0, "tags": {"name": "x"}}]
    (tmp_path / "map.json").write_text(json.dumps({"elements": elements}))
    got = {r.id: (r.kind, r.lon, r.lat) for r in files.read_buildings(spark, f"{tmp_path}/map.json").collect()}
    assert got == {1: (None, 77.0, 31.0), 2: ("barn", 77.5, 31.5), 4: (None, 0.0, 0.0)}
    (tmp_path / "rain" / "more").mkdir(parents=True)
    for name in ("season_2029.csv", "season_2031.csv", "more/season_2031b.csv", "season_none.csv", "other_2044.txt"):
        (tmp_path / "rain" / name).write_text("x")
    newest = files.newest_season(spark, f"{tmp_path}/rain", "season_*.csv").collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.year) for r in newest) == [("season_2031.csv", 2031), ("season_2031b.csv", 2031)]
    assert files.newest_season(spark, f"{tmp_path}/rain", "season_n*.csv").count() == 0
