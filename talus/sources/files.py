"""Readers and writers of the formats that the pipelines exchange; all return or take DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talus.operators.validation import ordinal_ranks

DAILY = {"rain_mm": None, "snowmelt_mm": 0.0, "tmin_c": None, "tmax_c": None}


def with_defaults(df: DataFrame, defaults: dict[str, float | None]) -> DataFrame:
    """Numeric columns with a default where the text is blank, no number, or the column is missing."""
    cells = {}
    for name, default in defaults.items():
        value = F.col(name).cast("string").try_cast("double") if name in df.columns else F.lit(None).cast("double")
        value = F.when(~F.isnan(value), value)
        cells[name] = value if default is None else F.coalesce(value, F.lit(float(default)))
    return df.withColumns(cells)


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Daily weather from CSV with a header; only `date` must be there."""
    df = with_defaults(spark.read.csv(path, header=True), DAILY)
    return df.withColumn("date", F.to_date("date"))


def read_steps(spark: SparkSession, path: str) -> DataFrame:
    """Half-hourly rates from CSV with columns t, r."""
    return spark.read.csv(path, schema="t string, r double", header=True).select(F.to_timestamp("t").alias("ts"), F.col("r").alias("rate_mm_h"))


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Zones of an alert file, whether under `alerts` or `zones`; one look where the number is missing."""
    df = spark.read.json(path, multiLine=True)
    have = [F.col(c) for c in ("alerts", "zones") if c in df.columns]
    z = df.select(F.explode(F.coalesce(*have) if len(have) > 1 else have[0]).alias("z")).select("z.*")
    looks = F.coalesce("n_looks", F.lit(1)) if "n_looks" in z.columns else F.lit(1)
    return z.withColumns({"lon": F.col("centroid_lonlat")[0], "lat": F.col("centroid_lonlat")[1], "n_looks": looks})


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Point features of GeoJSON: lon, lat, name, date, type, source; further properties as a map."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    p, xy = F.col("f.properties"), F.from_json("f.geometry.coordinates", "array<double>")
    core = ("name", "date", "type", "source")
    rest = F.map_filter(p, lambda k, v: ~k.isin(*core))
    return f.filter("f.geometry.type = 'Point'").select(xy[0].alias("lon"), xy[1].alias("lat"), *(p[c].alias(c) for c in core if c != "date"), F.to_date(F.try_to_timestamp(p["date"])).alias("date"), rest.alias("extra"))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Outer rings of GeoJSON polygons and multi-polygons: feature, ring, vertices (lon, lat); holes are left out."""
    schema = "features array<struct<geometry:struct<type:string,coordinates:string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("feature", "f"))
    one = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json("f.geometry.coordinates", "array<array<array<double>>>")))
    many = F.when(F.col("f.geometry.type") == "MultiPolygon", F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = f.select("feature", F.posexplode(F.coalesce(one, many)).alias("ring", "p"))
    return rings.select("feature", "ring", F.transform(F.col("p")[0], lambda v: F.struct(v[0].alias("lon"), v[1].alias("lat"))).alias("vertices"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of KML placemarks: name, ring, vertices."""
    schema = "name string, Polygon struct<outerBoundaryIs:struct<LinearRing:struct<coordinates:string>>>"
    k = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path).filter("Polygon is not null")
    points = F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+")
    at = lambda v, i: F.split(v, ",")[i].cast("double")
    return k.select("name", F.lit(0).alias("ring"), F.transform(points, lambda v: F.struct(at(v, 0).alias("lon"), at(v, 1).alias("lat"))).alias("vertices"))


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """Buildings of a map extract (id, kind, lon, lat): nodes by their own place, areas by their centre; those without any are left out."""
    place = "lat:double,lon:double"
    schema = f"elements array<struct<id:long,type:string,{place},center:struct<{place}>,tags:map<string,string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("elements").alias("e"))
    at = {c: F.coalesce(F.col(f"e.center.{c}"), F.col(f"e.{c}")) for c in ("lon", "lat")}
    placed = e.select(F.col("e.id").alias("id"), F.try_element_at("e.tags", F.lit("building")).alias("kind"), *(x.alias(c) for c, x in at.items()))
    return placed.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())


def newest_season(spark: SparkSession, folder: str, glob: str, year: str = r"(\d{4})") -> DataFrame:
    """file and year of the files below a folder whose name matches the glob and states the latest year; names without a year do not count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select(F.col("path").alias("file"))
    dated = files.withColumn("year", F.regexp_extract(F.element_at(F.split("file", "/"), -1), year, 1).try_cast("int")).filter("year is not null")
    return dated.join(dated.agg(F.max("year").alias("year")), "year", "left_semi").select("file", "year")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Curated historical events of a JSON list, with sources as structs."""
    schema = "name string, date date, lat double, lon double, deaths int, injured int, damage string, damage_score int, confidence string, confidence_score int, confidence_reason string, review_needed boolean, sources array<struct<label:string,url:string>>"
    return spark.read.schema(schema).json(path, multiLine=True)


def event_violations(events: DataFrame) -> DataFrame:
    """Events that break a rule, with the rules broken."""
    rules = {
        "no_name": F.coalesce(F.trim("name"), F.lit("")) == "", "no_place": F.col("lat").isNull() | F.col("lon").isNull(), "no_source": F.coalesce(F.size("sources"), F.lit(0)) <= 0,
        "negative_count": (F.coalesce("deaths", F.lit(0)) < 0) | (F.coalesce("injured", F.lit(0)) < 0), "duplicate_name": F.count("*").over(Window.partitionBy("name")) > 1,
    }
    broken = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())), lambda x: x.isNotNull())
    return events.withColumn("broken", broken).filter(F.size("broken") > 0)


def read_float_grids(spark: SparkSession, path: str) -> DataFrame:
    """Little-endian float grids with `.rsc` headers beside them: file, row, col, value; 0 is no data.

    A file whose size does not match its header gives no rows.
    """
    heads = spark.read.text(f"{path}/*.rsc", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), r"\.rsc$", "").alias("file"), F.regexp_extract("value", r"WIDTH\s+(\d+)", 1).cast("int").alias("w"), F.regexp_extract("value", r"FILE_LENGTH\s+(\d+)", 1).cast("int").alias("h"))
    data = spark.read.format("binaryFile").load(f"{path}/*.ztd").select(F.col("_metadata.file_path").alias("file"), "content")

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for f, content, w, h in frame.itertuples(index=False):
                if len(content) == 4 * w * h:
                    v = np.frombuffer(content, "<f4").astype(float)
                    yield pd.DataFrame({"file": f, "row": np.repeat(np.arange(h), w), "col": np.tile(np.arange(w), h), "value": np.where(v == 0, np.nan, v)})

    out = data.join(heads, "file").select("file", "content", "w", "h").mapInPandas(run, "file string, row int, col int, value double")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN made null: done once, when data come in."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_table(df: DataFrame, path: str, partition: list[str], mode: str = "overwrite") -> None:
    """Parquet, partitioned by site, stack and the like."""
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder at the path, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def append_new(new: DataFrame, path: str, key: list[str]) -> None:
    """Rows of `new` whose key the table does not have yet are appended to it; the table is made if there is none."""
    spark = new.sparkSession
    if not table_exists(spark, path):
        new.dropDuplicates(key).write.parquet(path)
        return
    old = spark.read.parquet(path)
    new.dropDuplicates(key).join(old.select(*key), key, "left_anti").write.mode("append").parquet(path)


def union_of_columns(*frames: DataFrame) -> DataFrame:
    """Rows of tables with different columns, the missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def json_payload(rows: DataFrame, by: list[str], summary: dict, order: str, most: int = 1000) -> DataFrame:
    """JSON texts for each group and `part`: summary aggregates of the part and its rows in order, `most` of them at most.

    Rows are numbered within ranges of the order, so that a group of any size is dealt to many tasks.
    """
    numbered = ordinal_ranks(rows, by, order, order).withColumn("part", F.floor((F.col("rank") - 1) / most).cast("long")).drop("rank")
    row = F.struct(order, *(c for c in rows.columns if c not in by and c != order))
    agg = numbered.groupBy(*by, "part").agg(*(c.alias(k) for k, c in summary.items()), F.sort_array(F.collect_list(row)).alias("rows"))
    return agg.select(*by, "part", F.to_json(F.struct(*summary, "rows")).alias("payload"))
