"""Text sources and sinks: lists, key-value headers, frame tables, GeoJSON and KML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = "frame_pk long, acq timestamp_ntz, path long, orbit long, frame long, beam string, level string, center_lat double, min_lat double, max_lat double"


def read_list(spark: SparkSession, source: str, is_file: bool = False) -> DataFrame:
    """(item): items of a text of items between spaces or commas, or of a file with one a line; blanks go."""
    rows = spark.read.text(source) if is_file else spark.createDataFrame([(source,)], "value string")
    items = rows.select(F.explode(F.split("value", r"[\s,]+")).alias("item"))
    return items.filter("item != ''").distinct()


def product_files(files: DataFrame, name: str = "file_name") -> DataFrame:
    """Files of the known kinds, with the path under which a remote one is opened."""
    kept = files.filter(F.lower(F.col(name)).rlike(r"\.(nc|h5)$"))
    return kept.withColumn("open_path", F.when(F.col(name).startswith("https://"), F.concat(F.lit("/vsicurl/"), name)).otherwise(F.col(name)))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, fields): `KEY value` lines of each file as a map."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.split(F.trim("value"), r"\s+", 2).alias("kv")).filter(F.size("kv") == 2)
    return lines.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct(F.col("kv")[0], F.col("kv")[1]))).alias("fields"))


def key_values(fields: dict[str, object]) -> str:
    """The text of a key-value header, keys padded to 40."""
    return "".join(f"{k:<40}{v}\n" for k, v in fields.items())


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frame table from a csv file with a header; the schema is fixed, so nothing is scanned to infer it."""
    return spark.read.csv(path, header=True, schema=FRAME_SCHEMA)


def box_wkt(w: Column, s: Column, e: Column, n: Column) -> Column:
    """A bounding box as WKT, from its south-west corner on, counter-clockwise."""
    point = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", point(w, s), point(e, s), point(e, n), point(w, n), point(w, s)), F.lit("))"))


def geojson(id_: Column, ring: Column) -> Column:
    """A feature collection of one polygon; `ring` is an array of [x, y]."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(id_.alias("id")).alias("properties"), geometry.alias("geometry"))
    return F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, ring) of the first ring of every polygon feature."""
    schema = "features array<struct<properties: struct<id: string>, geometry: struct<type: string, coordinates: array<array<array<double>>>>>>"
    features = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return features.select(F.col("f.properties.id").alias("id"), F.col("f.geometry.coordinates")[0].alias("ring"))


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(name, ring) of every polygon placemark."""
    schema = "name string, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    rows = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    points = F.filter(F.split(F.trim("Polygon.outerBoundaryIs.LinearRing.coordinates"), r"\s+"), lambda p: p != "")
    return rows.select("name", F.transform(points, lambda p: F.transform(F.slice(F.split(p, ","), 1, 2), lambda x: x.cast("double"))).alias("ring"))


def url_list_name(existing: list[str], stem: str) -> str:
    """`<stem>-<n>.txt` with the first number that isn't taken."""
    taken, n = set(existing), 0
    while f"{stem}-{n}.txt" in taken:
        n += 1
    return f"{stem}-{n}.txt"
