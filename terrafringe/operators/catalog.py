"""The product catalogue and the frame table: filters, grouping, de-duplication and continuity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafringe.functions.scalars import product_fields

#: Product versions that a requested one accepts.
ACCEPTED_VERSIONS = {"1a": ["1a", "1b", "1c"], "1b": ["1b", "1c"], "1c": ["1c"]}


def parse_products(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """`files` with the fields of their names."""
    return files.withColumns(product_fields(F.col(name_col)))


def of_version(products: DataFrame, version: str | None) -> DataFrame:
    """Products whose name has the given version; all for None or `all`."""
    if version in (None, "all"):
        return products
    if not version[:1].isdigit():
        raise ValueError("a version begins with a digit")
    return products.filter(F.contains("file_name", F.lit(f"-v{version}")))


def latest_versions(products: DataFrame) -> DataFrame:
    """One product, that of the highest version, for each base name."""
    rank = F.row_number().over(Window.partitionBy("base_name").orderBy(F.desc("version_num"), "product_id"))
    return products.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def without_old_versions(products: DataFrame, group: list[str], limit: float = 300) -> DataFrame:
    """Without the products below the limit in groups that also have some above."""
    new = F.max((F.col("version_num") >= limit).cast("int")).over(Window.partitionBy(*group)) == 1
    return products.withColumn("_new", new).filter((~F.col("_new")) | (F.col("version_num") >= limit)).drop("_new")


def within_dates(pairs: DataFrame, start: str, end: str, least_days: int, most_days: int) -> DataFrame:
    """Pairs (younger, older) between the dates, and with a span in days between the limits, all inclusive."""
    span = F.datediff("younger", "older")
    return pairs.filter((F.col("older") >= F.lit(start).cast("date")) & (F.col("younger") <= F.lit(end).cast("date")) & span.between(least_days, most_days))


def islands(rows: DataFrame, partition: list[str], order: list[str], joined: Column) -> DataFrame:
    """`rows` with `island`: neighbours in order for which `joined` holds share a number, from 1 in each partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return rows.withColumn("_new", (~F.coalesce(joined, F.lit(False))).cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def grouped_frames(products: DataFrame, days: int = 1) -> DataFrame:
    """Products in order of pair, latitude and time, with `island`: frames of a pair that follow each other within `days` degrees of latitude."""
    w = Window.partitionBy("pair_name").orderBy("center_lat", "mid_time", "product_id")
    near = F.abs(F.col("center_lat") - F.lag("center_lat").over(w)) <= days
    return islands(products, ["pair_name"], ["center_lat", "mid_time", "product_id"], near)


def without_adjacent_duplicates(products: DataFrame) -> DataFrame:
    """Of neighbours with the same pair, latitude and time, the one of the highest version, then of the smallest id."""
    w = Window.partitionBy("pair_name", "center_lat", "mid_time").orderBy(F.desc("version_num"), "product_id")
    return products.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def selected_frames(frames: DataFrame, beam: str = "IW", levels: tuple[str, ...] = ("SLC", "RAW"), start: str | None = None, end: str | None = None, south: float | None = None, north: float | None = None) -> DataFrame:
    """Frames by beam, level, time and latitude overlap; all limits reach the scan as filters."""
    out = frames.filter((F.col("beam") == beam) & F.col("level").isin(*levels))
    for limit, rule in ((start, lambda x: F.col("acq") >= F.lit(x).cast("timestamp_ntz")), (end, lambda x: F.col("acq") <= F.lit(x).cast("timestamp_ntz")), (south, lambda x: F.col("max_lat") >= x), (north, lambda x: F.col("min_lat") <= x)):
        out = out if limit is None else out.filter(rule(limit))
    return out


def raw_without_slc(frames: DataFrame, reach: int = 4, keys: tuple[str, ...] = ("path", "orbit_group")) -> DataFrame:
    """RAW frames with no SLC frame whose number differs by less than `reach` in the same group.

    The range condition becomes an equality: each SLC stands for all numbers it covers.
    """
    raw, slc = frames.filter("level = 'RAW'"), frames.filter("level = 'SLC'")
    covered = slc.select(*keys, F.explode(F.sequence(F.col("frame") - (reach - 1), F.col("frame") + (reach - 1))).alias("frame")).distinct()
    return raw.join(covered, [*keys, "frame"], "left_anti")


def common_dates(frames: DataFrame, partition: list[str], seconds: int = 86399) -> DataFrame:
    """`frames` with `common`: the first acquisition of those from `seconds` before this one on."""
    at = F.unix_seconds(F.col("acq").cast("timestamp"))
    # Latest first, so that the frame only grows and its minimum is carried on.
    w = Window.partitionBy(*partition).orderBy(F.col("_at").desc()).rangeBetween(Window.unboundedPreceding, seconds)
    return frames.withColumn("_at", at).withColumn("common", F.min("acq").over(w)).drop("_at")


def continuity(frames: DataFrame, partition: list[str]) -> DataFrame:
    """Frames and gaps along latitude of each pass: a gap is where a frame ends south of the next one's beginning."""
    w = Window.partitionBy(*partition).orderBy("center_lat", "frame_pk")
    gap = F.col("max_lat") < F.lead("min_lat").over(w)
    flagged = frames.withColumn("_gap", F.coalesce(gap, F.lit(False)).cast("long"))
    return flagged.groupBy(*partition).agg(F.count("*").alias("n_frames"), F.sum("_gap").alias("n_gaps"), F.min("min_lat").alias("south"), F.max("max_lat").alias("north"))


def extents(frames: DataFrame, key: str) -> DataFrame:
    """Union and intersection of the latitude ranges of each group; an empty intersection has south over north."""
    return frames.groupBy(key).agg(F.min("min_lat").alias("union_south"), F.max("max_lat").alias("union_north"), F.max("min_lat").alias("common_south"), F.min("max_lat").alias("common_north"))
