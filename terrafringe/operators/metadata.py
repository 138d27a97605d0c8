"""Small relations over products, frames and rasters: limits, counts, orders, display values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def blanked_below(pixels: DataFrame, value: str, least: float) -> DataFrame:
    """`pixels` with values under `least` as null, as coherence is shown."""
    return pixels.withColumn(value, F.when(F.col(value) >= least, F.col(value)))


def mean_or_zero(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of each group as `v`; 0 where it has no value."""
    return rows.groupBy(*keys).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("v"))


def least_version(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The least version of each group as `v`, in the order of the text."""
    return rows.groupBy(*keys).agg(F.min(version).alias("v"))


def limits(rows: DataFrame, keys: list[str], value: str, code: str) -> DataFrame:
    """Least and greatest value of each group, and the median of its projection codes."""
    return rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.median(code).alias("epsg"))


def without_empty_rows(pixels: DataFrame, row: list[str], value: str) -> DataFrame:
    """Pixels of the raster rows that have a value at all."""
    return pixels.join(pixels.groupBy(*row).agg(F.count(value).alias("_n")).filter("_n > 0").select(*row), row, "left_semi")


def largest(scenes: DataFrame, keys: list[str], scene: str, area: str) -> DataFrame:
    """The scene of the largest area of each group; the smallest of equal ones."""
    return scenes.groupBy(*keys).agg(F.max_by(scene, F.struct(F.col(area), -F.col(scene))).alias(scene))


def kept_and_rejected(rows: DataFrame, keys: list[str], rule: Column) -> DataFrame:
    """How many rows of each group keep to a rule, and how many don't."""
    return rows.groupBy(*keys).agg(F.count_if(rule).alias("kept"), F.count_if(~rule).alias("rejected"))


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The first row of each run of equal values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_new", (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(F.lag(value).over(w))).filter("_new").drop("_new")


def running_intersection(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`frames` with south and north of what all frames up to each one have in common; south is over north where nothing is."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("south", F.max("min_lat").over(w)).withColumn("north", F.min("max_lat").over(w))


def chunked(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """`rows` with their place in the order of each group, from 0, and the number of their chunk of `size`."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return rows.withColumn("place", place).withColumn("chunk", F.floor(F.col("place") / size).cast("int"))


def all_equal(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Whether all rows of each group have the same values."""
    return rows.groupBy(*keys).agg((F.min(F.struct(*values)) == F.max(F.struct(*values))).alias("equal"))


def rewrapped(phase: Column) -> Column:
    """Phase modulo 4 pi."""
    turn = 4 * math.pi
    return phase - turn * F.floor(phase / turn)


def displacement(phase: Column) -> Column:
    """Displayed displacement in metres, for a wavelength of 0.0556 m."""
    return phase * 0.0556 / (6 * math.pi)


def multilook_mode(pixels: DataFrame, looks: int, keys: list[str]) -> DataFrame:
    """The most frequent component of each block; the smallest of equal ones."""
    y, x = F.floor(F.col("gy") / looks).alias("block_y"), F.floor(F.col("gx") / looks).alias("block_x")
    counts = pixels.filter("comp is not null").groupBy(*keys, y, x, "comp").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys, "block_y", "block_x").agg(F.max_by("comp", F.struct("n", -F.col("comp"))).alias("comp"))


def multilook_nearest(pixels: DataFrame, looks: int, keys: list[str]) -> DataFrame:
    """The value at the centre of each block that has one."""
    centre = (F.pmod("gy", F.lit(looks)) == looks // 2) & (F.pmod("gx", F.lit(looks)) == looks // 2)
    return pixels.filter(centre).select(*keys, F.floor(F.col("gy") / looks).alias("block_y"), F.floor(F.col("gx") / looks).alias("block_x"), "v")


def summed(pairs: DataFrame, pixels: DataFrame) -> DataFrame:
    """`pairs` (younger, older, gy, gx) with the sum of both epochs' values as `total`; pairs without one of them go."""
    side = lambda epoch, to: pixels.select(F.col("epoch").alias(epoch), "gy", "gx", F.col("q").alias(to))
    both = pairs.join(side("younger", "_a"), ["younger", "gy", "gx"]).join(side("older", "_b"), ["older", "gy", "gx"])
    return both.select("younger", "older", "gy", "gx", (F.col("_a") + F.col("_b")).alias("total"))
