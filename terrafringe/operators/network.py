"""Date pairs, triplets, misclosure and the inversion of a pair network."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def epochs(pairs: DataFrame) -> DataFrame:
    """The distinct dates of all pairs, in order, with days since the first and since the one before."""
    dates = pairs.select(F.explode(F.array("younger", "older")).alias("epoch")).distinct()
    w = Window.orderBy("epoch")
    return dates.withColumn("days", F.datediff("epoch", F.first("epoch").over(w)).cast("long")).withColumn("step", F.datediff("epoch", F.lag("epoch").over(w)).cast("long"))


def triplets(pairs: DataFrame, least_days: int | None = None, most_days: int | None = None) -> DataFrame:
    """(d1, d2, d3) of three dates whose pairs (d2, d1), (d3, d2) and (d3, d1) all exist, by equality joins; the limits hold for the shortest and the longest span."""
    first = pairs.select(F.col("older").alias("d1"), F.col("younger").alias("d2"))
    second = pairs.select(F.col("older").alias("d2"), F.col("younger").alias("d3"))
    third = pairs.select(F.col("older").alias("d1"), F.col("younger").alias("d3"))
    out = first.join(second, "d2").join(third, ["d1", "d3"]).select("d1", "d2", "d3")
    spans = [F.datediff("d2", "d1"), F.datediff("d3", "d2"), F.datediff("d3", "d1")]
    if least_days:
        out = out.filter(F.least(*spans) >= least_days)
    if most_days:
        out = out.filter(F.greatest(*spans) <= most_days)
    return out


def misclosure_pixels(phases: DataFrame, found: DataFrame) -> DataFrame:
    """(d1, d2, d3, gy, gx, m): phase sum around each triplet at each pixel that all three pairs have."""
    p = phases.select("younger", "older", "gy", "gx", "phase")
    a = p.select(F.col("older").alias("d1"), F.col("younger").alias("d2"), "gy", "gx", F.col("phase").alias("a"))
    b = p.select(F.col("older").alias("d2"), F.col("younger").alias("d3"), "gy", "gx", F.col("phase").alias("b"))
    c = p.select(F.col("older").alias("d1"), F.col("younger").alias("d3"), "gy", "gx", F.col("phase").alias("c"))
    return found.join(a, ["d1", "d2"]).join(b, ["d2", "d3", "gy", "gx"]).join(c, ["d1", "d3", "gy", "gx"]).select("d1", "d2", "d3", "gy", "gx", (F.col("a") + F.col("b") - F.col("c")).alias("m"))


def referenced(phases: DataFrame, gy: int, gx: int) -> DataFrame:
    """Phases less each pair's own phase at the reference pixel; pairs without it are left out."""
    at = phases.filter((F.col("gy") == gy) & (F.col("gx") == gx)).select("younger", "older", F.col("phase").alias("_zero"))
    return phases.join(at, ["younger", "older"]).withColumn("phase", F.col("phase") - F.col("_zero")).drop("_zero")


def cumulative_misclosure(misclosures: DataFrame) -> DataFrame:
    """Net and absolute sums at each pixel."""
    return misclosures.groupBy("gy", "gx").agg(F.sum("m").alias("net"), F.sum(F.abs("m")).alias("absolute"), F.count("*").alias("n"))


def running_misclosure(misclosures: DataFrame, gy: int, gx: int) -> DataFrame:
    """The triplets of one pixel in order, with running net and absolute sums."""
    w = Window.partitionBy("gy", "gx").orderBy("d1", "d2", "d3").rowsBetween(Window.unboundedPreceding, 0)
    return misclosures.filter((F.col("gy") == gy) & (F.col("gx") == gx)).select("d1", "d2", "d3", "m", F.sum("m").over(w).alias("net"), F.sum(F.abs("m")).over(w).alias("absolute"))


def design_matrix(pairs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of velocities between epochs for pairs (younger, older), and the epochs' days from the first."""
    dates = np.unique(np.concatenate([pairs["younger"].to_numpy("datetime64[D]"), pairs["older"].to_numpy("datetime64[D]")]))
    days = (dates - dates[0]).astype(float)
    steps = np.diff(days)
    last, first = (np.searchsorted(dates, pairs[c].to_numpy("datetime64[D]")) for c in ("younger", "older"))
    at = np.arange(len(steps))
    return np.where((at >= first[:, None]) & (at < last[:, None]), steps, 0.0), days


def inverted_network(values: DataFrame, value_col: str = "value") -> DataFrame:
    """(epoch, cumulative): least-squares series of a network of pair values, by minimum-norm velocities.

    The network has one row for each pair; it is solved on the driver.
    """
    rows = values.select("younger", "older", value_col).toPandas()
    spark = values.sparkSession
    if not len(rows):
        return spark.createDataFrame([], "epoch date, cumulative double")
    b, days = design_matrix(rows)
    velocity = np.linalg.pinv(b) @ rows[value_col].to_numpy(float)
    series = np.concatenate([[0.0], np.cumsum(velocity * np.diff(days))])
    first = min(rows["older"].min(), rows["younger"].min())
    dates = [(pd.Timestamp(first) + pd.Timedelta(days=float(d))).date() for d in days]
    return spark.createDataFrame(list(zip(dates, map(float, series), strict=True)), "epoch date, cumulative double")
