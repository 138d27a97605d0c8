"""Streaming counterparts of the catalogue's grouping in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def passes(frames: DataFrame, gap: str = "1 day", late: str = "2 days", time_col: str = "acq") -> DataFrame:
    """Frames of a path that follow each other within `gap`, as sessions, with their number and latitudes.

    `frames` may be a stream; frames later than `late` are left out of closed sessions.
    """
    at = frames.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late)
    session = F.session_window("_at", gap)
    return at.groupBy("path", session.alias("pass")).agg(F.count("*").alias("n_frames"), F.min("min_lat").alias("south"), F.max("max_lat").alias("north"))
