"""Surfaces fitted by least squares, and the chain of ionosphere frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafringe.operators.raster import chain_offsets, merged

TERMS = {"quadratic": ["1", "x", "y", "x * y", "x * x", "y * y"], "bilinear": ["1", "x", "y", "x * y"]}


def fit_surface(pixels: DataFrame, kind: str = "quadratic") -> dict[str, float]:
    """Coefficients of v over the terms of gx and gy: sums of products in Spark, the small system on the driver."""
    terms = TERMS[kind]
    p = pixels.filter("v is not null").select(F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"), "v")
    sums = [F.sum(F.expr(f"({a}) * ({b})")).alias(f"m{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    row = p.agg(*sums, *[F.sum(F.expr(f"({a}) * v")).alias(f"r{i}") for i, a in enumerate(terms)]).first()
    if row["m0_0"] is None:
        return dict.fromkeys(terms, 0.0)
    m = np.array([[row[f"m{min(i, j)}_{max(i, j)}"] for j in range(len(terms))] for i in range(len(terms))])
    return dict(zip(terms, map(float, np.linalg.pinv(m) @ np.array([row[f"r{i}"] for i in range(len(terms))])), strict=True))


def with_surface(pixels: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """`pixels` with `surface`, the fitted value at each of them."""
    total = sum((F.lit(c) * F.expr(t.replace("x", "cast(gx as double)").replace("y", "cast(gy as double)")) for t, c in coefficients.items()), F.lit(0.0))
    return pixels.withColumn("surface", total)


def ionosphere(pixels: DataFrame, key: str = "pair_id", order: str = "frame_ord") -> DataFrame:
    """One raster for each key from overlapping frames: medians of neighbours made equal, means where they overlap, no null left."""
    shifts = chain_offsets(pixels.withColumn("comp", F.lit(1)), key, order)
    moved = pixels.join(shifts, [key, order]).withColumn("v", F.col("v") + F.col("shift"))
    return merged(moved, [key], "mean").withColumn("v", F.coalesce("v", F.lit(0.0)))
