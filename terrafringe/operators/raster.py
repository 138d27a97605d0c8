"""Rasters as relations keyed by integer grid coordinates: overlap, stitching, merging, masking, multilooking, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrafringe.functions.scalars import cycles

GRID = ["gy", "gx"]
MERGES = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}


def overlap(pixels: DataFrame, key: str = "pair_id", order: str = "frame_ord") -> DataFrame:
    """Pixels that neighbouring frames of a key share: (key, order, gy, gx, c1, c2, d), d = first - second, components other than 0."""
    p = pixels.filter(F.col("v").isNotNull() & (F.col("comp") != 0))
    first = p.select(key, F.col(order), *GRID, F.col("comp").alias("c1"), F.col("v").alias("v1"))
    second = p.select(key, (F.col(order) - 1).alias(order), *GRID, F.col("comp").alias("c2"), F.col("v").alias("v2"))
    return first.join(second, [key, order, *GRID]).withColumn("d", F.col("v1") - F.col("v2"))


def overlap_counts(shared: DataFrame, key: str = "pair_id", order: str = "frame_ord") -> DataFrame:
    """Pixels, median, deviation and non-zero differences of each pair of overlapping components."""
    return shared.groupBy(key, order, "c2", "c1").agg(F.count("*").alias("n"), F.median("d").alias("median_d"), F.stddev_pop("d").alias("std_d"), F.count_if(F.col("d") != 0).alias("n_nonzero"))


def best_components(counts: DataFrame, key: str = "pair_id", order: str = "frame_ord") -> DataFrame:
    """For each component of the second frame the one of the first with the most shared pixels, then the smallest."""
    rank = F.row_number().over(Window.partitionBy(key, order, "c2").orderBy(F.desc("n"), "c1"))
    return counts.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def circular_mean(angle: Column) -> Column:
    return F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle)))


def chain_offsets(pixels: DataFrame, key: str = "pair_id", order: str = "frame_ord", whole_cycles: bool = False) -> DataFrame:
    """(key, order, shift): what to add to each frame so that the medians of neighbours' differences vanish.

    Only neighbours are compared, and a constant doesn't change other medians,
    so the shifts are running sums. With `whole_cycles` each step is taken to the nearest 2 pi.
    """
    steps = overlap(pixels, key, order).groupBy(key, (F.col(order) + 1).alias(order)).agg(F.median("d").alias("step"))
    if whole_cycles:
        steps = steps.withColumn("step", cycles(F.col("step")) * 2 * F.pi())
    frames = pixels.select(key, order).distinct().join(steps, [key, order], "left")
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.select(key, order, F.sum(F.coalesce("step", F.lit(0.0))).over(w).alias("shift"))


def stitched(pixels: DataFrame, key: str = "pair_id", order: str = "frame_ord", merge: str = "mean", whole_cycles: bool = False) -> DataFrame:
    """One raster for each key: frames shifted by `chain_offsets` and merged where they overlap."""
    shifts = chain_offsets(pixels, key, order, whole_cycles)
    moved = pixels.filter("v is not null").join(shifts, [key, order]).withColumn("v", F.col("v") + F.col("shift"))
    return merged(moved, [key], merge)


def merged(pixels: DataFrame, keys: list[str], how: str = "mean") -> DataFrame:
    """One value for each pixel of overlapping frames; nulls don't count."""
    return pixels.groupBy(*keys, *GRID).agg(MERGES[how]("v").alias("v")).filter("v is not null")


def mosaic(pixels: DataFrame, keys: list[str], order: str = "frame_ord") -> DataFrame:
    """The value of the last frame that has one."""
    return pixels.filter("v is not null").groupBy(*keys, *GRID).agg(F.max_by("v", order).alias("v"))


def masked(pixels: DataFrame, mask: DataFrame, keys: list[str] = GRID) -> DataFrame:
    """Values times the mask; pixels that the mask doesn't have are null."""
    return pixels.join(mask.select(*keys, F.col("mask").alias("_m")), keys, "left").withColumn("v", F.col("v") * F.col("_m")).drop("_m")


def component_masked(pixels: DataFrame) -> DataFrame:
    """Phase and component null where the component is 0 or below; phase null where it is 0."""
    bad = F.coalesce(F.col("comp") <= 0, F.lit(True))
    return pixels.withColumn("v", F.when(~bad & (F.col("v") != 0), F.col("v"))).withColumn("comp", F.when(~bad, F.col("comp")))


def average(pixels: DataFrame, rasters: int, threshold: float | None = None) -> DataFrame:
    """Sum over all rasters by their number (not by valid values); with a threshold 0 below it and 1 from it on."""
    out = pixels.groupBy(*GRID).agg((F.sum("v") / rasters).alias("v"))
    return out if threshold is None else out.withColumn("v", F.when(F.col("v") < threshold, 0.0).otherwise(1.0))


def multilook(pixels: DataFrame, looks: int, keys: list[str]) -> DataFrame:
    """Mean of the valid values of each block, and the component at its centre."""
    y, x = F.floor(F.col("gy") / looks), F.floor(F.col("gx") / looks)
    centre = (F.pmod("gy", F.lit(looks)) == looks // 2) & (F.pmod("gx", F.lit(looks)) == looks // 2)
    return pixels.groupBy(*keys, y.alias("block_y"), x.alias("block_x")).agg(F.avg("v").alias("v"), F.max(F.when(centre, F.col("comp"))).alias("comp"))


def multilook_ranked(pixels: DataFrame, looks: int, keys: list[str]) -> DataFrame:
    """Each block's most frequent component (the smallest of equal ones) and the sum of its values over all valid pixels of the block."""
    block = [*keys, "block_y", "block_x"]
    valid = pixels.filter("v is not null").withColumn("block_y", F.floor(F.col("gy") / looks)).withColumn("block_x", F.floor(F.col("gx") / looks))
    per = valid.groupBy(*block, "comp").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    best = F.max_by(F.struct("comp", "s"), F.struct("n", -F.col("comp")))
    return per.groupBy(*block).agg(best.alias("b"), F.sum("n").alias("n")).select(*block, F.col("b.comp").alias("comp"), (F.col("b.s") / F.col("n")).alias("v"))


def cropped(pixels: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Pixels of a window, ends included; the limits reach the scan."""
    return pixels.filter(F.col("gy").between(y0, y1) & F.col("gx").between(x0, x1))


def snapped(low: Column, high: Column, step: float) -> tuple[Column, Column]:
    """Bounds moved outwards to whole steps."""
    return F.floor(low / step) * step, F.ceil(high / step) * step


def differential(epoch_px: DataFrame, pairs: DataFrame, value: str = "q") -> DataFrame:
    """Secondary less reference delay of each pair (younger, older), at pixels that both epochs have."""
    late = epoch_px.select(F.col("epoch").alias("younger"), *GRID, F.col(value).alias("_late"))
    early = epoch_px.select(F.col("epoch").alias("older"), *GRID, F.col(value).alias("_early"))
    return pairs.join(late, "younger").join(early, ["older", *GRID]).select("younger", "older", *GRID, (F.col("_late") - F.col("_early")).alias("v"))


def corrected(phases: DataFrame, epoch_px: DataFrame, pairs: DataFrame, scale: float) -> DataFrame:
    """Phase less the scaled differential delay; pixels without a delay are left out."""
    delay = differential(epoch_px, pairs).withColumnRenamed("v", "_delay")
    return phases.join(delay, ["younger", "older", *GRID]).withColumn("phase", F.col("phase") - scale * F.col("_delay")).drop("_delay")


def stacked(pixels: DataFrame, key: str) -> DataFrame:
    """Bands of a stack in order of their key: index, pixels and mean."""
    bands = pixels.groupBy(key).agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return bands.withColumn("band", F.row_number().over(Window.orderBy(key)).cast("long"))


def sign_fixed(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute values, negative where over half of a raster's values are."""
    share = F.avg((F.col("v") < 0).cast("int")).over(Window.partitionBy(*keys))
    return pixels.withColumn("v", F.when(share > 0.5, -F.abs("v")).otherwise(F.abs("v")))


def trend(pixels: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """R2, slope and standard error of the regression of y on x for each raster."""
    n, sxx, syy, sxy = F.regr_count(y, x), F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    out = pixels.groupBy(*keys).agg(n.alias("n"), F.regr_r2(y, x).alias("r2"), F.regr_slope(y, x).alias("slope"), sxx.alias("_xx"), syy.alias("_yy"), sxy.alias("_xy"))
    error = F.sqrt(F.greatest(F.lit(0.0), (F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx")) / (F.col("n") - 2) / F.col("_xx")))
    return out.filter("n > 2 and _xx > 0").select(*keys, "n", "r2", "slope", error.alias("std_error"))


def plane(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares plane v = a x + b y + c of each raster, from the centred normal equations."""
    p = pixels.filter("v is not null").select(*keys, F.col("gx").cast("double").alias("x"), F.col("gy").cast("double").alias("y"), "v")
    s = p.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("v").alias("mv"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "v").alias("xv"), F.covar_pop("y", "v").alias("yv"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumn("det", det).filter("det > 1e-12")
    s = s.withColumn("a", (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy")) / F.col("det")).withColumn("b", (F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy")) / F.col("det"))
    return s.select(*keys, "n", "a", "b", (F.col("mv") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))


def interpolated(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """Trilinear values of a cube at points (id, y, x, z), in units of the cube's nodes; null outside.

    `nodes` (iy, ix, iz, v) is a regular grid. Each point meets its eight corners by equality joins.
    """
    floors = points.withColumns({f"_{k}": F.floor(k) for k in "yxz"})
    corners = F.array(*[F.struct(*[F.lit(b).alias(k) for k, b in zip("abc", (i >> 2 & 1, i >> 1 & 1, i & 1), strict=True)]) for i in range(8)])
    spread = floors.withColumn("_k", F.explode(corners))
    for axis, k in zip("yxz", "abc", strict=True):
        spread = spread.withColumn(f"i{axis}", F.col(f"_{axis}") + F.col(f"_k.{k}"))
    weight = F.lit(1.0)
    for axis in "yxz":
        weight = weight * (1 - F.abs(F.col(axis) - F.col(f"i{axis}")))
    met = spread.withColumn("_w", weight).filter("_w > 0").join(nodes, ["iy", "ix", "iz"], "left")
    return met.groupBy("id").agg(F.when(F.count_if(F.col("v").isNull()) == 0, F.sum(F.col("_w") * F.col("v"))).alias("v"))
