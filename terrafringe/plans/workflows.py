"""Whole workflows: what the commands do, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafringe.operators import catalog, network, raster

#: Layers of a standard time series.
STANDARD_LAYERS = ["unwrappedPhase", "coherence", "incidenceAngle", "azimuthAngle"]
DEM_LAYERS = {"incidenceAngle", "azimuthAngle", "lookAngle", "bPerpendicular", "bParallel", "solidEarthTide", "troposphereWet", "troposphereHydrostatic", "troposphereTotal"}


def chosen_layers(asked: str, available: list[str]) -> tuple[list[str], list[str]]:
    """Layers of a comma list that are available, and those that aren't; `all` and `standard` stand for several."""
    names = [x.strip() for x in asked.split(",") if x.strip()]
    names = available if names == ["all"] else [y for x in names for y in (STANDARD_LAYERS if x == "standard" else [x])]
    unique = list(dict.fromkeys(names))
    return [x for x in unique if x in available], [x for x in unique if x not in available]


def check_request(layers: list[str], dem: bool, models: list[str], known_models: tuple[str, ...] = ("ERA5", "GMAO", "HRES", "HRRR")) -> None:
    """Raise where a layer needs a DEM that isn't there, or where layers and models of the troposphere don't fit."""
    if not dem and (need := sorted(DEM_LAYERS & set(layers))):
        raise ValueError(f"these layers need a DEM: {', '.join(need)}")
    wet = any(x.startswith("troposphere") for x in layers)
    if wet != bool(models):
        raise ValueError("troposphere layers and models are given together")
    if bad := [m for m in models if m not in known_models]:
        raise ValueError(f"unknown models: {', '.join(bad)}")


@dataclass(frozen=True)
class Window:
    """Grid bounds, ends included."""

    y0: int
    y1: int
    x0: int
    x1: int


def extract(tiles: DataFrame, window: Window | None = None, mask: DataFrame | None = None, looks: int = 1, merge: str = "mean", whole_cycles: bool = False, key: str = "pair_id") -> DataFrame:
    """(key, gy, gx, v): frames stitched, cropped, masked and multilooked, in that order."""
    out = raster.stitched(raster.component_masked(tiles), key, merge=merge, whole_cycles=whole_cycles)
    if window:
        out = raster.cropped(out, window.y0, window.y1, window.x0, window.x1)
    if mask is not None:
        out = raster.masked(out, mask)
    if looks > 1:
        blocks = raster.multilook(out.withColumn("comp", F.lit(1)), looks, [key])
        out = blocks.select(key, F.col("block_y").alias("gy"), F.col("block_x").alias("gx"), "v")
    return out.select(key, "gy", "gx", "v")


def time_series(layers: dict[str, DataFrame], bperp: DataFrame, wavelength: float) -> DataFrame:
    """Bands of all layers' stacks (layer, younger, older, band, n, mean, bperp, wavelength), for pairs that the first layer has."""
    base = None
    parts = []
    for name, pixels in layers.items():
        pair = F.struct("younger", "older")
        kept = pixels if base is None else pixels.join(base, ["younger", "older"], "left_semi")
        base = pixels.select("younger", "older").distinct() if base is None else base
        bands = raster.stacked(kept.withColumn("_pair", pair), "_pair").select(F.lit(name).alias("layer"), "_pair.younger", "_pair.older", "band", "n", "mean")
        parts.append(bands)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.join(bperp.select("younger", "older", "bperp"), ["younger", "older"], "left").withColumn("wavelength", F.lit(wavelength)).select("layer", "younger", "older", "band", "n", "mean", "bperp", "wavelength")


def misclosure(phases: DataFrame, start: str | None = None, end: str | None = None, excluded: DataFrame | None = None, least_days: int | None = None, most_days: int | None = None, reference: tuple[int, int] | None = None) -> DataFrame:
    """Cumulative misclosure at each pixel over the triplets of the pairs that are left."""
    if start:
        phases = phases.filter(F.col("older") >= F.lit(start).cast("date"))
    if end:
        phases = phases.filter(F.col("younger") <= F.lit(end).cast("date"))
    if excluded is not None:
        phases = phases.join(excluded.select("younger", "older"), ["younger", "older"], "left_anti")
    if reference:
        phases = network.referenced(phases, *reference)
    found = network.triplets(phases.select("younger", "older").distinct(), least_days, most_days)
    return network.cumulative_misclosure(network.misclosure_pixels(phases, found))


def reference_pixel(coherence: DataFrame, least: float = 0.7) -> tuple[int, int] | None:
    """The pixel of the highest mean coherence of at least `least`, the first in order of equal ones."""
    row = coherence.groupBy("gy", "gx").agg(F.avg("v").alias("m")).filter(F.col("m") >= least).orderBy(F.desc("m"), "gy", "gx").limit(1).collect()
    return (row[0]["gy"], row[0]["gx"]) if row else None


def area_assist(frames: DataFrame, excluded: DataFrame | None = None, **limits) -> DataFrame:
    """Passes of a path and common date with their frames, gaps and extents; complete where there is no gap and the extent covers what all passes share."""
    kept = catalog.selected_frames(frames, **limits)
    dated = catalog.common_dates(kept, ["path"]).withColumn("day", F.col("common").cast("date"))
    if excluded is not None:
        dated = dated.join(excluded.select(F.col("day").cast("date").alias("day")), "day", "left_anti")
    passes = catalog.continuity(dated, ["path", "day"])
    shared = passes.groupBy("path").agg(F.min("north").alias("_n"), F.max("south").alias("_s"))
    return passes.join(shared, "path").withColumn("complete", (F.col("n_gaps") == 0) & (F.col("south") <= F.col("_s")) & (F.col("north") >= F.col("_n"))).drop("_n", "_s")


def scene_search(scenes: DataFrame, track: int | None = None, direction: str | None = None, version: str | None = None, pair: tuple[str, str] | None = None, start: str | None = None, end: str | None = None, least_days: int = 0, most_days: int = 1 << 30, most: int | None = 250) -> DataFrame:
    """Scenes of a catalogue table (file_name, path, direction, younger, older) that fit, in order of their names."""
    out = catalog.of_version(scenes, version)
    if track is not None:
        out = out.filter(F.col("path") == track)
    if direction:
        out = out.filter(F.col("direction") == direction)
    if pair:
        a, b = sorted(pair)
        out = out.filter((F.least("younger", "older") == F.lit(a).cast("date")) & (F.greatest("younger", "older") == F.lit(b).cast("date")))
    out = catalog.within_dates(out, start or "0001-01-01", end or "9999-12-31", least_days, most_days).orderBy("file_name")
    return out if most is None else out.limit(most)
