"""Scalar expressions over names, dates, coordinates and phases; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299792458.0


def product_fields(name: Column) -> dict[str, Column]:
    """Fields of a `-`-delimited product file name: pair, dates, time of day, latitude, orbit direction and version."""
    part = F.split(name, "-")
    pair = part[6]
    place = F.element_at(F.split(part[8], "_"), 2)
    latitude = F.substring(place, 1, 2).cast("int") * F.when(place.endswith("S"), -1).otherwise(1)
    return {
        "pair_name": pair,
        "sec_date": F.to_date(F.substring(pair, 1, 8), "yyyyMMdd"),
        "ref_date": F.to_date(F.substring(pair, 10, 8), "yyyyMMdd"),
        "mid_time": part[7],
        "center_lat": latitude,
        "direction": F.when(part[2] == "D", "DESCENDING").when(part[2] == "A", "ASCENDING").otherwise("UNKNOWN"),
        "version_num": version_number(name),
        "base_name": F.regexp_extract(name, r"^(.*)-v\d+_\d+_\d+.*$", 1),
    }


def version_number(name: Column) -> Column:
    """`-v2_0_5.nc` as the number 205; null where a name has no version."""
    digits = F.regexp_replace(F.regexp_extract(name, r"(v\d+_\d+_\d+.*)\.", 1), "[v_]", "")
    return digits.try_cast("double") if hasattr(Column, "try_cast") else F.expr("null").cast("double")


def wrapped(phase: Column) -> Column:
    """Phase modulo 2 pi, from -pi up to pi."""
    return F.pmod(phase, 2 * F.pi()) - F.pi()


def wrapped_difference(difference: Column) -> Column:
    """A difference taken to the nearest whole cycle."""
    return difference - F.rint(difference / (2 * F.pi())) * 2 * F.pi()


def cycles(offset: Column) -> Column:
    """Whole 2 pi cycles nearest to an offset, away from zero at the half."""
    return F.when(offset < 0, -1).otherwise(1) * F.floor((F.abs(offset) + F.pi()) / (2 * F.pi()))


def metres_to_radians(metres: Column, wavelength: Column, incidence_degrees: Column | None = None) -> Column:
    """Two-way phase of a path length, along the line of sight if an incidence angle is given."""
    phase = metres * 4 * F.pi() / wavelength
    return phase if incidence_degrees is None else phase / F.cos(F.radians(incidence_degrees))


def wavelength_of(frequency: Column) -> Column:
    return F.lit(SPEED_OF_LIGHT) / frequency


def pixel_index(coordinate: Column, origin: Column, step: Column, nearest: bool = False) -> Column:
    """Index of a coordinate on a regular axis, with the tolerance of a hundredth of a pixel."""
    at = (coordinate - origin) / step + F.lit(0.01)
    return (F.rint(at) if nearest else F.floor(at)).cast("long")


def normalised_bbox(w: Column, s: Column, e: Column, n: Column) -> tuple[Column, Column, Column, Column]:
    """Longitudes over 180 go below zero, latitudes over 90 are taken back by 90."""
    shift = F.when((w > 180) & (e > 180), 360).otherwise(0)
    lift = F.when(n > 90, 90).otherwise(0)
    return w - shift, s - lift, e - shift, n - lift


def no_data(value: Column, *fills: float) -> Column:
    """Null for NaN and for every fill value."""
    return F.when(F.isnan(value) | value.isin(*fills), None).otherwise(value) if fills else F.nanvl(value, F.lit(None))


def filled(value: Column, fill: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(value, F.lit(None)), F.lit(fill))
