"""Polygon algebra on rings of (x, y), in numpy, and as Pandas functions over arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The WGS 84 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def ring_area(ring: np.ndarray) -> float:
    """Signed area, positive for counter-clockwise rings."""
    if len(ring) < 3:
        return 0.0
    x, y = ring[:, 0], ring[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def equal_area(ring: np.ndarray) -> np.ndarray:
    """Longitudes and latitudes in degrees on a cylindrical equal-area plane of the ellipsoid, in metres."""
    e = np.sqrt(FLATTENING * (2 - FLATTENING))
    sine = np.sin(np.radians(ring[:, 1]))
    q = (1 - e * e) * (sine / (1 - e * e * sine * sine) + np.arctanh(e * sine) / e)
    return np.stack([SEMI_MAJOR * np.radians(ring[:, 0]), SEMI_MAJOR * q / 2], 1)


def area_km2(ring: np.ndarray, geographic: bool = True) -> float:
    """Area of a ring in square kilometres; edges are straight on the equal-area plane."""
    ring = np.asarray(ring, float).reshape(-1, 2)
    return abs(ring_area(equal_area(ring) if geographic else ring)) / 1e6


def clip(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex one, by cutting along each of its edges."""
    out = np.asarray(subject, float).reshape(-1, 2)
    window = np.asarray(window, float).reshape(-1, 2)
    if ring_area(window) < 0:
        window = window[::-1]
    for a, b in zip(window, np.roll(window, -1, 0), strict=True):
        if not len(out) or (a == b).all():
            continue
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        cut = []
        for p, q, s, t in zip(out, np.roll(out, -1, 0), side, np.roll(side, -1), strict=True):
            if s >= 0:
                cut.append(p)
            if s * t < 0:
                cut.append(p + (q - p) * s / (s - t))
        out = np.array(cut).reshape(-1, 2)
    return out


def overlap_ratios(first: np.ndarray, second: np.ndarray) -> tuple[float, float]:
    """Area of the intersection by the areas of both rings."""
    shared = abs(ring_area(clip(first, second)))
    return shared / abs(ring_area(np.asarray(first, float))), shared / abs(ring_area(np.asarray(second, float)))


def simplified(ring: np.ndarray, reach: float = 0.05) -> np.ndarray:
    """Means of runs of vertices that stay within `reach` of the run's first one."""
    groups: list[list[np.ndarray]] = []
    for p in np.asarray(ring, float).reshape(-1, 2):
        if groups and np.hypot(*(p - groups[-1][0])) <= reach:
            groups[-1].append(p)
        else:
            groups.append([p])
    return np.array([np.mean(g, 0) for g in groups]).reshape(-1, 2)


def trimmed(ring: np.ndarray, margin: float = 0.2) -> np.ndarray:
    """The two lowest and the two highest vertices along the ring's main axis, moved inwards by `margin`."""
    points = np.asarray(ring, float).reshape(-1, 2)
    centre = points.mean(0)
    axis = np.linalg.svd(points - centre, full_matrices=False)[2][0]
    along = (points - centre) @ axis
    order = np.argsort(along)
    out = points.copy()
    out[order[:2]] += margin * axis
    out[order[-2:]] -= margin * axis
    return out


def contains(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie in a ring, by crossings of a ray."""
    inside = np.zeros(len(x), bool)
    ring = np.asarray(ring, float).reshape(-1, 2)
    for (x0, y0), (x1, y1) in zip(ring, np.roll(ring, -1, 0), strict=True):
        crosses = (y0 > y) != (y1 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            inside ^= crosses & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return inside


def parse_bbox(text: str) -> np.ndarray:
    """`S N W E` as a counter-clockwise ring."""
    s, n, w, e = map(float, text.split())
    if s >= n or w >= e:
        raise ValueError("a box is given as south, north, west, east")
    return np.array([[w, s], [e, s], [e, n], [w, n]])


def _ring(values) -> np.ndarray:
    return np.array([list(p) for p in values], float).reshape(-1, 2)


def _areas(rings: pd.Series) -> pd.Series:
    return rings.map(lambda r: None if r is None else area_km2(_ring(r))).astype(float)


def _shares(first: pd.Series, second: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else overlap_ratios(_ring(a), _ring(b))[0] for a, b in zip(first, second, strict=True)], dtype=float)


def ring_area_km2(ring: Column) -> Column:
    """Area of each ring (array of [lon, lat]) in square kilometres; null for null."""
    return F.pandas_udf(_areas, "double")(ring)


def overlap_share(first: Column, second: Column) -> Column:
    """Share of each first ring's area that lies in the second, which is convex; null for null."""
    return F.pandas_udf(_shares, "double")(first, second)
