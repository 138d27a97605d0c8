"""Geometry, inversion, surfaces, sources and the stream, against values worked out apart."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafringe.functions import geometry as G
from terrafringe.operators import network as N
from terrafringe.operators import raster as R
from terrafringe.operators import surface as U
from terrafringe.sources import envi, text
from terrafringe.streaming.islands import passes

BOX = np.array([[0, 0], [2, 0], [2, 2], [0, 2]], float)


def test_clip_and_ratios():
    other = BOX + 1
    assert G.ring_area(G.clip(BOX, other)) == pytest.approx(1)
    assert G.overlap_ratios(BOX, other) == pytest.approx((0.25, 0.25))
    assert len(G.clip(BOX, BOX + 5)) == 0


def test_area_of_a_degree():
    ring = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    assert G.area_km2(ring) == pytest.approx(12308.8, rel=1e-4)
    assert G.area_km2(ring * 1000, geographic=False) == pytest.approx(1.0)


def test_bbox_and_points():
    ring = G.parse_bbox("34.6 34.8 -118.1 -117.9")
    assert G.ring_area(ring) > 0
    assert G.contains(ring, np.array([-118.0, 0.0]), np.array([34.7, 34.7])).tolist() == [True, False]
    with pytest.raises(ValueError):
        G.parse_bbox("3 2 0 1")


def test_simplify_and_trim():
    assert len(G.simplified(np.array([[0, 0], [0.01, 0], [1, 1]], float))) == 2
    out = G.trimmed(np.array([[0, 0], [0, 1], [10, 0], [10, 1]], float))
    assert out[:, 0].min() > 0 and out[:, 0].max() < 10


def test_inversion_of_a_consistent_network(spark):
    days = [datetime.date(2020, 1, d) for d in (1, 13, 25)]
    rows = [(days[1], days[0], 2.0), (days[2], days[1], 3.0), (days[2], days[0], 5.0)]
    found = {r.epoch: r.cumulative for r in N.inverted_network(spark.createDataFrame(rows, "younger date, older date, value double")).collect()}
    assert [found[d] for d in days] == pytest.approx([0, 2, 5])


def test_surface_is_found_again(spark):
    rows = [(y, x, 1 + 2.0 * x - y + 0.5 * x * y) for y in range(5) for x in range(5)]
    df = spark.createDataFrame(rows, "gy long, gx long, v double")
    for kind in ("quadratic", "bilinear"):
        out = U.with_surface(df, U.fit_surface(df, kind))
        assert out.filter(F.abs(F.col("v") - F.col("surface")) > 1e-8).count() == 0


def test_points_outside_the_cube_are_null(spark):
    nodes = spark.createDataFrame([(y, x, z, float(y + x + z)) for y in (0, 1) for x in (0, 1) for z in (0, 1)], "iy long, ix long, iz long, v double")
    points = spark.createDataFrame([(1, 0.5, 0.25, 1.0), (2, 1.5, 0.0, 0.0)], "id long, y double, x double, z double")
    assert dict(R.interpolated(nodes, points).collect()) == {1: pytest.approx(1.75), 2: None}


def test_envi_round_trip(spark, tmp_path):
    rows = [("a", 0, 0, 1.5), ("a", 0, 1, None), ("a", 1, 1, -2.0)]
    made = envi.write_envi(spark.createDataFrame(rows, "k string, gy long, gx long, v double"), "", "k", 2, 2).first()
    (tmp_path / "a.bin").write_bytes(made.content)
    (tmp_path / "a.bin.hdr").write_text(made.header)
    found = {(r.gy, r.gx): r.v for r in envi.read_envi(spark, str(tmp_path)).collect()}
    assert found == {(0, 0): 1.5, (0, 1): None, (1, 0): None, (1, 1): -2.0}


def test_text_sources(spark, tmp_path):
    assert {r.item for r in text.read_list(spark, "20200101, 20200113 20200101").collect()} == {"20200101", "20200113"}
    (tmp_path / "d.rsc").write_text(text.key_values({"WIDTH": 10, "X_FIRST": -118.5}))
    assert text.read_key_values(spark, str(tmp_path / "d.rsc")).first().fields == {"WIDTH": "10", "X_FIRST": "-118.5"}
    ring = F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in BOX])
    (tmp_path / "p.json").write_text(spark.range(1).select(text.geojson(F.lit("0"), ring)).first()[0])
    assert text.read_geojson(spark, str(tmp_path / "p.json")).first().ring == BOX.tolist()
    (tmp_path / "p.kml").write_text("<kml><Document><Placemark><name>n</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 2,0,0 2,2,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>")
    assert text.read_kml(spark, str(tmp_path / "p.kml")).first().ring == [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]]
    assert text.url_list_name(["u-0.txt"], "u") == "u-1.txt"
    files = spark.createDataFrame([("https://x/a.nc",), ("b.h5",), ("c.txt",)], "file_name string")
    assert {r.open_path for r in text.product_files(files).collect()} == {"/vsicurl/https://x/a.nc", "b.h5"}


def test_passes_on_a_batch(spark):
    rows = [(1, datetime.datetime(2020, 1, 1, 0), 0.0, 1.0), (1, datetime.datetime(2020, 1, 1, 5), 1.0, 2.0), (1, datetime.datetime(2020, 1, 5), 0.0, 1.0)]
    found = passes(spark.createDataFrame(rows, "path long, acq timestamp, min_lat double, max_lat double"))
    assert sorted(r.n_frames for r in found.collect()) == [1, 2]
