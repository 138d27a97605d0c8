"""Whole workflows on small relations, and the commands."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from terrafringe.__main__ import main
from terrafringe.plans import workflows as W
from terrafringe.plans.fixtures import relation
from terrafringe.plans.queries import QUERIES


def test_layers_and_requests():
    assert W.chosen_layers("standard, amplitude, none", ["amplitude", "coherence", "unwrappedPhase"]) == (["unwrappedPhase", "coherence", "amplitude"], ["incidenceAngle", "azimuthAngle", "none"])
    for bad in ((["incidenceAngle"], False, []), (["troposphereWet"], True, []), (["coherence"], True, ["ERA5"]), (["troposphereWet"], True, ["X"])):
        with pytest.raises(ValueError):
            W.check_request(*bad)
    W.check_request(["troposphereWet"], True, ["ERA5"])


def test_misclosure_command_agrees_with_the_query(spark, tmp_path):
    relation(spark, SMALL, "fx_ifg_px").write.parquet(str(tmp_path / "in"))
    main(["misclosure", str(tmp_path / "in"), str(tmp_path / "out")], spark)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(QUERIES["misclosure"](spark, SMALL).collect())


def test_misclosure_limits(spark):
    phases = relation(spark, SMALL, "fx_ifg_px")
    excluded = phases.select("younger", "older").distinct()
    assert W.misclosure(phases, excluded=excluded).count() == 0
    some = W.misclosure(phases, start="1996-01-01", end="1996-12-31", least_days=28, reference=None)
    assert 0 < some.agg(F.sum("n")).first()[0] < QUERIES["misclosure"](spark, SMALL).agg(F.sum("n")).first()[0]


def test_extract(spark):
    tiles = relation(spark, SMALL, "fx_tile_px")
    mask = spark.range(9).select(F.col("id").alias("gy")).crossJoin(spark.range(8).select(F.col("id").alias("gx"))).withColumn("mask", F.lit(1.0))
    whole = W.extract(tiles)
    cropped = W.extract(tiles, W.Window(0, 8, 0, 7), mask)
    assert cropped.filter("v is not null").count() == whole.filter("gy <= 8").count()
    assert 0 < W.extract(tiles, looks=4).count() <= whole.count() / 4


def test_series_and_reference(spark):
    phases = relation(spark, SMALL, "fx_ifg_px").withColumnRenamed("phase", "v")
    bperp = phases.select("younger", "older").distinct().limit(3).withColumn("bperp", F.lit(12.5))
    out = W.time_series({"unwrappedPhase": phases, "coherence": phases.filter("gy < 3")}, bperp, 0.0556)
    assert out.filter("layer = 'coherence'").count() <= out.filter("layer = 'unwrappedPhase'").count()
    assert out.filter("bperp is not null and layer = 'unwrappedPhase'").count() == 3
    coherence = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.9), (1, 2, 0.9)], "gy long, gx long, v double")
    assert W.reference_pixel(coherence) == (1, 2)
    assert W.reference_pixel(coherence, 0.95) is None


def test_assist_and_search(spark):
    found = W.area_assist(relation(spark, SMALL, "fx_frames"), south=1.0)
    assert found.count() > 0 and set(found.columns) >= {"path", "day", "n_frames", "n_gaps", "complete"}
    day = datetime.date
    scenes = spark.createDataFrame([("S1-GUNW-x-v3_0_1.nc", 71, "D", day(2021, 12, 26), day(2021, 12, 14)), ("S1-GUNW-y-v2_0_5.nc", 71, "D", day(2022, 1, 7), day(2021, 12, 14)), ("S1-GUNW-z-v3_0_1.nc", 4, "A", day(2021, 12, 26), day(2021, 12, 14))], "file_name string, path long, direction string, younger date, older date")
    assert W.scene_search(scenes, track=71, version="3_0_1").count() == 1
    assert W.scene_search(scenes, pair=("2022-01-07", "2021-12-14")).first().file_name.startswith("S1-GUNW-y")
    assert W.scene_search(scenes, start="2021-12-01", end="2021-12-31", most_days=12, most=1).count() == 1
