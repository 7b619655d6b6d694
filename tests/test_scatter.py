"""Values on the full grid: every observed hour, whole days met as lists."""

import os

import pytest
from pyspark.sql import functions as F

from checks import CHECKS
from checks.base import cells, obs_cell
from finescale.operators import grid as G
from tests.helpers import at

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
def test_every_observed_hour_is_scattered(spark):
    seen = obs_cell(spark, SF).join(cells(spark, SF).select("iy", "ix"), ["iy", "ix"])
    want = sorted((r["iy"], r["ix"], r["ts"]) for r in seen.collect())
    got = CHECKS["scatter"](spark, SF).cache()
    assert sorted((r["iy"], r["ix"], r["ts"]) for r in got.filter("temperatura_c_qc IS NOT NULL").collect()) == want
    assert {r["ts"].hour for r in got.select("ts").distinct().collect()} == set(range(24))
    assert got.count() == cells(spark, SF).count() * len({w[2] for w in want})
    got.unpersist()


def test_lists_of_a_day_equal_a_left_join(spark):
    grid = spark.createDataFrame([(0, 0, "a"), (0, 1, None), (1, 0, "c"), (1, 0, "twice"), (None, 1, "d")], "iy INT, ix INT, name STRING")
    hours = spark.createDataFrame([(at(h),) for h in (0, 0.25, 5, 6, 30, 31, 31)] + [(None,)], "ts TIMESTAMP_NTZ")
    values = spark.createDataFrame(
        [(0, 0, at(0), 1.0, 1), (0, 0, at(0.25), 2.0, None), (0, 0, at(6), 3.0, 3), (0, 0, at(1), 9.0, 9),      # the last at an hour not asked for
         (1, 0, at(30), 4.0, 4), (1, 0, at(30), 5.0, 5), (1, 0, at(31), None, 6),                               # two rows of a cell and hour
         (7, 7, at(0), 8.0, 8), (0, 1, None, 8.0, 8), (None, 1, at(0), 8.0, 8)], "iy INT, ix INT, ts TIMESTAMP_NTZ, v DOUBLE, n INT")
    want = grid.crossJoin(hours.distinct().filter("ts IS NOT NULL")).join(values, ["iy", "ix", "ts"], "left")
    got = G.scatter(grid, values, hours)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.filter("n IS NOT NULL").count() == 8


def test_cells_times_hours_are_not_shuffled(spark):
    grid = spark.sql("SELECT CAST(id AS INT) AS iy, 0 AS ix FROM range(20)")
    hours = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts FROM range(48)")
    values = grid.crossJoin(hours).withColumn("v", F.lit(1.0))
    text = G.scatter(grid, values, hours)._jdf.queryExecution().executedPlan().toString()
    assert 0 < text.index("Generate explode(_hours") < text.index("SortMergeJoin [iy")
