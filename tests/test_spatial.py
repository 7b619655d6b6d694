"""Areas, line work and raster windows against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from finescale.operators import grid as G
from finescale.operators import lines as L
from finescale.operators import raster as R
from finescale.sources import writers as W
from tests.helpers import rows


def distance(x, y, s):
    (x1, y1, x2, y2), dx, dy = s, s[2] - s[0], s[3] - s[1]
    t = max(0.0, min(1.0, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return math.hypot(x - x1 - t * dx, y - y1 - t * dy)


@pytest.mark.parametrize("kind", ["short", "long", "points", "one", "axis"])
def test_distance_to_lines(spark, kind):
    random.seed(kind)
    u = lambda a, b: random.uniform(a, b)
    segments = {"short": [(x, y, x + u(-1, 1), y + u(-1, 1)) for x, y in [(u(-50, 50), u(0, 9)) for _ in range(300)]],
                "long": [(u(-50, 50), u(-50, 50), u(-500, 500), u(-50, 50)) for _ in range(40)] + [(0.0, 0.0, 0.1, 0.1)] * 60,
                "points": [(x, y, x, y) for x, y in [(u(-5, 5), u(-5, 5)) for _ in range(50)]], "one": [(3.0, 4.0, 3.0, 4.0)],
                "axis": [(float(k), 2.0, float(k), 8.0) for k in range(20)] + [(0.0, 4.0, 16.0, 4.0), (16.0, 0.0, 0.0, 0.0)]}[kind]
    targets = [(k, 0, u(-80, 80), u(-80, 80)) for k in range(150)] + [(200, 0, 4.0, 4.0), (201, 0, 1e5, -1e5), (202, 0, 8.0, 0.0)]
    tg = spark.createDataFrame([*targets, (300, 0, None, 1.0)], "iy INT, ix INT, x DOUBLE, y DOUBLE")
    seg = spark.createDataFrame([*segments, (None, 0.0, 1.0, 1.0)], "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    got = {r.iy: r.dist_oceano for r in L.distance_to_lines(tg, seg).collect()}
    assert got.keys() == {t[0] for t in targets}
    for k, _, x, y in targets:
        assert got[k] == pytest.approx(min(distance(x, y, s) for s in segments), abs=1e-9)


def test_no_line_no_distance(spark):
    tg = spark.createDataFrame([(0, 0, 1.0, 1.0)], "iy INT, ix INT, x DOUBLE, y DOUBLE")
    assert L.distance_to_lines(tg, spark.createDataFrame([], "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")).collect() == []


def test_densify(spark):
    seg = spark.createDataFrame([(0.0, 0.0, 3.0, 4.0), (1.0, 1.0, 1.0, 1.0)], "x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE")
    assert rows(L.densify(seg, 2.5), "x", "y") == [(0.0, 0.0), (1.0, 1.0), (1.0, 1.0), (1.5, 2.0), (3.0, 4.0)]


def test_shares_of_pixels_finer_and_coarser_than_cells(spark):
    random.seed(2)
    places = [(k, random.uniform(-9, 9), random.uniform(-9, 9)) for k in range(60)] + [(60, 0.5, 0.5), (61, 1.0, 1.0)]
    pixels = spark.createDataFrame([*places, (99, None, 1.0)], "id INT, x DOUBLE, y DOUBLE")
    for w, h in ((0.3, 0.4), (1.0, 1.0), (3.7, 2.2)):
        got = {}
        for r in R.cell_shares(pixels, (0.0, 0.0), (1.0, 1.0), (w, h)).collect():
            assert r.share > 0
            got.setdefault(r.id, {})[r.iy, r.ix] = r.share
        assert got.keys() == {p[0] for p in places}
        for k, x, y in places:
            assert sum(got[k].values()) == pytest.approx(1.0, abs=1e-12)
            for (iy, ix), share in got[k].items():
                inside = max(0, min(x + w / 2, ix + 1) - max(x - w / 2, ix)) * max(0, min(y + h / 2, iy + 1) - max(y - h / 2, iy))
                assert share == pytest.approx(inside / (w * h), abs=1e-9)


def test_area_fractions(spark):
    """A pixel half in each of two cells counts half in each."""
    pixels = spark.createDataFrame([(1.0, 0.5, 3), (0.25, 0.5, 9), (1.5, 0.5, 77)], "x DOUBLE, y DOUBLE, code INT")
    lookup = spark.createDataFrame([(3, "T1"), (9, "T2")], "code INT, grupo STRING")
    out = R.area_fractions(R.cell_shares(pixels, (0.0, 0.0), (1.0, 1.0), (0.5, 0.5)), lookup)
    assert rows(out.select("ix", "fracao_t1", "fracao_t2", F.round("fracao_observada", 9)), "ix") == [
        (0, pytest.approx(1 / 3), pytest.approx(2 / 3), 1.0), (1, 1.0, 0.0, pytest.approx(1 / 3))]
    assert out.agg(F.max(F.abs(sum(F.col(f"fracao_t{i}") for i in range(1, 9)) - 1))).first()[0] < 1e-12


def scanned(df):
    """Rows that left the file scan of a collected frame."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    return sum(leaf.metrics().apply("numOutputRows").value() for leaf in [plan.collectLeaves().apply(k) for k in range(plan.collectLeaves().size())])


def test_a_window_reads_a_part_of_the_raster(spark, tmp_path):
    pixels = spark.range(512 * 512).select((F.col("id") % 512 - 100).alias("px"), F.floor(F.col("id") / 512).alias("py"), F.col("id").alias("value"))
    W.write_pixels(pixels, f"{tmp_path}/z", block=16, rows=4096, partitions=4)
    pixels.repartition(4).write.parquet(f"{tmp_path}/plain")
    window = ((-40, 20), (100, 160))
    found, plain = (G.bbox_scan(spark.read.parquet(f"{tmp_path}/{n}"), *window) for n in ("z", "plain"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) and found.count() == 61 * 61
    assert 61 * 61 <= scanned(found) < scanned(plain) / 8
    assert spark.read.parquet(f"{tmp_path}/z").columns == ["px", "py", "value"]


def test_morton(spark):
    places = spark.createDataFrame([(x, y) for x in (-2, -1, 0, 1) for y in (-2, -1, 0, 1)], "bx BIGINT, by BIGINT")
    got = {(r.bx, r.by): r.m for r in places.withColumn("m", W.morton("bx", "by", 2)).collect()}
    bits = lambda v, k: (v >> k) & 1
    assert all(m == sum(bits(x + 2, k) << 2 * k | bits(y + 2, k) << 2 * k + 1 for k in range(2)) for (x, y), m in got.items())
