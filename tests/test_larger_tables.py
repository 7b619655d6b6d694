"""What only larger copies of the tables showed: sides multiplied by an explode and broadcast, inputs read twice, rows far out."""
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from checks import CHECKS
from checks.compare import compare, duck
from finescale.functions import physics as P
from finescale.operators import anchoring as A
from finescale.operators import grid as G
from finescale.operators import lines as L
from finescale.operators import neighbours as N
from finescale.operators import skill as S
from finescale.operators import tables as T
from finescale.operators.quantiles import exact_quantiles


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


POINTS = "SELECT CAST(id AS INT) AS iy, 0 AS ix, id * 1.0D AS x, id * 2.0D AS y, id AS station, id AS vertex, id * 1.0D AS x1, id * 1.0D AS y1, id + 3.0D AS x2, id + 1.0D AS y2 FROM range(300)"


@pytest.mark.parametrize("join", [
    lambda p: N.knn(p, p, 2), lambda p: N.nearest_distance(p, p), lambda p: N.within_radius(p, p, 30.0),
    lambda p: L.distance_to_lines(p, p.select("x1", "y1", "x2", "y2"))], ids=["knn", "nearest", "radius", "lines"])
def test_rows_multiplied_by_tiles_are_not_broadcast(spark, join):
    text = plan(join(spark.sql(POINTS)))
    assert "SortMergeJoin [level" in text or "SortMergeJoin [tx" in text
    assert not re.search(r"BroadcastHashJoin \[(level|tx)", text)


def test_scattered_values_are_not_broadcast(spark):
    grid = spark.sql("SELECT CAST(id AS INT) AS iy, 0 AS ix FROM range(20)")
    hours = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts")
    text = plan(G.scatter(grid, grid.crossJoin(hours).withColumn("v", F.lit(1.0)), hours))
    assert "SortMergeJoin [iy" in text and "BroadcastHashJoin [iy" not in text


def test_humidity_without_saturation_pressure_is_missing(spark):
    t = spark.sql("SELECT explode(array(20D, -243.5D, -243.501D, -243.499D)) AS t")
    assert [r[0] for r in t.select(P.relative_humidity("t", F.lit(20.0))).collect()][:2] == [pytest.approx(100.0), None]
    assert t.select(P.relative_humidity("t", "t")).count() == 4


def test_quantiles_of_values_that_change_their_last_bits(spark):
    rng = random.Random(5)
    noise = F.udf(lambda: random.random() * 1e-14, "double").asNondeterministic()
    df = spark.createDataFrame([(rng.choice([0.1, 0.25, 0.7]),) for _ in range(400)], "v DOUBLE").withColumn("v", F.col("v") * (1 + noise()))
    got = {r["q"]: r["value"] for r in exact_quantiles(df, "v", [0.1, 0.5, 0.9]).collect()}
    assert sorted(got) == [0.1, 0.5, 0.9] and None not in got.values()


def test_bootstrap_does_not_broadcast_its_draws(spark):
    data = spark.sql("SELECT id AS idx, id % 7 * 1.0D AS _v FROM range(50)")
    sent = re.search(r"BroadcastHashJoin \[idx#\d+L?\], \[idx#\d+L?\], Inner, (\w+)", plan(S.bootstrap_draws(data, 20)))
    assert sent and sent.group(1) == "BuildRight"


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """sf0.001 six times, keys shifted; some users lack some days."""
    src, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("copies")
    con = duckdb.connect()
    users = con.execute(f"SELECT max(user_id) + 1 FROM '{src}/events.parquet'").fetchone()[0]
    rows = con.execute(f"SELECT max(c_custkey) + 1 FROM '{src}/customer.parquet'").fetchone()[0]
    for name in os.listdir(src):
        os.symlink(f"{src}/{name}", out / name) if name not in ("events.parquet", "customer.parquet") else None
    con.execute(f"COPY (SELECT * REPLACE (user_id + i * {users} AS user_id, event_id + i * 1000000 AS event_id) FROM '{src}/events.parquet', range(6) t(i) "
                f"WHERE (user_id + i + day(ts)) % 9 <> 0) TO '{out}/events.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (c_custkey + i * {rows} AS c_custkey) FROM '{src}/customer.parquet', range(6) t(i)) TO '{out}/customer.parquet'")
    return str(out)


@pytest.mark.parametrize("name", ["scoring_rows"])
def test_copies_equal_their_sql(spark, copies, name):
    assert name in CHECKS and compare(spark, duck(copies), copies, name).startswith("ok")


def test_parts_of_a_leave_one_out_run_equal_the_whole(spark):
    """A long network, a crowd at one place, absent hours, a station without a place: small parts against one part."""
    rng = random.Random(8)
    st = [(i, rng.uniform(0, 50), i * 40.0, rng.choice([None, 100.0 * (i % 9)])) for i in range(120)]
    st += [(200 + i, 7.0, 9.0, 50.0) for i in range(30)] + [(300, None, None, 1.0)]
    stations = spark.createDataFrame(st, "station INT, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    inc = spark.createDataFrame([(s[0], h, rng.uniform(-3, 3) if rng.random() < 0.9 else None) for s in st for h in (1, 2, 500) if rng.random() < 0.8],
                                "station INT, h INT, inc DOUBLE").selectExpr("station", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) AS ts", "inc")
    rules = A.rules_of(ks=[3, 7], powers=[1], lengths=[2, 15], lzs=[0, 300])
    rows = [{(r["station"], r["ts"]): r["hats"] for r in A.loo_anchor(inc, stations, rules, targets=n).collect()} for n in (8, 10 ** 6)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) == inc.count()
    for key, hats in rows[0].items():
        assert hats == pytest.approx(rows[1][key], abs=1e-12)
    assert any(h != 0 for k, v in rows[0].items() if k[0] == 60 for h in v) and all(h == 0 for k, v in rows[0].items() if k[0] == 300 for h in v)


@pytest.mark.parametrize("rule", [dict(length_km=20.0, lz_m=400.0), dict(length_km=2.0), dict(length_km=30.0, radius_km=25.0)])
def test_gauss_from_places_equals_gauss_from_pairs(spark, rule):
    rng = random.Random(3)
    cells = spark.createDataFrame([(i, j, i * 2.0, j * 2.0, rng.choice([None, 100.0 * i])) for i in range(-3, 40) for j in range(0, 12, 5)], "iy INT, ix INT, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    st = [(i, rng.uniform(-10, 90), rng.uniform(-10, 30), rng.choice([None, 50.0 * i])) for i in range(40)] + [(99, None, 1.0, 1.0), (98, 1e5, 1e5, 0.0)]
    stations = spark.createDataFrame(st, "station INT, x_km DOUBLE, y_km DOUBLE, z_m DOUBLE")
    inc = spark.createDataFrame([(s[0], h, rng.uniform(-3, 3) if rng.random() < 0.9 else None) for s in st for h in (1, 2, 900) if rng.random() < 0.7],
                                "station INT, h INT, inc DOUBLE").selectExpr("station", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, h) AS ts", "inc")
    field = cells.select("iy", "ix", F.lit(1.0).alias("T_final")).crossJoin(inc.select("ts").distinct())
    want = A.anchor(field, A.neighbours(cells, stations, method="gauss", **rule), inc).orderBy("iy", "ix", "ts").collect()
    got = A.anchor_gauss(field, cells, stations, inc, **rule)
    assert "Window" not in plan(got)
    got = got.orderBy("iy", "ix", "ts").collect()
    assert [(r["iy"], r["ix"], r["ts"]) for r in got] == [(r["iy"], r["ix"], r["ts"]) for r in want] and any(r["T_final_oi"] for r in got)
    assert [r["T_final_oi"] for r in got] == pytest.approx([r["T_final_oi"] for r in want], abs=1e-9)


def test_a_stack_of_cells_and_hours_is_not_broadcast(spark):
    cells = spark.sql("SELECT CAST(id AS INT) AS iy, 0 AS ix FROM range(20)")
    hours = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts FROM range(48)")
    stack = G.expand_hours(cells, hours)
    text = plan(T.attach_stack(stack.withColumn("v", F.lit(1.0)), stack))
    assert "SortMergeJoin [iy" in text and "BroadcastHashJoin [iy" not in text
