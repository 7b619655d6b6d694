"""What is written and read again, and small set operators. Paths are new folders in the shared place."""

from __future__ import annotations

import tempfile
import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from checks.base import OBS_SQL, check, obs, r6, rounded, table
from finescale.operators import series as SE
from finescale.operators import tables as T
from finescale.sources import readers as R
from finescale.sources import writers as W


def scratch(spark, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, or on this machine where it is unset."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/{name}-{uuid.uuid4().hex}"


ORDER_OBS_SQL = """
  obs AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS station, CAST(o_orderdate AS TIMESTAMP) AS data_hora_utc, o_totalprice AS v FROM orders)"""


def _order_obs(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("station"),
                                            F.col("o_orderdate").cast("timestamp_ntz").alias("data_hora_utc"), F.col("o_totalprice").alias("v"))


@check("window_at_rest", f"""WITH {ORDER_OBS_SQL}
  SELECT o_orderkey, station, data_hora_utc, v FROM obs WHERE NOT (data_hora_utc >= TIMESTAMP '1996-02-10' AND data_hora_utc < TIMESTAMP '1996-05-20')
  UNION ALL SELECT o_orderkey, station, data_hora_utc, -v FROM obs
  WHERE data_hora_utc >= TIMESTAMP '1996-02-10' AND data_hora_utc < TIMESTAMP '1996-05-20' AND month(data_hora_utc) <> 3""")
def window_at_rest(spark, d):
    path, o = scratch(spark, "obs"), _order_obs(spark, d)
    W.write_observations(o, path)
    start, end = datetime(1996, 2, 10), datetime(1996, 5, 20)
    new = o.filter((F.col("data_hora_utc") >= F.lit(start)) & (F.col("data_hora_utc") < F.lit(end)) & (F.month("data_hora_utc") != 3))
    W.overwrite_window(new.withColumn("v", -F.col("v")), path, start, end)
    return spark.read.parquet(path).select("o_orderkey", "station", "data_hora_utc", "v")


@check("load_span", f"""WITH {ORDER_OBS_SQL}
  SELECT o_orderkey, data_hora_utc, CAST(year(data_hora_utc) AS INTEGER) AS year, CAST(month(data_hora_utc) AS INTEGER) AS month FROM obs
  WHERE data_hora_utc >= TIMESTAMP '1995-11-01' AND data_hora_utc < TIMESTAMP '1996-03-01'""")
def load_span(spark, d):
    path = scratch(spark, "obs")
    W.write_observations(_order_obs(spark, d), path)
    return R.load_span(spark, path, date(1995, 11, 1), date(1996, 2, 28)).select("o_orderkey", "data_hora_utc", "year", "month")


@check("station_meta_csv", """
  SELECT CAST(c_custkey AS VARCHAR) AS station, CAST(c_custkey * 1.5 AS DOUBLE) AS altitude, CAST(c_nationkey AS DOUBLE) AS longitude,
         CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS DOUBLE) END AS latitude FROM customer""")
def station_meta_csv(spark, d):
    """Many files in two layouts; of a repeated station the row in the first file counts. Notes hold separators and quotes."""
    c, path = table(spark, d, "customer"), scratch(spark, "meta")
    k = F.col("c_custkey")
    note = F.concat(F.lit('see "map", sheet '), k.cast("string"), F.lit(', "old"'))
    rows = c.select(note.alias("Nota"), F.when(k % 7 != 0, k.cast("string")).otherwise("?").alias("Latitude"), k.cast("string").alias("Estacao"),
                    (k * 1.5).alias("Altitude"), F.col("c_nationkey").alias("Longitude"))
    rows.write.options(header=True, escape='"').csv(f"{path}/part0")
    again = rows.withColumn("Altitude", F.lit(-1.0)).select("Estacao", "Altitude", "Nota", "Longitude", "Latitude")
    again.write.options(header=True, escape='"', quoteAll=True).csv(f"{path}/part1")             # later files only repeat stations of the first
    return rounded(R.read_station_meta(spark, [f"{path}/part0", f"{path}/part1"]))


@check("station_obs_csv", """
  SELECT CAST(ts AS TIMESTAMP) AS ts, 'v,' || CAST(event_id AS VARCHAR) AS md_valor, CAST(user_id AS VARCHAR) AS md_final, count(*) AS n FROM events GROUP BY 1, 2, 3
  UNION ALL SELECT CAST(ts AS TIMESTAMP), 'v,' || CAST(event_id AS VARCHAR), NULL, count(*) FROM events GROUP BY 1, 2, 3""")
def station_obs_csv(spark, d):
    """Every event in two files of different layouts, with quoted values that hold the separator; the second has no flag in its rows."""
    path, e = scratch(spark, "obs-csv"), table(spark, d, "events")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("dt_regis"), F.concat(F.lit("v,"), F.col("event_id").cast("string")).alias("md_valor"),
                    F.col("user_id").cast("string").alias("md_final"), F.lit('a, "b", c').alias("nota"))
    rows.select("nota", "md_final", "dt_regis", "md_valor").write.options(header=True, escape='"').csv(f"{path}/a")
    rows.select("dt_regis", "md_valor", F.lit("").alias("md_final")).write.options(header=True, escape='"', emptyValue="").csv(f"{path}/b")
    found = R.read_observations(spark, [f"{path}/a", f"{path}/b"])
    return found.groupBy("ts", "md_valor", "md_final").agg(F.count("*").alias("n"))


@check("side_table_csv", "SELECT CAST(p_size AS INTEGER) AS code, 'T' || (p_size % 8 + 1) AS grupo FROM part WHERE p_size % 9 <> 0 GROUP BY ALL")
def side_table_csv(spark, d):
    path, s = scratch(spark, "map"), F.col("p_size")
    codes = table(spark, d, "part").select(s.alias("code"), F.when(s % 9 == 0, "NA").otherwise(F.concat(F.lit("T"), s % 8 + 1)).alias("grupo")).distinct()
    codes.write.options(header=True, sep=";").csv(path)
    return R.read_class_map(spark, path)


@check("lz_record", "SELECT CAST(hour(ts) AS INTEGER) AS hora, CAST(max(value) AS DOUBLE) AS lz_m FROM events GROUP BY 1")
def lz_record(spark, d):
    path = scratch(spark, "lz")
    W.write_lz_by_hour(table(spark, d, "events").groupBy(F.hour("ts").alias("hora")).agg(F.max("value").alias("lz_m")), path)
    return R.read_lz_by_hour(spark, path)


@check("oof_at_rest", f"""SELECT CAST(o_custkey AS VARCHAR) AS cell_id, CAST(o_orderdate AS TIMESTAMP) AS ts, {r6('o_totalprice / 1000')} AS y_residuo,
  {r6('o_totalprice / 2000')} AS pred_residuo FROM orders""")
def oof_at_rest(spark, d):
    path = scratch(spark, "oof")
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("cell_id"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
                                         (F.col("o_totalprice") / 1000).alias("y_residuo"), (F.col("o_totalprice") / 2000).alias("pred_residuo"), F.lit(1).alias("fold"))
    W.write_oof(o, path)
    return rounded(spark.read.parquet(path))


@check("metrics_at_rest", f"SELECT o_orderstatus AS faixa, count(*) AS n, {r6('avg(o_totalprice)', 3)} AS mae FROM orders GROUP BY 1")
def metrics_at_rest(spark, d):
    path = scratch(spark, "metrics")
    W.write_metrics(table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("faixa")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mae")), path)
    return rounded(spark.read.schema("faixa STRING, n BIGINT, mae DOUBLE").json(path), 3)


@check("union_blocks", "SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT l_orderkey, l_partkey FROM lineitem UNION ALL SELECT o_orderkey, o_custkey FROM orders")
def union_blocks(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("o_custkey"), F.col("l_orderkey").alias("o_orderkey"))
    return T.union_all([o, li, o])


@check("distinct_keys", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_keys(spark, d):
    return T.distinct_rows(table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@check("common_months", """SELECT year(o_orderdate) AS ano, month(o_orderdate) AS mes FROM orders INTERSECT SELECT year(l_shipdate), month(l_shipdate) FROM lineitem""")
def common_months(spark, d):
    months = lambda t, c: table(spark, d, t).select(F.year(c).cast("bigint").alias("ano"), F.month(c).cast("bigint").alias("mes"))
    return T.intersection(months("orders", "o_orderdate"), months("lineitem", "l_shipdate"))


@check("sorted_series", f"WITH {OBS_SQL} SELECT station, ts, event_id FROM obs ORDER BY station, ts, event_id")
def sorted_series(spark, d):
    return SE.order_series(obs(spark, d).select("station", "ts", "event_id"), ["station"], ["ts", "event_id"])
