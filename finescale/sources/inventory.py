"""Which months exist, which are missing, and whether an hourly axis is whole."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finescale.functions.physics import ColumnLike, _c


def months_of_files(spark: SparkSession, path: str, pattern: str = r"_(\d{4})_?(\d{2})\.[a-z]+$") -> DataFrame:
    """Distinct ``(ano, mes)`` in the file names under ``path`` (contents are not read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    year = F.regexp_extract("path", pattern, 1)
    return (files.filter(year != "").select(year.cast("int").alias("ano"),
                                            F.regexp_extract("path", pattern, 2).cast("int").alias("mes")).distinct())


def months_of(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.select(F.year(ts).alias("ano"), F.month(ts).alias("mes")).distinct()


def month_key(ano: ColumnLike = "ano", mes: ColumnLike = "mes") -> Column:
    return F.date_format(F.make_date(_c(ano), _c(mes), F.lit(1)), "yyyyMM")


def expected_months(spark: SparkSession, first: date, last: date) -> DataFrame:
    start, end = F.lit(first).cast("date"), F.lit(last).cast("date")
    return (spark.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))).alias("d"))
            .select(F.year("d").alias("ano"), F.month("d").alias("mes")))


def month_gaps(present: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.join(present, ["ano", "mes"], "left_anti")


def common_months(sources: Sequence[DataFrame], expected: DataFrame) -> DataFrame:
    out = expected
    for s in sources:
        out = out.join(s, ["ano", "mes"], "left_semi")
    return out


def coverage_report(sources: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Per source and for their common months: first, last, count and gaps within ``expected``."""
    parts = dict(sources) | {"comum": common_months(list(sources.values()), expected)}
    out = None
    for name, months in parts.items():
        has = months.select("ano", "mes", F.lit(True).alias("_has"))
        marked = (expected.withColumn("_exp", F.lit(True)).join(has, ["ano", "mes"], "full"))
        row = marked.agg(
            F.min(F.when(F.col("_has"), month_key())).alias("first"), F.max(F.when(F.col("_has"), month_key())).alias("last"),
            F.count_if("_has").alias("n"), F.count_if(F.col("_exp") & F.col("_has").isNull()).alias("n_gaps"))
        row = row.select(F.lit(name).alias("fonte"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def prune_months(df: DataFrame, months: DataFrame, ts: str = "ts") -> DataFrame:
    """Keep rows of the available months (a few hundred rows, broadcast by size)."""
    ym = df.withColumns({"ano": F.year(ts), "mes": F.month(ts)})
    return ym.join(months, ["ano", "mes"], "left_semi").drop("ano", "mes")


def hourly_axis(spans: DataFrame, start: str = "start", end: str = "end", unit: str = "HOUR") -> DataFrame:
    """Every hour of each row's ``[start, end]``."""
    return spans.withColumn("ts", F.explode(F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL 1 {unit}"))))


def axis_problems(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", span: tuple[str, str] | None = None) -> DataFrame:
    """``(keys, month, n, expected, missing, extra)`` of the months whose hourly axis is not canonical.

    A month without any row is one of them (``n`` 0) if it lies between a series' first and last month, or within ``span`` (two dates).
    Compared per series and month by counting, so no canonical axis is joined: an axis is whole
    when it has days*24 distinct on-the-hour stamps and no other row.
    """
    month = F.date_trunc("month", ts).cast("timestamp_ntz")
    on_hour = F.date_trunc("hour", ts).cast("timestamp_ntz") == F.col(ts)
    hours = F.dayofmonth(F.last_day("month")) * 24
    per = (df.groupBy(*keys, month.alias("month"), F.col(ts).alias("_t"), on_hour.alias("_ok"))
           .agg(F.count("*").alias("_c"))
           .groupBy(*keys, "month").agg(F.sum("_c").alias("n"), F.count_if("_ok").alias("_whole")))
    first, last = ((F.min("month"), F.max("month")) if span is None else
                   (F.trunc(F.lit(s).cast("date"), "month").cast("timestamp_ntz") for s in span))
    whole = F.explode(F.sequence("_first", "_last", F.expr("INTERVAL 1 MONTH")))
    bounds = per.groupBy(*keys).agg(F.min("month").alias("_own"), first.alias("_first"), last.alias("_last")).filter("_own IS NOT NULL")
    known = per.select(*keys, "month")
    absent = (bounds.select(*keys, whole.alias("month")).join(known, [*keys, "month"], "left_anti")
              .withColumns({"n": F.lit(0).cast("bigint"), "_whole": F.lit(0).cast("bigint")}))
    per = per.unionByName(absent)
    return (per.withColumn("expected", hours.cast("bigint"))
            .withColumn("missing", F.col("expected") - F.col("_whole"))
            .withColumn("extra", F.col("n") - F.col("_whole"))
            .filter("missing > 0 OR extra > 0").drop("_whole"))


def check_hourly_axis(df: DataFrame, keys: Sequence[str] = (), ts: str = "ts", span: tuple[str, str] | None = None) -> DataFrame:
    """Return ``df``; raise when a month is incomplete or off the hourly grid."""
    if not axis_problems(df, keys, ts, span).isEmpty():
        raise ValueError("the hourly time axis is incomplete or off the canonical hours")
    return df


def adopt_axis(df: DataFrame, step: str, start: str) -> DataFrame:
    """Hours for a source whose time axis is only a step number 0, 1, 2, ..."""
    first = F.lit(start).cast("timestamp_ntz")
    return df.withColumn("ts", first + F.make_dt_interval(hours=F.col(step).cast("int"))).drop(step)
