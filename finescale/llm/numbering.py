"""Positions in a sorted order without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finescale.llm.shared import written


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, the row's place from 0 within its ``group`` (not null) by ``order`` ascending, nulls first, and ``n``,
    the group's rows. Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks; a task's first row and
    count of each group are all that is added up. Rows equal in ``order`` are numbered in any order. An empty table stays empty."""
    by = [group, *order]
    at = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", at), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    runs = placed.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(group, "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(whole).alias("n"))
    return placed.join(runs, [group, "_part"]).withColumn("pos", F.expr("_row - _first + _before")).drop("_row", "_part", "_first", "_before")
