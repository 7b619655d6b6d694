"""Leave-cell-out folds and early-stop holdouts. Whole cells move together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from finescale.operators.tables import dense_index


def assign_folds(df: DataFrame, k: int = 10, cell: str = "cell_id") -> DataFrame:
    """Add ``fold`` 0..k-1, balanced by rows: cells go serpentine over the folds, largest first.

    Cells line up by the leading four bits of their row count (so neighbours in the line differ by
    at most an eighth), then by hash. Positions come from bucket sizes plus the place inside the
    bucket, so no task sorts all cells, and no fold is empty while there are ``k`` cells.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    bits = F.length(F.bin("_n"))
    sizes = df.groupBy(cell).agg(F.count("*").alias("_n")).withColumns({
        "_bits": bits, "_top": F.expr("shiftright(_n, greatest(length(bin(_n)) - 4, 0))"),
        "_hash": F.substring(F.md5(F.col(cell).cast("string")), 1, 1)})
    bucket = ["_bits", "_top", "_hash"]
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("_bits").desc(), F.col("_top").desc(), "_hash")
    base = sizes.groupBy(*bucket).agg(F.count("*").alias("_size")).select(       # 8192 buckets at most
        *bucket, (F.sum("_size").over(line) - F.col("_size")).alias("_base"))
    inside = Window.partitionBy(*bucket).orderBy(F.col("_n").desc(), cell)
    place = F.col("_base") + F.row_number().over(inside) - 1
    lap, seat = F.floor(F.col("_place") / k), F.pmod("_place", F.lit(k))
    fold = F.when(lap % 2 == 0, seat).otherwise(k - 1 - seat).cast("int")
    placed = sizes.join(base, bucket).withColumn("_place", place)
    return df.join(placed.select(cell, fold.alias("fold")), cell)


def require_cells(df: DataFrame, k: int, cell: str = "cell_id") -> DataFrame:
    """Raise when there are fewer cells than folds (a one-row job)."""
    n = df.select(F.approx_count_distinct(cell).alias("n")).first()["n"]
    if n < 4 * k:                                         # near the limit, count exactly
        n = df.select(cell).distinct().count()
    if n < k:
        raise ValueError(f"{n} cells cannot fill {k} folds")
    return df


def carve_holdout(df: DataFrame, frac: float = 0.2, seed: int = 42, cell: str = "cell_id") -> DataFrame:
    """Add ``holdout``: a seeded choice of ``frac`` of the cells, at least one."""
    cells = dense_index(df.select(cell).distinct(), cell, seed)
    n_hold = F.greatest(F.bround(frac * F.col("n")), F.lit(1))
    return df.join(cells.select(cell, (F.col("idx") < n_hold).alias("holdout")), cell)
