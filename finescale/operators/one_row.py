"""Use the columns of a one-row frame (a global aggregate) on every row of another, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_row(df: DataFrame, row: DataFrame) -> DataFrame:
    """Add the columns of ``row``, which must hold exactly one row (it becomes a scalar subquery).

    The row enters through a one-element generator: as a plain column the optimizer would copy the
    subquery into every expression that uses one of its fields.
    """
    packed = row.select(F.struct(*row.columns).alias("_r")).scalar()
    return df.select(*df.columns, F.inline(F.array(packed)))
