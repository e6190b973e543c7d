"""Ranks and running sums that never pull one group into one task.

A ``Window`` with no partition, or with one hot partition, sorts all its rows in
a single task.  Here the rows are range-partitioned on the full order instead;
ranks are taken inside each (partition, group) cell and shifted by the totals of
the earlier cells.  The table of totals has at most one row per cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgraph.session import materialize

_CELL = "_cell"


def _cells(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition and pin the partition number of every row in a written table."""
    placed = df.repartitionByRange(*order).withColumn(_CELL, F.spark_partition_id())
    return materialize(placed, "cells")


def running_total(
    df: DataFrame,
    order: Sequence[str],
    name: str,
    value: Column | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over earlier rows of the group (exclusive).

    ``value`` defaults to 1, which makes ``name`` the 0-based position.  ``order``
    must be unique within a group and group columns must not be null.
    """
    amount = F.lit(1) if value is None else value
    cells = _cells(df, [*group, *order])
    keys = [_CELL, *group]
    totals = cells.groupBy(*keys).agg(F.sum(amount).alias("_total"))
    earlier = Window.orderBy(_CELL) if not group else Window.partitionBy(*group).orderBy(_CELL)
    shift = totals.select(
        *keys,
        F.coalesce(
            F.sum("_total").over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_shift"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order)
    if value is None:
        local = F.row_number().over(inside) - F.lit(1)
    else:
        local = F.coalesce(
            F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )
    return (
        cells.withColumn("_local", local)
        .join(shift, keys)
        .withColumn(name, (F.col("_local") + F.col("_shift")).cast("bigint"))
        .drop(_CELL, "_local", "_shift")
    )


def running_max(
    df: DataFrame, order: Sequence[str], name: str, value: Column, group: Sequence[str] = ()
) -> DataFrame:
    """Add ``name``: the greatest ``value`` of this row and the earlier rows of the group; null among nulls only.

    ``order`` and ``group`` as in :func:`running_total`.
    """
    cells = _cells(df.withColumn("_value", value), [*group, *order])
    keys = [_CELL, *group]
    most = cells.groupBy(*keys).agg(F.max("_value").alias("_most"))
    earlier = Window.orderBy(_CELL) if not group else Window.partitionBy(*group).orderBy(_CELL)
    before = most.select(*keys, F.max("_most").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        cells.withColumn("_own", F.max("_value").over(inside))
        .join(before, keys)
        .withColumn(name, F.greatest("_own", "_before"))
        .drop(_CELL, "_value", "_own", "_before")
    )


def dense_index(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """0-based position in the global order of unique ``order`` columns."""
    return running_total(df, order, name)


def position_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str
) -> DataFrame:
    """0-based position inside each group, safe for groups of any size."""
    return running_total(df, order, name, group=group)
