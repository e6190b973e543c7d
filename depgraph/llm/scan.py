"""Prefix scans over ordered tables that never put one group into one task.

Rows are range-partitioned in the full order and stored with the number of their partition; inside a
partition a window does the work, and one small row for each partition and group carries the state on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from depgraph.session import materialize


def earlier_value(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the last value that is not null among the earlier rows of the group.

    ``order`` must be unique within a group; group columns must not be null.
    """
    keys = [*group, *order]
    cells = materialize(
        df.withColumn("_value", value).repartitionByRange(*keys).withColumn("_cell", F.spark_partition_id()), "scan"
    )
    inside = Window.partitionBy("_cell", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("_value").isNotNull(), F.struct(*order, "_value"))
    carried = (
        cells.groupBy("_cell", *group).agg(F.max(held).alias("_newest"))
        .select("_cell", *group, F.last("_newest._value", ignorenulls=True).over(across).alias("_carried"))
    )
    return (
        cells.withColumn("_own", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, ["_cell", *group])
        .withColumn(name, F.coalesce("_own", "_carried"))
        .drop("_cell", "_value", "_own", "_carried")
    )
