"""Global order without a single-task window.

Rows are range-partitioned once and pinned by a checkpoint. Each partition works
on its own rows; what crosses a border is one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import cut_lineage


def _ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    return cut_lineage(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))


def dense_ids(df: DataFrame, order: Sequence[str], name: str, start: int = 1) -> DataFrame:
    """Consecutive ids in sort order."""
    pinned = _ranges(df, order)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition.
    offsets = pinned.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return (
        pinned.withColumn(name, local)
        .join(F.broadcast(offsets), "_p")
        .withColumn(name, (F.col(name) + F.col("_offset") + (start - 1)).cast("bigint"))
        .drop("_p", "_offset")
    )


def previous_value(df: DataFrame, key: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the value of the row before, within ``key`` and by ``order``.

    Unlike a window over the key, one key may span many partitions.
    """
    ordered = [key, *order]
    pinned = _ranges(df, ordered)
    inside = Window.partitionBy("_p", key).orderBy(*order)
    last = pinned.groupBy("_p").agg(F.max_by(F.struct(F.col(key).alias("k"), F.col(value).alias("v")), F.struct(*ordered)).alias("_tail"))
    # One row per partition.
    tails = last.select("_p", F.lag("_tail").over(Window.orderBy("_p")).alias("_tail"))
    first = F.row_number().over(inside) == 1
    carried = F.when(F.col("_tail.k") == F.col(key), F.col("_tail.v"))
    return (
        pinned.withColumn("_first", first)
        .withColumn(name, F.lag(value).over(inside))
        .join(F.broadcast(tails), "_p", "left")
        .withColumn(name, F.when(F.col("_first"), carried).otherwise(F.col(name)))
        .drop("_p", "_first", "_tail")
    )
