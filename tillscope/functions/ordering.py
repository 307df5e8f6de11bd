"""Exact row numbers over groups that are too large for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.plans.session import stored

# monotonically_increasing_id() keeps the partition number above bit 33 and the
# row number within the partition below it.
_ROW_BITS = 33


def with_position(df: DataFrame, group: str, order_by: list[str]) -> DataFrame:
    """Add ``position`` (1-based) and ``group_size`` to every row.

    Equal to ``row_number() OVER (PARTITION BY group ORDER BY order_by)`` and
    ``count(*) OVER (PARTITION BY group)``, but no task sees a whole group: rows
    are range-partitioned and sorted on (group, order_by), numbered within
    their partition, and shifted by the number of rows of the same group in
    earlier partitions. ``order_by`` should end in a unique column; it then also
    splits runs of equal values over partitions.

    Range bounds are sampled, so a second evaluation could cut the partitions elsewhere.
    The sorted rows are therefore written once, when the plan is built, as Parquet with
    their slot; shifts are part of the plan. A partition and group come together in one
    count, so a join with the counts has no larger key than a range partition.
    """
    slot = F.monotonically_increasing_id()
    numbered = stored(df.orderBy(group, *order_by).withColumn("_slot", slot), "positions")
    placed = numbered.withColumn("_part", F.shiftright("_slot", _ROW_BITS))
    runs = placed.groupBy("_part", group).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_slot").alias("_first")
    )
    in_group = Window.partitionBy(group)
    earlier = in_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(
        F.col("_part").alias("_run_part"),
        F.col(group).alias("_run_group"),
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(in_group).alias("group_size"),
    )
    same_run = (F.col("_part") == F.col("_run_part")) & F.col(group).eqNullSafe(
        F.col("_run_group")
    )
    return placed.join(shifts, same_run).select(
        *(F.col(c) for c in df.columns),
        (F.col("_before") + F.col("_slot") - F.col("_first") + 1).alias("position"),
        "group_size",
    )


def ntile_of(position: Column, group_size: Column, buckets: int) -> Column:
    """The NTILE bucket of a 1-based position: the first buckets take the rest."""
    small = F.floor(group_size / buckets)
    rest = group_size % buckets
    in_large = rest * (small + 1)
    row = position - 1
    return (
        F.when(row < in_large, F.floor(row / (small + 1)) + 1)
        .otherwise(rest + F.floor(F.try_divide(row - in_large, small)) + 1)
        .cast("bigint")
    )

