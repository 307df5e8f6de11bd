"""Exact order statistics by distributed selection, without ranking all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: most bits of a value that one round fixes; a task sees at most 2^22 rows of a group
_WIDEST = 22


def _holding(counts: DataFrame, keys: list[str], asked: Column) -> DataFrame:
    """The prefixes that hold the ranks asked for, and the rank left inside each.

    ``counts`` has one row per key and prefix; ``asked`` is an array of (which, rank).
    """
    running = (
        Window.partitionBy(*keys)
        .orderBy("_prefix")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    rest = F.col("_asked.rank") - F.col("_upto") + F.col("_rows")
    return (
        counts.withColumn("_upto", F.sum("_rows").over(running))
        .withColumn("_asked", F.explode(asked))
        .where((rest > 0) & (F.col("_asked.rank") <= F.col("_upto")))
        .select("_group", "_prefix", F.col("_asked.which").alias("_which"), rest.alias("_rest"))
    )


def middle_values(
    histogram: DataFrame, group: str, value: str, rows: str, bits: int = 63
) -> DataFrame:
    """group, low and high: the one or two middle values of each group (equal for an odd size).

    ``histogram`` counts in ``rows`` how often a group has a BIGINT ``value``, each pair once.
    Rows with a null value do not count; a null group is a group. No value is beyond
    ``bits`` bits and a sign: the fewer, the fewer rounds.

    Values are fixed digit by digit from the top. Each level of counts is added up from the
    one below; a round then looks only at the counts under the prefix that holds the middle,
    at most 2^22 of a group. No rows are sorted but those, and nothing is collected.
    """
    rounds = max(1, -(-(bits + 1) // _WIDEST))
    digit = -(-(bits + 1) // rounds)
    level = histogram.where(F.col(value).isNotNull()).select(
        F.col(group).alias("_group"), F.col(value).alias("_prefix"), F.col(rows).alias("_rows")
    )
    levels = [level]
    for _ in range(rounds - 1):
        level = level.groupBy(
            "_group", F.shiftright("_prefix", digit).alias("_prefix")
        ).agg(F.sum("_rows").alias("_rows"))
        levels.append(level)

    size = F.sum("_rows").over(Window.partitionBy("_group"))
    middles = F.array(
        F.struct(F.lit(0).alias("which"), F.floor((F.col("_size") + 1) / 2).alias("rank")),
        F.struct(F.lit(1).alias("which"), (F.floor(F.col("_size") / 2) + 1).alias("rank")),
    )
    found = _holding(levels[-1].withColumn("_size", size), ["_group"], middles)
    asked = F.array(F.struct(F.col("_which").alias("which"), F.col("_rest").alias("rank")))
    for level in reversed(levels[:-1]):
        sought = found.select(
            F.col("_group").alias("_own"), F.col("_prefix").alias("_under"), "_which", "_rest"
        )
        inside = level.join(
            sought,
            level["_group"].eqNullSafe(sought["_own"])
            & (F.shiftright(level["_prefix"], digit) == sought["_under"]),
        )
        found = _holding(inside, ["_group", "_which"], asked)
    side = F.when(F.col("_which") == 0, F.col("_prefix"))
    other = F.when(F.col("_which") == 1, F.col("_prefix"))
    return found.groupBy(F.col("_group").alias(group)).agg(
        F.max(side).alias("low"), F.max(other).alias("high")
    )
