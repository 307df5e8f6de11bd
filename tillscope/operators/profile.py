"""What is in the tables: counts, columns and first rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.fixed_values import SAMPLE_ROWS
from tillscope.sources.schema import TABLES
from tillscope.sources.star import Star


def row_counts(star: Star) -> DataFrame:
    """Rows per table, numbered in load order."""
    counts = (
        star.table(name)
        .agg(F.count(F.lit(1)).alias("row_count"))
        .select(
            F.lit(at).cast("bigint").alias("load_order"), F.lit(name).alias("table_name"), "row_count"
        )
        for at, name in enumerate(TABLES, start=1)
    )
    return reduce(DataFrame.unionByName, counts).orderBy("load_order")


def table_profile(star: Star) -> DataFrame:
    """Rows and column names per table."""
    columns = F.create_map(
        *(F.lit(text) for name in TABLES for text in (name, ", ".join(star.table(name).columns)))
    )
    return row_counts(star).select(
        "table_name", "row_count", columns[F.col("table_name")].alias("column_names")
    )


def table_sample(star: Star, table: str, rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """The first rows of a table by key; every row with ``rows=None``.

    Columns after the key only break ties between rows with equal keys. The ``rows`` first
    keys are found when the plan is built, from the key columns alone; the scan of all
    columns then skips what lies beyond the last of them.
    """
    frame = star.table(table)
    key = list(TABLES[table].key)

    def by(columns: list[str]) -> list[Column]:
        return [F.asc_nulls_last(c) for c in columns]

    if rows is not None:
        first = frame.select(*key).orderBy(*by(key)).limit(rows).collect()
        if len(first) == rows and rows and first[-1][0] is not None:
            frame = frame.where(F.col(key[0]) <= F.lit(first[-1][0]))
    ordered = frame.orderBy(*by(key + [c for c in frame.columns if c not in key]))
    return ordered if rows is None else ordered.limit(rows)
