"""Quality reports: keys, references, value rules, nulls and defaults.

The reports count violations instead of failing on the first one. A rule that
evaluates to NULL passes; missing values are the null report's business.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.sources.schema import TABLES, ForeignKey
from tillscope.sources.star import Star, fill_defaults


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def duplicate_keys(star: Star, table: str) -> DataFrame:
    """Keys of one table that occur more than once, and how often."""
    return (
        star.table(table)
        .groupBy(*TABLES[table].key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def all_duplicate_keys(star: Star) -> DataFrame:
    """Duplicate keys of every table, the key columns as a JSON list of texts."""
    return _union(
        duplicate_keys(star, name).select(
            F.lit(name).alias("table_name"),
            F.to_json(F.array(*(F.col(c).cast("string") for c in spec.key))).alias("key"),
            "copies",
        )
        for name, spec in TABLES.items()
    )


def primary_key_check(star: Star) -> DataFrame:
    """Per table: keys that occur more than once and the rows beyond the first."""
    return _union(
        duplicate_keys(star, name)
        .agg(
            F.count(F.lit(1)).alias("duplicate_keys"),
            F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus_rows"),
        )
        .select(
            F.lit(name).alias("table_name"),
            F.lit(", ".join(spec.key)).alias("key_columns"),
            "duplicate_keys",
            "surplus_rows",
        )
        for name, spec in TABLES.items()
    )


def orphan_keys(star: Star, table: str, reference: ForeignKey) -> DataFrame:
    """Values of a foreign key without a parent row, and the rows that hold them.

    Child rows are counted per value before the anti join, so a value that
    many rows share is one row in the join.
    """
    parent = star.table(reference.parent).select(
        F.col(reference.parent_column).alias(reference.column)
    )
    return (
        star.table(table)
        .filter(F.col(reference.column).isNotNull())
        .groupBy(reference.column)
        .agg(F.count(F.lit(1)).alias("child_rows"))
        .join(parent, reference.column, "left_anti")
    )


def _references():
    return ((name, fk) for name, spec in TABLES.items() for fk in spec.foreign_keys)


def all_orphan_keys(star: Star) -> DataFrame:
    """Orphaned values of every foreign key, as text."""
    return _union(
        orphan_keys(star, name, fk).select(
            F.lit(name).alias("table_name"),
            F.lit(fk.column).alias("column_name"),
            F.lit(fk.parent).alias("parent_table"),
            F.col(fk.column).cast("string").alias("key"),
            "child_rows",
        )
        for name, fk in _references()
    )


def foreign_key_check(star: Star) -> DataFrame:
    """Per foreign key: values without a parent and the rows that hold them."""
    return _union(
        orphan_keys(star, name, fk)
        .agg(
            F.count(F.lit(1)).alias("orphan_keys"),
            F.coalesce(F.sum("child_rows"), F.lit(0)).alias("orphan_rows"),
        )
        .select(
            F.lit(name).alias("table_name"),
            F.lit(fk.column).alias("column_name"),
            F.lit(fk.parent).alias("parent_table"),
            "orphan_keys",
            "orphan_rows",
        )
        for name, fk in _references()
    )


def _tall(counts: DataFrame, table: str, label: str, value: str) -> DataFrame:
    """One row of counts turned into a row per count."""
    return counts.unpivot([], None, label, value).select(
        F.lit(table).alias("table_name"), label, value
    )


def value_check(star: Star) -> DataFrame:
    """Rows that break each value rule; every table is scanned once."""
    return _union(
        _tall(
            star.table(name).agg(
                *(F.count_if(~F.expr(rule)).alias(label) for label, rule in spec.rules.items())
            ),
            name,
            "rule",
            "violations",
        )
        for name, spec in TABLES.items()
    )


def not_null_check(star: Star) -> DataFrame:
    """Nulls per required column; every table is scanned once.

    Columns with a default are only worth checking before ``fill_defaults``.
    """
    return _union(
        _tall(
            star.table(name).agg(
                *(F.count_if(F.col(c).isNull()).alias(c) for c in spec.required)
            ),
            name,
            "column_name",
            "null_rows",
        )
        for name, spec in TABLES.items()
    )


def default_fill_report(raw: Star) -> DataFrame:
    """Per column with a default: rows, values absent before and after the fill."""

    def report(table: str, column: str, literal: str) -> DataFrame:
        before = raw.table(table)
        filled = fill_defaults(before.withColumn("_before", F.col(column)), table)
        default = F.expr(literal).cast(before.schema[column].dataType)
        return filled.agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if(F.col("_before").isNull()).alias("absent_before"),
            F.count_if(F.col(column).isNull()).alias("absent_after"),
            F.count_if(F.col(column) == default).alias("rows_at_default"),
        ).select(
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.lit(literal).alias("default_value"),
            "row_count",
            "absent_before",
            "absent_after",
            "rows_at_default",
        )

    return _union(
        report(name, column, literal)
        for name, spec in TABLES.items()
        for column, literal in spec.defaults.items()
    )
