"""Order-grain and customer-grain facts that the analyses share.

Lines are always added up per order before they meet another table. The
partial aggregate runs before the shuffle, so an order (or customer) with any
share of all rows sends one row per map task, and the join with ``orders`` reuses
the partitioning of the aggregate: one shuffle of lines, one of orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillscope.fixed_values import CANCELLED
from tillscope.functions.calendar import month_start
from tillscope.functions.numbers import in_cents
from tillscope.sources.star import Star


def line_revenue(items: DataFrame) -> Column:
    """Revenue of a line in cents."""
    return F.col("quantity") * in_cents(items, "final_unit_price")


def line_list_value(items: DataFrame) -> Column:
    """What a line would have cost before its discount, in cents."""
    return F.col("quantity") * in_cents(items, "unit_price")


def kept_orders(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    return star.orders.filter(F.col("status") != excluded_status)


def all_order_facts(star: Star) -> DataFrame:
    """One row per order, amounts in cents; null totals for one without lines."""
    items = star.order_items
    totals = items.groupBy("order_id").agg(
        F.sum(line_revenue(items)).alias("revenue"),
        F.sum(line_list_value(items)).alias("list_value"),
        F.sum("quantity").alias("units"),
        F.count(F.lit(1)).alias("line_count"),
    )
    return star.orders.join(totals, "order_id", "left")


def order_facts(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """One row per kept order, amounts in cents; null totals for one without lines."""
    facts = star.order_facts if star.order_facts is not None else all_order_facts(star)
    return facts.filter(F.col("status") != excluded_status)


def sold_orders(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Kept orders that have lines (Catalyst turns the left join into an inner one)."""
    return order_facts(star, excluded_status).filter(F.col("line_count").isNotNull())


def materialise_order_facts(star: Star, path: str) -> Star:
    """Write the order-grain facts once and let later analyses read them.

    Nine of the sixteen analyses start from this table, so running several of them
    over the same star shuffles the lines once instead of once per analysis.
    """
    all_order_facts(star).write.mode("overwrite").parquet(path)
    return star.with_order_facts(star.orders.sparkSession.read.parquet(path))


def customer_totals(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """One row per customer with sold orders; revenue in cents."""
    return (
        sold_orders(star, excluded_status)
        .groupBy("customer_id")
        .agg(
            F.min("order_date").alias("first_order"),
            F.max("order_date").alias("last_order"),
            F.count(F.lit(1)).alias("orders"),
            F.sum("line_count").alias("lines"),
            F.sum("revenue").alias("revenue"),
        )
    )


def monthly_revenue(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Revenue per month in cents."""
    return (
        sold_orders(star, excluded_status)
        .groupBy(month_start(F.col("order_date")).alias("month"))
        .agg(F.sum("revenue").alias("revenue"))
    )
