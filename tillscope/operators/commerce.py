"""Reports on the business as a whole, its promotions, states and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.fixed_values import CANCELLED, NO_PROMOTION, ONLINE, RETURNED
from tillscope.functions.numbers import (
    dollar_ratio,
    dollars,
    half_up,
    in_cents,
    percent,
    rounded_ratio,
)
from tillscope.plans.facts import (
    customer_totals,
    kept_orders,
    line_revenue,
    sold_orders,
)
from tillscope.sources.star import Star


def executive_summary(
    star: Star, excluded_status: str = CANCELLED, returned_status: str = RETURNED
) -> DataFrame:
    """One row of headline figures. Returned orders keep their revenue."""
    costs = star.products.select("product_id", "unit_cost")
    per_order = (
        star.order_items.join(costs, "product_id")
        .groupBy("order_id")
        .agg(
            F.sum(line_revenue(star.order_items)).alias("revenue"),
            F.sum(F.col("quantity") * in_cents(costs, "unit_cost")).alias("cost"),
            F.sum("quantity").alias("units"),
        )
        .join(kept_orders(star, excluded_status).select("order_id", "status"), "order_id")
    )
    totals = per_order.agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("revenue").alias("revenue"),
        F.sum(F.col("revenue") - F.col("cost")).alias("profit"),
        F.sum("units").alias("units"),
        F.count_if(F.col("status") == returned_status).alias("returned_orders"),
    )
    orders = F.col("total_orders")
    return totals.select(
        "total_orders",
        dollars("revenue").alias("total_revenue"),
        dollars("profit").alias("gross_profit"),
        percent(F.col("profit"), F.col("revenue")).alias("gross_margin_pct"),
        dollar_ratio(F.col("revenue"), orders).alias("avg_order_value"),
        rounded_ratio(F.col("units"), orders, 1).alias("avg_units_per_order"),
        "returned_orders",
        percent(F.col("returned_orders"), orders).alias("return_rate_pct"),
    )


def promo_effectiveness(
    star: Star, excluded_status: str = CANCELLED, no_promo_label: str = NO_PROMOTION
) -> DataFrame:
    """Sales per promotion and in total.

    Orders are added up per promotion id first, so the join and the ROLLUP
    see one row per promotion. The grand total carries the same label as the
    orders without promotion; ``is_total`` tells them apart.
    """
    per_promo = (
        sold_orders(star, excluded_status)
        .groupBy("promo_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("revenue").alias("revenue"),
            F.sum("list_value").alias("list_value"),
            F.sum("units").alias("units"),
        )
    )
    named = per_promo.join(star.promotions.select("promo_id", "promo_name"), "promo_id", "left")
    report = named.rollup("promo_name").agg(
        F.sum("orders").alias("order_count"),
        F.sum("revenue").alias("revenue"),
        F.sum("list_value").alias("list_value"),
        F.sum("units").alias("units"),
        (F.grouping("promo_name") == 1).alias("is_total"),
    )
    discount = F.col("list_value") - F.col("revenue")
    return (
        report.select(
            F.coalesce("promo_name", F.lit(no_promo_label)).alias("promo_name"),
            "order_count",
            dollar_ratio(F.col("revenue"), F.col("order_count")).alias("avg_order_value"),
            rounded_ratio(F.col("units"), F.col("order_count"), 1).alias("avg_basket_size"),
            dollars("revenue").alias("total_revenue"),
            dollars(discount).alias("total_discount_given"),
            percent(discount, F.col("list_value")).alias("effective_discount_pct"),
            "is_total",
        )
        .orderBy(F.desc("total_revenue"), F.desc("is_total"), "promo_name")
    )


def state_benchmark(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Per state: sales, and its order value against the national one.

    Orders reach their state through their customer: one row per customer
    enters the join. The un-partitioned window sees one row per state.
    """
    per_customer = customer_totals(star, excluded_status).select(
        "customer_id", "orders", "revenue"
    )
    states = (
        per_customer.join(star.customers.select("customer_id", "state"), "customer_id")
        .groupBy("state")
        .agg(
            F.sum("orders").alias("orders"),
            F.count("customer_id").alias("active_customers"),
            F.sum("revenue").alias("revenue"),
        )
        .withColumn("aov", half_up(F.col("revenue"), F.col("orders")))
    )
    nation = Window.partitionBy()
    compared = states.withColumn("nation_revenue", F.sum("revenue").over(nation)).withColumn(
        "nat_aov",
        half_up(F.col("nation_revenue"), F.sum("orders").over(nation)),
    )
    return compared.select(
        "state",
        "orders",
        "active_customers",
        dollars("revenue").alias("revenue"),
        dollars("aov").alias("aov"),
        dollar_ratio(F.col("revenue"), F.col("active_customers")).alias("rev_per_customer"),
        dollars("nat_aov").alias("nat_aov"),
        percent(F.col("aov") - F.col("nat_aov"), F.col("nat_aov")).alias("aov_vs_national_pct"),
        percent(F.col("revenue"), F.col("nation_revenue")).alias("revenue_share_pct"),
    ).orderBy(F.desc("revenue"), "state")


def store_scorecard(
    star: Star, excluded_status: str = CANCELLED, online_channel: str = ONLINE
) -> DataFrame:
    """Per store with sales off line: revenue, revenue per square metre, rank.

    The dense rank runs without a partition over one row per store.
    """
    per_store = (
        sold_orders(star, excluded_status)
        .filter((F.col("channel") != online_channel) & F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("revenue").alias("cents"),
            F.sum("units").alias("units"),
            F.sum("line_count").alias("lines"),
        )
    )
    by_revenue = Window.orderBy(F.desc("cents"))
    return (
        star.stores.join(per_store, "store_id")
        .select(
            "store_name",
            "state",
            "city",
            F.col("store_size_sqm").cast("bigint").alias("store_size_sqm"),
            "orders",
            dollars("cents").alias("revenue"),
            dollar_ratio(F.col("cents"), F.col("store_size_sqm")).alias("revenue_per_sqm"),
            dollar_ratio(F.col("cents"), F.col("orders")).alias("aov"),
            rounded_ratio(F.col("units"), F.col("lines"), 1).alias("avg_qty_per_line"),
            F.dense_rank().over(by_revenue).cast("bigint").alias("revenue_rank"),
        )
        .orderBy("revenue_rank", "store_name")
    )
