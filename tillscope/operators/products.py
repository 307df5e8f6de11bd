"""Reports on categories, products and brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.fixed_values import CANCELLED, TOP_PRODUCTS
from tillscope.functions.numbers import dollars, percent
from tillscope.plans.basket_facts import sold_products
from tillscope.plans.facts import kept_orders, line_revenue
from tillscope.sources.star import Star


def category_performance(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Per category: orders, units, revenue, profit, buyers and two ranks.

    Lines shrink step by step to (order, category), (category, customer) and
    category. Each step is an aggregate with a map-side part, and each distinct
    count becomes a plain count of the rows one step below. The first step reuses the
    partitioning by order, of the join or of the facts at rest.
    """
    per_customer = (
        sold_products(star, excluded_status)
        .groupBy("order_id", "customer_id", "category")
        .agg(
            F.sum("units").alias("units"),
            F.sum("revenue").alias("revenue"),
            F.sum("cost").alias("cost"),
        )
        .groupBy("category", "customer_id")
        .agg(
            F.count(F.lit(1)).alias("orders"),
            F.sum("units").alias("units"),
            F.sum("revenue").alias("revenue"),
            F.sum("cost").alias("cost"),
        )
    )
    categories = (
        per_customer.groupBy("category")
        .agg(
            F.sum("orders").alias("orders"),
            F.sum("units").alias("units_sold"),
            F.sum("revenue").alias("revenue"),
            F.sum("cost").alias("cost"),
            F.count("customer_id").alias("unique_buyers"),
        )
        .withColumn("profit", F.col("revenue") - F.col("cost"))
    )
    # one row per category from here on
    everything = Window.partitionBy()
    by_revenue = Window.orderBy(F.desc("revenue"))
    by_profit = Window.orderBy(F.desc("profit"))
    running = Window.orderBy(F.desc("revenue"), "category").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return categories.select(
        "category",
        "orders",
        "units_sold",
        dollars("revenue").alias("revenue"),
        dollars("profit").alias("gross_profit"),
        percent(F.col("profit"), F.col("revenue")).alias("margin_pct"),
        "unique_buyers",
        F.rank().over(by_revenue).cast("bigint").alias("revenue_rank"),
        F.rank().over(by_profit).cast("bigint").alias("profit_rank"),
        percent(F.sum("revenue").over(running), F.sum("revenue").over(everything)).alias(
            "cumulative_revenue_pct"
        ),
    ).orderBy("revenue_rank", "category")


def _product_sales(star: Star, excluded_status: str) -> DataFrame:
    """Units and revenue per product sold.

    Only the keys of kept orders travel to the lines (a semi join), and the
    product attributes join after the aggregate, at one row per product. A
    large order that skews the semi join is split by AQE: the aggregate above
    it shuffles on another key.
    """
    kept = kept_orders(star, excluded_status).select("order_id")
    return (
        star.order_items.join(kept, "order_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), F.sum(line_revenue(star.order_items)).alias("revenue"))
        .join(
            star.products.select("product_id", "product_name", "category", "brand"), "product_id"
        )
    )


def top_products_per_category(
    star: Star, n: int = TOP_PRODUCTS, excluded_status: str = CANCELLED
) -> DataFrame:
    """The ``n`` products of highest revenue in each category.

    Spark limits each category to ``n`` rows before the shuffle of the window
    as well, so a category with most products is no bottleneck.
    """
    best_first = Window.partitionBy("category").orderBy(
        F.desc("cents"), "product_name", "brand"
    )
    ranked = (
        _product_sales(star, excluded_status)
        .groupBy("category", "product_name", "brand")
        .agg(F.sum("units").alias("units_sold"), F.sum("revenue").alias("cents"))
        .withColumn("rank_in_category", F.row_number().over(best_first))
        .filter(F.col("rank_in_category") <= n)
    )
    return ranked.select(
        "category",
        "product_name",
        "brand",
        "units_sold",
        dollars("cents").alias("revenue"),
        F.col("rank_in_category").cast("bigint").alias("rank_in_category"),
    ).orderBy("category", "rank_in_category")


def brand_share(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Per category and brand: units, revenue, share of the category, rank."""
    brands = (
        _product_sales(star, excluded_status)
        .groupBy("category", "brand")
        .agg(F.sum("units").alias("units_sold"), F.sum("revenue").alias("revenue"))
    )
    in_category = Window.partitionBy("category")
    best_first = in_category.orderBy(F.desc("revenue"))
    return brands.select(
        "category",
        "brand",
        "units_sold",
        dollars("revenue").alias("revenue"),
        percent(F.col("revenue"), F.sum("revenue").over(in_category)).alias("category_share_pct"),
        F.rank().over(best_first).cast("bigint").alias("rank_in_category"),
    ).orderBy("category", "rank_in_category", "brand")
