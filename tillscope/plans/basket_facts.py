"""Lines at rest, one row per order and product, clustered by order.

A report that needs an order's lines together reads them in buckets and moves none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.fixed_values import CANCELLED
from tillscope.functions.numbers import in_cents
from tillscope.plans.facts import kept_orders, line_list_value, line_revenue
from tillscope.plans.session import spread, tasks_for
from tillscope.sources.star import Star

KEY = "order_id"
_ATTRIBUTES = ("product_name", "category", "brand")


def _basket_facts(star: Star) -> DataFrame:
    """Lines of known orders added up per order and product, with what reports ask of both.

    Adding up comes first, with a map-side part: an order or a product with any share of all
    lines sends one row per map task and pair. Amounts are in cents. ``known`` tells lines
    whose product is in the catalogue; the others have no attributes and no cost.
    """
    items = star.order_items
    catalogue = star.products
    added = items.groupBy(KEY, "product_id").agg(
        F.sum("quantity").alias("units"),
        F.sum(line_revenue(items)).alias("revenue"),
        F.sum(line_list_value(items)).alias("list_value"),
        F.count(F.lit(1)).alias("line_count"),
    )
    described = catalogue.select(
        "product_id", *_ATTRIBUTES, in_cents(catalogue, "unit_cost").alias("unit_cents"),
        F.lit(True).alias("known"),
    )
    orders = star.orders.select(KEY, "customer_id", "order_date", "status")
    tasks = tasks_for(items)
    return (
        added.join(spread(orders, KEY, tasks), KEY)
        .join(spread(described, "product_id", tasks), "product_id", "left")
        .withColumn("known", F.coalesce("known", F.lit(False)))
        .withColumn("cost", F.col("units") * F.col("unit_cents"))
        .drop("unit_cents")
    )


def store_basket_facts(star: Star, path: str, table: str, buckets: int) -> Star:
    """Write the facts in ``buckets`` files by order and let reports read them from there.

    ``table`` is the name under which the session knows them. A bucket is read by one task;
    take as many as keep one within an executor's memory (``tasks_for`` the lines). The products' attributes and costs
    are those of the time of writing: write again when the catalogue changes.
    """
    facts = _basket_facts(star).repartition(buckets, KEY)
    facts.write.bucketBy(buckets, KEY).sortBy(KEY).mode("overwrite").option(
        "path", path
    ).saveAsTable(table)
    return star.with_basket_facts(star.orders.sparkSession.table(table))


def open_basket_facts(
    spark: SparkSession, star: Star, path: str, table: str, buckets: int
) -> Star:
    """Facts that an earlier session wrote to ``path`` in ``buckets``, under ``table``."""
    columns = spark.read.parquet(path).schema.toDDL()
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return star.with_basket_facts(spark.table(table))


def sold_lines(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """order_id and product_id of the lines of kept orders; at rest, of order and product."""
    if star.basket_facts is not None:
        kept = star.basket_facts.where(F.col("status") != excluded_status)
        return kept.select(KEY, "product_id")
    kept = kept_orders(star, excluded_status).select(KEY)
    return star.order_items.select(KEY, "product_id").join(kept, KEY, "left_semi")


def sold_products(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Lines of kept orders with a known product, or their sums per order and product.

    order_id, customer_id, product_id, product_name, category, brand, units, and revenue and
    cost in cents. At rest the rows come clustered by order. Otherwise lines meet their
    products first and their orders last, so that all that follows within an order reuses that
    partitioning. Tasks grow in number with the lines, not in size.
    """
    if star.basket_facts is not None:
        kept = star.basket_facts.where((F.col("status") != excluded_status) & F.col("known"))
        return kept.select(
            KEY, "customer_id", "product_id", *_ATTRIBUTES, "units", "revenue", "cost"
        )
    items, catalogue = star.order_items, star.products
    described = catalogue.select(
        "product_id", *_ATTRIBUTES, in_cents(catalogue, "unit_cost").alias("unit_cents")
    )
    kept = kept_orders(star, excluded_status).select(KEY, "customer_id")
    tasks = tasks_for(items)
    return (
        items.select(
            KEY,
            "product_id",
            F.col("quantity").alias("units"),
            line_revenue(items).alias("revenue"),
        )
        .join(spread(described, "product_id", tasks), "product_id")
        .withColumn("cost", F.col("units") * F.col("unit_cents"))
        .drop("unit_cents")
        .join(spread(kept, KEY, tasks), KEY)
    )
