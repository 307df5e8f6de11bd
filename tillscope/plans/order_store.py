"""Order facts as a table that is kept up to date month by month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.plans.facts import all_order_facts
from tillscope.sources.published import current, new_folder, publish
from tillscope.sources.star import Star

_MONTH = "order_month"
_NO_DATE = "none"


def _with_month(facts: DataFrame) -> DataFrame:
    month = F.coalesce(F.date_format("order_date", "yyyy-MM"), F.lit(_NO_DATE))
    return facts.withColumn(_MONTH, month)


def read_order_facts(spark: SparkSession, root: str) -> DataFrame | None:
    """The facts as last published; None before the first publication."""
    folders = current(spark, root)
    return spark.read.parquet(*folders.values()) if folders else None


def _months(facts: DataFrame) -> list[str]:
    """Different months of ``facts``: as many as the calendar has, however many orders."""
    return sorted(r[_MONTH] for r in _with_month(facts).select(_MONTH).distinct().collect())


def merge_order_facts(star: Star, root: str, changed: DataFrame | None = None) -> Star:
    """Bring the facts under ``root`` up to date and let reports read them from there.

    ``changed`` holds in order_id the orders that are new, altered or gone, or whose lines
    are; without it, or the first time, all are taken. Only lines of changed orders are read
    into the totals. The months that hold such an order, before or now, are written anew with
    what else they hold; all become current at once, other months stay as they are. A
    merge that failed can be run again.
    """
    spark = star.orders.sparkSession
    folders = current(spark, root)
    if changed is None or not folders:
        facts = all_order_facts(star)
        before = sorted(folders)
    else:
        ids = changed.select("order_id").distinct()
        orders = star.orders.join(ids, "order_id", "left_semi")
        items = star.order_items.join(ids, "order_id", "left_semi")
        facts = all_order_facts(Star.of(orders=orders, order_items=items))
        old = read_order_facts(spark, root)
        before = _months(old.join(ids, "order_id", "left_semi"))
        touched = sorted({*before, *_months(orders)})
        rest = [folders[month] for month in touched if month in folders]
        if rest:
            kept = spark.read.parquet(*rest).join(ids, "order_id", "left_anti")
            facts = facts.unionByName(kept)
    folder = new_folder()
    # a range holds few months, and a month with most orders many ranges
    _with_month(facts).repartitionByRange("order_date", "order_id").write.partitionBy(
        _MONTH
    ).parquet(f"{root}/{folder}")
    written = spark.read.parquet(f"{root}/{folder}") if facts.take(1) else None
    now = [] if written is None else _months(written)
    publish(
        spark,
        root,
        {**{m: None for m in before}, **{m: f"{folder}/{_MONTH}={m}" for m in now}},
    )
    published = read_order_facts(spark, root)
    return star.with_order_facts(facts.limit(0) if published is None else published)
