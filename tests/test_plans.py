"""The plans the reports are meant to get, read from the physical plan."""

from __future__ import annotations

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tillscope.operators import baskets, commerce, customers, products, profile, trends
from tillscope.plans import session
from tillscope.plans.basket_facts import open_basket_facts, store_basket_facts
from tillscope.sources.load import load_tables, write_csv_tables
from tillscope.sources.order_book import raw_star
from tillscope.sources.star import Star

GIVEN = "/root/testdata/sf0.001"
REPORTS = (
    commerce.executive_summary, trends.monthly_revenue_yoy, customers.cohort_retention,
    customers.rfm_segmentation, products.category_performance,
    products.top_products_per_category, commerce.promo_effectiveness, trends.channel_mix,
    customers.clv_distribution, commerce.state_benchmark, trends.rolling_revenue,
    baskets.market_basket, customers.new_vs_returning, commerce.store_scorecard,
    customers.purchase_gap, products.brand_share,
)


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    write_csv_tables(raw_star(spark, GIVEN), f"{root}/csv")
    return load_tables(spark, f"{root}/csv", f"{root}/tables")


@pytest.fixture()
def large_tables(spark):
    """No table counts as small, as at scale."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("report", REPORTS, ids=lambda r: r.__name__)
def test_no_pairwise_join_and_no_python(star, large_tables, report):
    text = plan(report(star))
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval"):
        assert costly not in text


# the other two read their customers from a table written when the plan was built
READING_TABLES = [
    r for r in REPORTS if r not in (customers.rfm_segmentation, customers.clv_distribution)
]


@pytest.mark.parametrize("report", READING_TABLES, ids=lambda r: r.__name__)
def test_status_filter_reaches_the_scan(spark, star, report):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(report(star))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "Not(EqualTo(status,Cancelled))" in text
    assert "first_name" not in text and "subcategory" not in text


def test_facts_take_one_shuffle_of_each_table(star, large_tables):
    text = plan(trends.monthly_revenue_yoy(star))
    assert text.count("Exchange hashpartitioning(order_id") == 2
    # lines are added up before they are shuffled
    lines = text[text.rindex("Exchange hashpartitioning(order_id"):]
    assert "partial_sum" in lines


def test_top_products_are_limited_before_the_shuffle(star, large_tables):
    text = plan(products.top_products_per_category(star))
    partial = text.index("Partial", text.index("WindowGroupLimit"))
    assert text.rindex("WindowGroupLimit") < text.index("Exchange hashpartitioning(order_id")
    assert text.index("Exchange hashpartitioning(category#") < partial


def test_no_customer_ranking_in_one_task(star, large_tables):
    text = plan(customers.rfm_segmentation(star))
    for ranking in ("ntile(", "median(", "row_number(", "ExistingRDD"):
        assert ranking not in text
    # what reaches a single task is already one row per segment
    for single in text.split("Exchange SinglePartition")[1:]:
        assert single.index("HashAggregate(keys=[rfm_segment") < single.index("FileScan")


def test_median_sorts_no_customers(star, large_tables):
    text = plan(customers.clv_distribution(star))
    for ranking in ("percentile", "median(", "row_number(", "ExistingRDD", "SinglePartition"):
        assert ranking not in text
    # windows order the counts under one prefix, and nothing is sorted by customer
    assert "customer_id" not in text


@pytest.mark.parametrize(
    "report", [customers.rfm_segmentation, customers.rfm_customers, customers.clv_distribution]
)
def test_one_table_is_written_when_the_plan_is_built(spark, star, shared, report):
    before = set(os.listdir(shared))
    report(star)
    assert len(set(os.listdir(shared)) - before) == 1


@pytest.mark.parametrize("item", ["category", "brand"])
def test_basket_pairs_come_from_bits(star, large_tables, item):
    """Bits are OR-ed before the shuffle in memory of fixed size: no sets, no sort fallback."""
    text = plan(baskets.market_basket(star, item))
    assert "partial_bit_or" in text and "ReusedExchange" in text
    for costly in ("collect_", "ObjectHashAggregate", "SortAggregate"):
        assert costly not in text
    assert text.index("Generate posexplode") < text.index("partial_bit_or")


def test_many_items_leave_by_support_before_the_tree(star, large_tables):
    text = plan(baskets.item_pairs(star, "product_id", least_orders=3, few_items=0))
    # one bound on pairs at the end, one on items below all sets
    assert text.index(">= 3)") < text.index("collect_list") < text.rindex(">= 3)")


@pytest.fixture()
def small_catalogue(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("report", [products.category_performance, baskets.market_basket])
def test_lines_move_once_when_the_catalogue_is_small(spark, star, small_catalogue, report):
    orders = star.orders.hint("merge")  # orders never are
    shop = Star(lambda name: orders if name == "orders" else star.table(name))
    text = plan(report(shop))
    assert text.count("Exchange hashpartitioning(order_id") == 2  # lines, orders
    assert "Exchange hashpartitioning(product_id" not in text


@pytest.fixture(scope="module")
def stored(spark, star, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('facts')}/basket_facts"
    return path, store_basket_facts(star, path, "basket_facts_of_tests", buckets=4)


def test_no_line_moves_when_facts_are_at_rest(stored, large_tables):
    text = plan(products.category_performance(stored[1]))
    assert "Bucketed: true" in text
    assert "Exchange hashpartitioning(order_id" not in text
    assert "Exchange hashpartitioning(product_id" not in text
    first = text[text.rindex("Exchange hashpartitioning("):]
    assert "partial_sum" in first  # one row per category and customer leaves a task


def test_tasks_of_the_category_report_grow_with_the_lines(star, large_tables, monkeypatch):
    expected = products.category_performance(star).collect()
    monkeypatch.setattr(session, "LINES_PER_TASK", 100)
    tasks = -(-star.order_items.count() // 100)
    report = products.category_performance(star)
    dealt = re.findall(r"Exchange hashpartitioning\((?:order_id|product_id)#\d+L?, (\d+)\)", plan(report))
    assert tasks > 8 and dealt and set(map(int, dealt)) == {tasks}
    assert report.collect() == expected


def test_buckets_of_the_category_facts_grow_with_the_lines(spark, monkeypatch):
    query = __spark_entry__.queries()["w05b_category_from_facts"]
    expected = query(spark, GIVEN).collect()
    monkeypatch.setattr(session, "LINES_PER_TASK", 100)
    tasks = -(-raw_star(spark, GIVEN).order_items.count() // 100)
    report = query(spark, GIVEN)
    assert tasks > 8 and f"out of {tasks}" in plan(report)
    assert report.collect() == expected


def test_facts_at_rest_give_the_same_reports(spark, star, stored):
    path, facts = stored
    spark.sql("DROP TABLE basket_facts_of_tests")  # a later session knows only the files
    facts = open_basket_facts(spark, star, path, "basket_facts_again", buckets=4)
    for report in (products.category_performance, baskets.market_basket, baskets.item_pairs):
        assert report(facts).collect() == report(star).collect()
    assert "Bucketed: true" in plan(products.category_performance(facts))


def test_sample_reads_other_columns_only_up_to_the_last_key(star):
    keys = star.orders.select("order_id").orderBy("order_id").limit(5).collect()
    text = plan(profile.table_sample(star, "orders"))
    assert f"LessThanOrEqual(order_id,{keys[-1].order_id})" in text


def test_skewed_order_is_split_by_adaptive_execution(spark, star):
    """With thresholds at test size, a hot order splits its join partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    hot = star.order_items.repartition(6).withColumn(
        "order_id", F.when(F.col("quantity") > 20, F.lit("1")).otherwise(F.col("order_id"))
    )
    skewed = Star(lambda name: hot if name == "order_items" else star.table(name))
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        sales = products.brand_share(skewed)
        sales.collect()
        assert "skew=true" in plan(sales)
    finally:
        for key in settings:
            spark.conf.unset(key)
