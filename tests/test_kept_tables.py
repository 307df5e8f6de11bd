"""Tables that are published, merged or set aside: what readers see, and when."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tests.shop import line, order, rows, shop
from tests.test_load_and_quality import CSV
from tillscope.operators import commerce, customers, trends
from tillscope.plans.facts import all_order_facts
from tillscope.plans.order_store import merge_order_facts, read_order_facts
from tillscope.sources.load import (
    _cell,
    _lines,
    _odd,
    load_tables,
    read_csv_table,
    read_rejects,
    reject_report,
    split_csv_table,
    write_csv_tables,
)
from tillscope.sources.order_book import order_book_star, raw_star
from tillscope.sources.published import current, publish
from tillscope.sources.schema import TABLES
from tillscope.sources.star import Star, read_star

GIVEN = "/root/testdata/sf0.001"


def test_the_latest_publication_of_a_part_counts(spark, tmp_path):
    root = str(tmp_path)
    assert current(spark, root) == {}
    publish(spark, root, {"a": "v/1", "b": "v/1b"})
    publish(spark, root, {"a": "v/2"})
    publish(spark, root, {"b": None, "c": "v/3"})
    assert current(spark, root) == {"a": f"{root}/v/2", "c": f"{root}/v/3"}


def _csv(folder, **changed):
    folder.mkdir(exist_ok=True)
    for name, text in {**CSV, **changed}.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_a_failed_load_leaves_the_old_star(spark, tmp_path):
    root = str(tmp_path / "tables")
    load_tables(spark, _csv(tmp_path / "one"), root)
    before = {t: sorted(map(repr, read_star(spark, root).table(t).collect())) for t in TABLES}
    bad = CSV["order_items"] + "O2,2,P1,two,1.00,,1.00\n"
    more = CSV["customers"] + "C2,Bo,Ray,VIC,Town,2022-01-05,Budget\n"
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        load_tables(spark, _csv(tmp_path / "two", order_items=bad, customers=more), root)
    after = read_star(spark, root)
    assert before == {t: sorted(map(repr, after.table(t).collect())) for t in TABLES}
    load_tables(spark, _csv(tmp_path / "three", customers=more), root)
    assert read_star(spark, root).customers.count() == 2


def test_bad_cells_are_set_aside_with_file_and_line(spark, tmp_path):
    root = str(tmp_path / "tables")
    items = (
        "order_id,line_item,product_id,quantity,unit_price,discount_pct,final_unit_price\n"
        "O1,1,P1,2,2.35,,2.35\n"
        "\n"
        "O2,1,P2,many,3.00,0.1,none\n"
        "O2,2,P2,1,3.00\n"
        'O2,3,"P,2",1,3.00,0.1,2.70\n'
        "O2,4,P2,1,3.00,0.1,2.70,extra\n"
    )
    orders = CSV["orders"] + "O3,C1,2023-02-30,Online,,,Delivered\nO4,C1,2023-1-5,Online,,,Delivered\n"
    star = load_tables(
        spark, _csv(tmp_path / "csv", order_items=items, orders=orders), root, set_aside=True
    )
    assert sorted(rows(star.order_items, "order_id", "line_item", "product_id")) == [
        ("O1", 1, "P1"), ("O2", 3, "P,2"),
    ]
    found = read_rejects(spark, root).collect()
    assert sorted((r.table_name, r.line, r.column_name or "", r.cell) for r in found) == [
        ("order_items", 4, "final_unit_price", "none"),
        ("order_items", 4, "quantity", "many"),
        ("order_items", 5, "", "O2,2,P2,1,3.00"),
        ("order_items", 7, "", "O2,4,P2,1,3.00,0.1,2.70,extra"),
        ("orders", 4, "order_date", "2023-02-30"),
        ("orders", 5, "order_date", "2023-1-5"),
    ]
    assert all(r.file.endswith(f"{r.table_name}.csv") for r in found)
    report = {r.table_name: r for r in reject_report(spark, str(tmp_path / "csv"), root).collect()}
    assert (report["order_items"].rows_set_aside, report["order_items"].bad_cells) == (3, 4)
    load_tables(spark, _csv(tmp_path / "good"), root)
    assert read_rejects(spark, root) is None  # the published load set nothing aside
    with pytest.raises(ValueError, match="line breaks"):
        load_tables(spark, str(tmp_path / "good"), root, multi_line=True, set_aside=True)


def test_rows_that_fit_are_read_alike_both_ways(spark, tmp_path):
    write_csv_tables(raw_star(spark, GIVEN), str(tmp_path))
    for table in TABLES:
        good, rejects = split_csv_table(spark, f"{tmp_path}/{table}.csv", table)
        plain = read_csv_table(spark, f"{tmp_path}/{table}.csv", table)
        assert good.schema.simpleString() == plain.schema.simpleString()
        assert good.exceptAll(plain).count() == plain.exceptAll(good).count() == 0
        assert rejects.count() == 0


def test_lines_are_numbered_over_the_blocks_of_a_file(spark, tmp_path):
    text = ["store_id,store_name,state,city,opened_date,store_size_sqm"]
    text += [f"S{i},Main,NSW,Sydney,2020-01-01,{'x' if i % 50 == 0 else i}" for i in range(2, 3000)]
    (tmp_path / "stores.csv").write_text("\n".join(text) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        good, rejects = split_csv_table(spark, str(tmp_path / "stores.csv"), "stores")
        assert good.rdd.getNumPartitions() > 5
        assert sorted(r.line for r in rejects.collect()) == list(range(50, 3000, 50))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _facts(star):
    return sorted(map(repr, all_order_facts(star).collect()))


def _kept(spark, root):
    names = all_order_facts(shop(spark, [], [], [], [])).columns
    return sorted(map(repr, read_order_facts(spark, root).select(*names).collect()))


def test_merged_order_facts_equal_new_ones(spark, tmp_path):
    root = str(tmp_path)
    orders = [
        order(f"O{i}", f"C{i % 5}", f"2023-{1 + i % 6:02}-{1 + i % 27:02}") for i in range(60)
    ]
    items = [line(f"O{i}", "P1", 1 + k, 2.5, at=k) for i in range(60) for k in range(i % 4)]
    old = shop(spark, orders, items)
    merge_order_facts(old, root)
    assert _kept(spark, root) == _facts(old)
    first = current(spark, root)

    # one altered, one moved to a new month, one gone, one new, one with other lines
    now = [o for o in orders if o[0] != "O7"]
    now[3] = order("O3", "C9", "2023-04-04", status="Cancelled")
    now[8] = order("O9", "C4", "2024-01-01")
    now.append(order("N1", "C1", "2023-02-01"))
    lines = [i for i in items if i[0] not in ("O7", "O13")] + [line("N1", "P1", 7, 1.25)]
    new = shop(spark, now, lines)
    changed = spark.createDataFrame([(k,) for k in ("O3", "O7", "O9", "N1", "O13", "N1")], "order_id string")
    merge_order_facts(new, root, changed)
    assert _kept(spark, root) == _facts(new)
    merge_order_facts(new, root, changed)  # again, as after a failure
    assert _kept(spark, root) == _facts(new)
    second = current(spark, root)
    assert second["2023-06"] == first["2023-06"]  # no changed order was or is in June
    assert second["2023-02"] != first["2023-02"] and "2024-01" in second

    # the last order of a month leaves it
    only = [o for o in now if o[0] != "O9"]
    star = shop(spark, only, [i for i in lines if i[0] != "O9"])
    gone = spark.createDataFrame([("O9",)], "order_id string")
    assert "2024-01" not in (merge_order_facts(star, root, gone) and current(spark, root))
    assert _kept(spark, root) == _facts(star)


def test_a_merge_that_fails_changes_nothing(spark, tmp_path):
    root = str(tmp_path)
    star = shop(spark, [order("O1", "C1", "2023-01-01")], [line("O1", "P1", 1, 2)])
    merge_order_facts(star, root)
    before = _kept(spark, root)
    broken = Star.of(
        orders=star.orders,
        order_items=star.order_items.withColumn(
            "quantity", F.raise_error(F.lit("lost")).cast("int")
        ),
    )
    with pytest.raises(Exception, match="lost"):
        merge_order_facts(broken, root, star.orders.select("order_id"))
    assert _kept(spark, root) == before


NINE = (
    trends.monthly_revenue_yoy, customers.rfm_customers, trends.channel_mix,
    commerce.promo_effectiveness, customers.clv_customers, commerce.state_benchmark,
    trends.rolling_revenue, customers.new_vs_returning, commerce.store_scorecard,
)


def test_nine_reports_equal_from_merged_facts(spark, tmp_path):
    star = order_book_star(spark, GIVEN)
    early = Star.of(
        orders=star.orders.where("order_date < DATE '1998-06-01'"), order_items=star.order_items
    )
    merge_order_facts(early, str(tmp_path))
    late = star.orders.where("order_date >= DATE '1998-06-01'").select("order_id")
    merged = merge_order_facts(star, str(tmp_path), late)
    for report in NINE:
        assert sorted(map(repr, report(merged).collect())) == sorted(
            map(repr, report(star).collect())
        ), report.__name__


def test_a_hot_customer_day_is_dealt_over_the_tasks(spark):
    """Half of all orders on one day of one customer: no task writes twice the mean."""
    many = spark.range(20_000).select(
        F.concat(F.lit("O"), "id").alias("order_id"),
        F.when(F.col("id") < 10_000, "hot").otherwise(F.concat(F.lit("C"), "id")).alias("customer_id"),
        F.when(F.col("id") < 10_000, F.lit("2023-01-01"))
        .otherwise(F.concat(F.lit("2023-02-0"), F.col("id") % 9 + 1))
        .cast("date")
        .alias("order_date"),
        F.lit("Delivered").alias("status"),
    )
    second = many.where("customer_id != 'hot'").withColumn(
        "order_date", F.date_add("order_date", 3)
    )
    found = customers.customer_gaps(Star.of(orders=many.unionByName(second)))
    held = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(held) == 9_999 + 10_000
    hot = found.where("customer_id = 'hot'")
    tasks = [r["count"] for r in hot.groupBy(F.spark_partition_id().alias("t")).count().collect()]
    assert len(tasks) == 8 and max(tasks) < 2 * sum(tasks) / 8
    assert hot.select("purchase_seq").distinct().count() == 9_999


def test_no_folder_is_left_in_the_old_layout(spark, tmp_path):
    root = str(tmp_path / "tables")
    load_tables(spark, _csv(tmp_path / "csv"), root)
    assert sorted(os.listdir(root)) == ["published", "versions"]


def test_cells_of_single_lines_are_those_of_the_csv_reader(spark, tmp_path):
    """Lines without a quote are cut at commas, and each line once, not once per condition."""
    draw = random.Random(3)
    parts = ["S1", "a ", "é", "2020-01-01", ",", ",", ",", ",", ",", '"', '"b,c"', '""', " ", "\t", "\\", "#", "7"]
    text = ["".join(draw.choices(parts, k=draw.randint(1, 12))) for _ in range(3000)]
    (tmp_path / "lines.csv").write_text("\n".join(text) + "\n")
    names = ["a", "b", "c"]
    lines = _lines(spark, str(tmp_path / "lines.csv"), names)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "w", "quote": '"', "escape": '"'}
    whole = F.from_csv("_line", "a STRING, b STRING, c STRING, w STRING", options)
    found = lines.select(
        whole.alias("x"), _odd(names).alias("odd"), F.array(*map(_cell, range(3), names)).alias("y")
    ).collect()
    assert len(found) == 3000 and 100 < sum(not r.odd for r in found) < 2900
    assert all(r.odd == (r.x.w is not None) for r in found)
    assert all(r.odd or r.y == [r.x.a, r.x.b, r.x.c] for r in found)
    good, _ = split_csv_table(spark, _one_store(tmp_path), "stores")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1  # before the conditions, not in each


def _one_store(folder):
    (folder / "stores.csv").write_text(
        "store_id,store_name,state,city,opened_date,store_size_sqm\nS1,Main,NSW,Sydney,2020-01-01,5\n"
    )
    return str(folder / "stores.csv")
