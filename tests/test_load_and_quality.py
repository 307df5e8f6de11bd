from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.shop import cash, customer, day, frame, line, order, product, promotion, rows, shop
from tillscope.operators import profile, quality
from tillscope.plans import session
from tillscope.sources.load import (
    load_differences,
    load_report,
    load_tables,
    read_csv_table,
    write_csv_tables,
)
from tillscope.sources.schema import TABLES
from tillscope.sources.star import Star, read_star

CSV = {
    "customers": "customer_id,first_name,last_name,state,city,signup_date,customer_segment\n"
    "C1,Ann,Lee,NSW,Sydney,2022-01-05,Regular\n",
    "products": "product_id,product_name,category,subcategory,brand,unit_price,unit_cost,is_active\n"
    'P1,"Tea, black",Tea,Leaf,Acme,2.345,1.10,1\nP2,Mug,Mugs,Cup,Acme,3.00,2.00,0\n'
    "P3,Pot,Mugs,Pot,Acme,9.00,4.00,\n",
    "stores": "store_id,store_name,state,city,opened_date,store_size_sqm\n"
    "S1,Main,NSW,Sydney,2020-01-01,200\n",
    "promotions": "promo_id,promo_name,start_date,end_date,discount_pct\n"
    "R1,Sale,2023-01-01,2023-01-02,0.1\n",
    "orders": "order_id,customer_id,order_date,channel,store_id,promo_id,status\n"
    "O1,C1,2023-01-01,Online,,,Delivered\nO2,C1,2023-01-02,In-Store,S1,R1,Shipped\n",
    "order_items": "order_id,line_item,product_id,quantity,unit_price,discount_pct,"
    "final_unit_price\nO1,1,P1,2,2.35,,2.35\nO2,1,P2,1,3.00,0.1,2.70\n",
}


@pytest.fixture()
def csv_root(tmp_path):
    for name, text in CSV.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return str(tmp_path)


def test_load_types_nulls_and_defaults(spark, csv_root, tmp_path):
    report = load_report(spark, csv_root, str(tmp_path / "tables"))
    assert [r.table_name for r in report.collect()] == list(TABLES)
    assert [r.row_count for r in report.collect()] == [1, 3, 1, 1, 2, 2]
    star = read_star(spark, str(tmp_path / "tables"))
    assert [f.dataType for f in star.products.schema] == [k for _, k in TABLES["products"].columns]
    assert sorted(rows(star.products, "product_name", "unit_price", "is_active")) == [
        ("Mug", Decimal("3.00"), False),
        ("Pot", Decimal("9.00"), None),  # an empty cell is not filled
        ("Tea, black", Decimal("2.35"), True),  # third decimal rounded half up
    ]
    assert sorted(rows(star.orders, "order_id", "store_id")) == [("O1", None), ("O2", "S1")]
    assert sorted(rows(star.order_items, "order_id", "discount_pct")) == [
        ("O1", None), ("O2", Decimal("0.10")),
    ]


def test_load_fills_defaults_when_asked_and_where_the_column_is_left_out(spark, tmp_path):
    path = tmp_path / "products.csv"
    path.write_text(CSV["products"])
    filled = read_csv_table(spark, str(path), "products", fill_nulls=True)
    assert sorted(rows(filled, "product_id", "is_active")) == [
        ("P1", True), ("P2", False), ("P3", True),
    ]
    path.write_text("\n".join(x.rpartition(",")[0] for x in CSV["products"].splitlines()))
    assert rows(read_csv_table(spark, str(path), "products"), "is_active") == [(True,)] * 3


ODD = ['Ann "Annie"', "ends in \\", " spaced ", "a,b", '"', "back\\slash\"quote"]


def test_odd_texts_survive_the_csv_both_ways(spark, csv_root, tmp_path):
    path = tmp_path / "customers.csv"
    cells = (x.replace('"', '""') for x in ODD)
    lines = [f'{i},"{x}",Lee,NSW,Town,2022-01-05,Regular' for i, x in enumerate(cells)]
    path.write_text("\n".join([CSV["customers"].splitlines()[0], *lines]))
    star = load_tables(spark, csv_root, str(tmp_path / "tables"))
    assert [x for _, x in sorted(rows(star.customers, "customer_id", "first_name"))] == ODD
    write_csv_tables(star, str(tmp_path / "again"))
    again = load_tables(spark, str(tmp_path / "again"), str(tmp_path / "tables2"))
    found = {r[0]: r[1:] for r in rows(load_differences(star, again))}
    assert found["customers"] == (len(ODD), 0, 0)
    assert all(lost == gained == 0 for _, lost, gained in found.values())
    path.write_text(path.read_text().replace("Annie", "Anna"))
    changed = load_tables(spark, csv_root, str(tmp_path / "tables3"))
    found = {r[0]: r[1:] for r in rows(load_differences(star, changed))}
    assert found["customers"] == (len(ODD), 1, 1)


def test_a_quoted_line_break_needs_multi_line(spark, tmp_path):
    path = tmp_path / "stores.csv"
    path.write_text(CSV["stores"].replace("Main", '"Main\nhall"'))
    found = read_csv_table(spark, str(path), "stores", multi_line=True)
    assert rows(found, "store_name") == [("Main\nhall",)]


def test_load_replaces_what_was_there(spark, csv_root, tmp_path):
    for _ in range(2):
        counts = load_report(spark, csv_root, str(tmp_path / "tables")).collect()
    assert [r.row_count for r in counts] == [1, 3, 1, 1, 2, 2]


def test_load_refuses_a_wrong_header_and_a_wrong_value(spark, tmp_path):
    bad = tmp_path / "stores.csv"
    bad.write_text(CSV["stores"].replace("store_name", "name"))
    with pytest.raises(Exception, match="CSV header"):
        read_csv_table(spark, str(bad), "stores").collect()
    bad.write_text(CSV["stores"].replace(",200", ",large"))
    with pytest.raises(Exception, match="MALFORMED|large"):
        read_csv_table(spark, str(bad), "stores").collect()


@pytest.fixture(scope="module")
def dirty(spark):
    star = shop(
        spark,
        orders=[
            order("1", "a", "2023-01-01", shop="S1", promo="P9"),
            order("1", "a", "2023-01-01"),
            order("2", "zz", "2023-01-01", channel="Phone", shop="S8", status="Lost"),
            order("3", "zz", "2023-01-01", shop="S8"),
        ],
        items=[line("1", "x", 1, 5), line("1", "x", 0, 5), line("1", "x", 1, 5, at=2),
               line("9", "y", 1, -2)],
        customers=[customer("a", segment="Gold"), (None, None, "Lee", "NSW", "Town", None, None)],
        products=[product("x", cost=0)],
        promotions=[promotion("P1", "Sale"),
                    ("P2", "Odd", day("2023-02-01"), day("2023-01-01"), cash(1.5))],
    )
    return star


def test_duplicate_keys(dirty):
    assert sorted(rows(quality.all_duplicate_keys(dirty))) == [
        ("order_items", '["1","1"]', 2), ("orders", '["1"]', 2),
    ]
    counts = {r.table_name: (r.duplicate_keys, r.surplus_rows)
              for r in quality.primary_key_check(dirty).collect()}
    assert counts["orders"] == (1, 1) and counts["order_items"] == (1, 1)
    assert counts["stores"] == (0, 0) and list(counts) == list(TABLES)


def test_orphans_ignore_null_references(dirty):
    assert sorted(rows(quality.all_orphan_keys(dirty))) == [
        ("order_items", "order_id", "orders", "9", 1),
        ("order_items", "product_id", "products", "y", 1),
        ("orders", "customer_id", "customers", "zz", 2),
        ("orders", "promo_id", "promotions", "P9", 1),
        ("orders", "store_id", "stores", "S8", 2),
    ]
    counted = {(r.table_name, r.column_name): (r.orphan_keys, r.orphan_rows)
               for r in quality.foreign_key_check(dirty).collect()}
    assert len(counted) == 5 and counted["orders", "store_id"] == (1, 2)


def test_broken_values_and_nulls_are_counted_apart(dirty):
    broken = {(r.table_name, r.rule): r.violations for r in quality.value_check(dirty).collect()}
    assert len(broken) == 12
    assert {k: v for k, v in broken.items() if v} == {
        ("customers", "customer_segment_known"): 1,
        ("products", "unit_cost_positive"): 1,
        ("promotions", "discount_within_0_1"): 1,
        ("promotions", "end_not_before_start"): 1,
        ("orders", "channel_known"): 1,
        ("orders", "status_known"): 1,
        ("order_items", "quantity_positive"): 1,
        ("order_items", "unit_price_positive"): 1,
        ("order_items", "final_unit_price_positive"): 1,
    }
    nulls = {(r.table_name, r.column_name): r.null_rows
             for r in quality.not_null_check(dirty).collect()}
    assert len(nulls) == 38
    assert {k for k, v in nulls.items() if v} == {
        ("customers", c) for c in ("customer_id", "first_name", "signup_date", "customer_segment")
    }


def test_default_report(spark):
    raw = Star.of(
        products=frame(spark, "products", [product("x"), product("y")[:-1] + (None,)]),
        order_items=frame(spark, "order_items", [line("1", "x", 1, 5)]).withColumn(
            "discount_pct", F.lit(None).cast("decimal(4,2)")
        ),
    )
    assert rows(quality.default_fill_report(raw)) == [
        ("products", "is_active", "TRUE", 2, 1, 0, 2),
        ("order_items", "discount_pct", "0", 1, 1, 0, 1),
    ]


def test_profile_and_samples(dirty):
    found = {r.table_name: r for r in profile.table_profile(dirty).collect()}
    assert found["orders"].row_count == 4
    assert found["stores"].column_names == (
        "store_id, store_name, state, city, opened_date, store_size_sqm"
    )
    assert rows(profile.table_sample(dirty, "order_items", 2), "order_id", "quantity") == [
        ("1", 0), ("1", 1),
    ]
    assert profile.table_sample(dirty, "promotions", None).count() == 2
    assert rows(profile.table_sample(dirty, "customers"), "customer_id") == [("a",), (None,)]
    with pytest.raises(KeyError):
        dirty.table("invoices")


def test_shared_folder_is_the_one_the_session_names(spark, shared):
    assert session.shared_folder(spark) == shared
    assert spark.sparkContext.getCheckpointDir().startswith(f"file:{shared}")


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Cluster())
