"""Every registered query against its SQL, on given and on skewed tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as contract

GIVEN = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
#: queries of other packages are tested with them, on their own tables
KEYS = [key for key in contract.queries() if key.startswith("w")]
SPARK_TO_DUCKDB = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="session")
def skewed(tmp_path_factory):
    """Tables in which a third of all rows share one order, customer, day and product."""
    root = tmp_path_factory.mktemp("skewed")
    for name in ("region", "nation", "supplier"):
        pq.write_table(pq.read_table(f"{GIVEN}/{name}.parquet"), root / f"{name}.parquet")
    draw = np.random.default_rng(7)
    customers, parts, orders, lines = 60, 50, 900, 6000

    def hot(values, share, value):
        values[draw.random(len(values)) < share] = value
        return values

    pq.write_table(
        pa.table({
            "c_custkey": pa.array(range(customers), pa.int64()),
            "c_name": [f"Customer#{i:09d}" for i in range(customers)],
            "c_nationkey": pa.array(draw.integers(0, 25, customers), pa.int32()),
            "c_acctbal": draw.random(customers),
            # one segment for most customers
            "c_mktsegment": hot(np.array(["BUILDING", "MACHINERY"] * (customers // 2), object),
                                0.6, "HOUSEHOLD").tolist(),
        }),
        root / "customer.parquet",
    )
    pq.write_table(
        pa.table({
            "p_partkey": pa.array(range(parts), pa.int64()),
            "p_name": [f"item {i % 30}" for i in range(parts)],
            "p_brand": [f"Brand#{i % 6}" for i in range(parts)],
            "p_type": [("SMALL", "LARGE", "PROMO", "ECONOMY")[i % 4] for i in range(parts)],
            "p_size": pa.array(draw.integers(1, 4, parts), pa.int32()),
            "p_retailprice": np.round(900 + draw.random(parts) * 99, 2),
        }),
        root / "part.parquet",
    )
    start = datetime(1999, 1, 1)
    days = hot(draw.integers(0, 900, orders), 1 / 3, 400)
    pq.write_table(
        pa.table({
            "o_orderkey": pa.array(range(orders), pa.int64()),
            "o_custkey": pa.array(hot(draw.integers(0, customers, orders), 1 / 2, 7), pa.int64()),
            "o_orderstatus": draw.choice(["F", "O", "P"], orders).tolist(),
            "o_totalprice": draw.random(orders),
            "o_orderdate": pa.array([start + timedelta(int(d)) for d in days], pa.timestamp("us")),
            "o_orderpriority": draw.choice(
                ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], orders).tolist(),
        }),
        root / "orders.parquet",
    )
    kept = 1  # an order that is not cancelled takes a third of all lines
    status = pq.read_table(root / "orders.parquet")["o_orderstatus"].to_pylist()
    while status[kept] == "P":
        kept += 1
    pq.write_table(
        pa.table({
            "l_orderkey": pa.array(hot(draw.integers(0, orders, lines), 1 / 3, kept), pa.int64()),
            # parts beyond the catalogue are orphans
            "l_partkey": pa.array(hot(draw.integers(0, parts + 5, lines), 1 / 3, 3), pa.int64()),
            "l_suppkey": pa.array(draw.integers(0, 10, lines), pa.int64()),
            "l_linenumber": pa.array(draw.integers(1, 8, lines), pa.int32()),
            "l_quantity": draw.integers(1, 51, lines).astype("float64"),
            "l_extendedprice": np.round(draw.random(lines) * 9000 + 900, 2),
            "l_discount": draw.integers(0, 11, lines) / 100.0,
            "l_tax": draw.random(lines),
            "l_returnflag": ["N"] * lines,
            "l_linestatus": ["O"] * lines,
            "l_shipdate": pa.array([start] * lines, pa.timestamp("us")),
        }),
        root / "lineitem.parquet",
        row_group_size=1000,
    )
    return str(root)


def _check(spark, folder: str, key: str) -> None:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    cursor = con.execute(contract.oracle_sql()[key])
    described = [(d[0], str(d[1])) for d in cursor.description]
    expected = [dict(zip([n for n, _ in described], r)) for r in cursor.fetchall()]
    found = contract.queries()[key](spark, folder)
    kinds = {name: SPARK_TO_DUCKDB[kind] for name, kind in found.dtypes}
    assert kinds == dict(described)
    names = sorted(kinds)

    def tidy(records):
        return sorted(repr([r[n] for n in names]) for r in records)

    assert tidy([r.asDict() for r in found.collect()]) == tidy(expected)


def test_every_query_has_its_sql():
    assert set(KEYS) == {key for key in contract.oracle_sql() if key.startswith("w")}


@pytest.mark.parametrize("key", KEYS)
def test_given_tables(spark, key):
    _check(spark, GIVEN, key)


@pytest.mark.parametrize("key", KEYS)
def test_skewed_tables(spark, skewed, key):
    _check(spark, skewed, key)


def test_skewed_tables_without_broadcast_joins(spark, skewed):
    """The shapes large tables get: every join sorts and merges."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for key in ("w01_executive_summary", "w05_category_performance",
                    "w06_top_products_per_category", "w10_state_benchmark",
                    "w12_market_basket", "w13_new_vs_returning"):
            _check(spark, skewed, key)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_entry(spark):
    assert contract.entry(spark).count() == 1
