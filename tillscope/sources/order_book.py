"""Adapter: TPC-H-like Parquet tables read as the retail star.

``raw_star`` leaves the two columns with a declared default absent where the
source says nothing; ``order_book_star`` fills them as a load does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.sources.star import Star, fill_defaults

# The columns of the source tables.
SOURCE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
}


# Columns of each star table as SQL over its source.
_CUSTOMERS = (
    "c_custkey AS customer_id",
    "split_part(c_name, '#', 1) AS first_name",
    "split_part(c_name, '#', 2) AS last_name",
    "n_name AS state",
    "r_name AS city",
    "date_add(DATE '1990-01-01', CAST(c_custkey % 1826 AS INT)) AS signup_date",
    "c_mktsegment AS customer_segment",
)

_STORES = (
    "s_suppkey AS store_id",
    "s_name AS store_name",
    "n_name AS state",
    "r_name AS city",
    "date_add(DATE '1990-01-01', CAST(s_suppkey % 1826 AS INT)) AS opened_date",
    "CAST(200 + 100 * (s_suppkey % 11) AS INT) AS store_size_sqm",
)

_PRODUCTS = (
    "p_partkey AS product_id",
    "p_name AS product_name",
    "p_type AS category",
    "concat_ws(' ', p_type, p_size) AS subcategory",
    "p_brand AS brand",
    "CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 2 AS DECIMAL(10,2)) AS unit_price",
    "CAST(p_retailprice AS DECIMAL(10,2)) AS unit_cost",
    "CASE WHEN p_size = 1 THEN FALSE END AS is_active",
)

_ORDERS = (
    "o_orderkey AS order_id",
    "o_custkey AS customer_id",
    "CAST(o_orderdate AS DATE) AS order_date",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Online' "
    "WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'In-Store' "
    "ELSE 'Click & Collect' END AS channel",
    "CASE WHEN o_orderpriority != '1-URGENT' THEN o_orderkey % 10 END AS store_id",
    "CASE WHEN o_orderkey % 4 = 0 THEN concat('PR', o_orderkey % 9 + 1) END AS promo_id",
    "CASE WHEN o_orderstatus = 'P' THEN 'Cancelled' WHEN o_orderstatus = 'O' THEN 'Returned' "
    "ELSE 'Delivered' END AS status",
)

# whole cents first, so that both engines agree to the last digit
_LINE_CENTS = (
    "l_orderkey AS order_id",
    "l_linenumber AS line_item",
    "l_partkey AS product_id",
    "CAST(l_quantity AS INT) AS quantity",
    "floor(l_extendedprice * 100 + 0.5D) DIV CAST(l_quantity AS INT) AS unit_cents",
    "floor(l_discount * 100 + 0.5D) AS percent_off",
)

_ORDER_ITEMS = (
    "order_id",
    "line_item",
    "product_id",
    "quantity",
    "CAST(unit_cents * 0.01 AS DECIMAL(10,2)) AS unit_price",
    "CAST(nullif(percent_off, 0) * 0.01 AS DECIMAL(4,2)) AS discount_pct",
    "CAST((unit_cents * (100 - percent_off) + 50) DIV 100 * 0.01 AS DECIMAL(10,2)) "
    "AS final_unit_price",
)


# A promotion runs from its first order to its last. Orders name nine of them;
# the last two have no row here, so that references dangle. Some share a name.
_PROMOTED_ORDERS = ("o_orderkey % 9 + 1 AS number", "CAST(o_orderdate AS DATE) AS day")

_PROMOTIONS = (
    "concat('PR', number) AS promo_id",
    "concat('Sale ', number % 5 + 1) AS promo_name",
    "start_date",
    "end_date",
    "CAST(number * 0.02 AS DECIMAL(4,2)) AS discount_pct",
)


def raw_star(spark: SparkSession, sf_dir: str) -> Star:
    def read(table: str) -> DataFrame:
        return spark.read.schema(SOURCE_SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")

    def placed(table: str, nation_key: str) -> DataFrame:
        places = read("nation").join(read("region"), F.expr("n_regionkey = r_regionkey"), "left")
        return read(table).join(places, F.expr(f"{nation_key} = n_nationkey"), "left")

    def promotions() -> DataFrame:
        return (
            read("orders")
            .filter("o_orderkey % 4 = 0")
            .selectExpr(*_PROMOTED_ORDERS)
            .filter("number <= 7")
            .groupBy("number")
            .agg(F.min("day").alias("start_date"), F.max("day").alias("end_date"))
            .selectExpr(*_PROMOTIONS)
        )

    readers = {
        "customers": lambda: placed("customer", "c_nationkey").selectExpr(*_CUSTOMERS),
        "products": lambda: read("part").selectExpr(*_PRODUCTS),
        "stores": lambda: placed("supplier", "s_nationkey").selectExpr(*_STORES),
        "promotions": promotions,
        "orders": lambda: read("orders").selectExpr(*_ORDERS),
        "order_items": lambda: read("lineitem")
        .selectExpr(*_LINE_CENTS)
        .selectExpr(*_ORDER_ITEMS),
    }
    return Star(lambda name: readers[name]())


def order_book_star(spark: SparkSession, sf_dir: str) -> Star:
    raw = raw_star(spark, sf_dir)
    return Star(lambda name: fill_defaults(raw.table(name), name))
