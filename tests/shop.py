"""A small hand-made shop; tests state only the rows they are about."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tillscope.sources.schema import TABLES
from tillscope.sources.star import Star


def day(text: str) -> date:
    return date.fromisoformat(text)


def cash(amount: float | str | None) -> Decimal | None:
    return None if amount is None else Decimal(str(amount)).quantize(Decimal("0.01"))


def frame(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    """Rows under the declared names and types, every column nullable."""
    fields = [T.StructField(name, kind) for name, kind in TABLES[table].columns]
    return spark.createDataFrame(rows, T.StructType(fields))


def customer(key: str, segment: str = "Regular", state: str = "NSW") -> tuple:
    return (key, "Ann", "Lee", state, "Town", day("2021-01-01"), segment)


def product(key: str, category: str = "Tea", brand: str = "Acme", cost: float = 1) -> tuple:
    return (key, f"Item {key}", category, "Any", brand, cash(10), cash(cost), True)


def store(key: str, size: int = 100) -> tuple:
    return (key, f"Store {key}", "NSW", "Town", day("2020-01-01"), size)


def promotion(key: str, name: str) -> tuple:
    return (key, name, day("2023-01-01"), day("2023-01-31"), cash(0.1))


def order(
    key: str,
    who: str,
    when: str,
    channel: str = "Online",
    shop: str | None = None,
    promo: str | None = None,
    status: str = "Delivered",
) -> tuple:
    return (key, who, day(when), channel, shop, promo, status)


def line(
    order_id: str, product_id: str, quantity: int, price: float, at: int = 1, listed: float = None
) -> tuple:
    return (
        order_id, at, product_id, quantity, cash(listed or price), cash(0), cash(price),
    )


def shop(
    spark: SparkSession,
    orders: list[tuple],
    items: list[tuple],
    customers: list[tuple] | None = None,
    products: list[tuple] | None = None,
    stores: list[tuple] | None = None,
    promotions: list[tuple] | None = None,
) -> Star:
    customers = customers or [customer(k) for k in sorted({o[1] for o in orders})]
    products = products or [product(k) for k in sorted({i[2] for i in items})]
    return Star.of(
        customers=frame(spark, "customers", customers),
        products=frame(spark, "products", products),
        stores=frame(spark, "stores", stores or [store("S1")]),
        promotions=frame(spark, "promotions", promotions or [promotion("P1", "Sale")]),
        orders=frame(spark, "orders", orders),
        order_items=frame(spark, "order_items", items),
    )


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]
