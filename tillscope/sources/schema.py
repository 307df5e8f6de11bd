"""The retail star schema as data: columns, keys, rules and defaults.

Spark does not enforce keys or checks on DataFrames, so they are kept here for
the quality reports in ``tillscope.operators.quality``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

from tillscope.fixed_values import CHANNELS, CUSTOMER_SEGMENTS, STATUSES

MONEY = T.DecimalType(10, 2)
FRACTION = T.DecimalType(4, 2)
STRING = T.StringType()
INT = T.IntegerType()
DATE = T.DateType()
BOOLEAN = T.BooleanType()


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[tuple[str, T.DataType], ...]
    key: tuple[str, ...]
    nullable: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    #: rule name -> SQL condition every row has to meet (NULL passes)
    rules: dict[str, str] = field(default_factory=dict)
    #: column -> SQL literal used where the value is absent
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def struct(self) -> T.StructType:
        return T.StructType(
            [T.StructField(name, kind, name in self.nullable) for name, kind in self.columns]
        )

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.columns if name not in self.nullable)


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


CUSTOMERS = TableSpec(
    "customers",
    (
        ("customer_id", STRING),
        ("first_name", STRING),
        ("last_name", STRING),
        ("state", STRING),
        ("city", STRING),
        ("signup_date", DATE),
        ("customer_segment", STRING),
    ),
    key=("customer_id",),
    rules={"customer_segment_known": _one_of("customer_segment", CUSTOMER_SEGMENTS)},
)

PRODUCTS = TableSpec(
    "products",
    (
        ("product_id", STRING),
        ("product_name", STRING),
        ("category", STRING),
        ("subcategory", STRING),
        ("brand", STRING),
        ("unit_price", MONEY),
        ("unit_cost", MONEY),
        ("is_active", BOOLEAN),
    ),
    key=("product_id",),
    rules={"unit_price_positive": "unit_price > 0", "unit_cost_positive": "unit_cost > 0"},
    defaults={"is_active": "TRUE"},
)

STORES = TableSpec(
    "stores",
    (
        ("store_id", STRING),
        ("store_name", STRING),
        ("state", STRING),
        ("city", STRING),
        ("opened_date", DATE),
        ("store_size_sqm", INT),
    ),
    key=("store_id",),
    rules={"store_size_positive": "store_size_sqm > 0"},
)

PROMOTIONS = TableSpec(
    "promotions",
    (
        ("promo_id", STRING),
        ("promo_name", STRING),
        ("start_date", DATE),
        ("end_date", DATE),
        ("discount_pct", FRACTION),
    ),
    key=("promo_id",),
    rules={
        "discount_within_0_1": "discount_pct BETWEEN 0 AND 1",
        "end_not_before_start": "end_date >= start_date",
    },
)

ORDERS = TableSpec(
    "orders",
    (
        ("order_id", STRING),
        ("customer_id", STRING),
        ("order_date", DATE),
        ("channel", STRING),
        ("store_id", STRING),
        ("promo_id", STRING),
        ("status", STRING),
    ),
    key=("order_id",),
    nullable=("store_id", "promo_id"),
    foreign_keys=(
        ForeignKey("customer_id", "customers", "customer_id"),
        ForeignKey("store_id", "stores", "store_id"),
        ForeignKey("promo_id", "promotions", "promo_id"),
    ),
    rules={
        "channel_known": _one_of("channel", CHANNELS),
        "status_known": _one_of("status", STATUSES),
    },
)

ORDER_ITEMS = TableSpec(
    "order_items",
    (
        ("order_id", STRING),
        ("line_item", INT),
        ("product_id", STRING),
        ("quantity", INT),
        ("unit_price", MONEY),
        ("discount_pct", FRACTION),
        ("final_unit_price", MONEY),
    ),
    key=("order_id", "line_item"),
    foreign_keys=(
        ForeignKey("order_id", "orders", "order_id"),
        ForeignKey("product_id", "products", "product_id"),
    ),
    rules={
        "quantity_positive": "quantity > 0",
        "unit_price_positive": "unit_price > 0",
        "discount_not_negative": "discount_pct >= 0",
        "final_unit_price_positive": "final_unit_price > 0",
    },
    defaults={"discount_pct": "0"},
)

#: parents before children
TABLES: dict[str, TableSpec] = {
    spec.name: spec for spec in (CUSTOMERS, PRODUCTS, STORES, PROMOTIONS, ORDERS, ORDER_ITEMS)
}
