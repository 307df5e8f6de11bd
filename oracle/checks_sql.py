"""Expected results of the load, quality and profile reports, for DuckDB."""

from __future__ import annotations

from oracle.star_sql import over_star

# Keys, references, rules and columns as the tables declare them.
KEYS = {
    "customers": ("customer_id",),
    "products": ("product_id",),
    "stores": ("store_id",),
    "promotions": ("promo_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "line_item"),
}

REFERENCES = (
    ("orders", "customer_id", "customers"),
    ("orders", "store_id", "stores"),
    ("orders", "promo_id", "promotions"),
    ("order_items", "order_id", "orders"),
    ("order_items", "product_id", "products"),
)

# table, rule, condition that breaks it
BROKEN = (
    ("customers", "customer_segment_known",
     "customer_segment NOT IN ('Regular', 'Premium', 'Budget')"),
    ("products", "unit_price_positive", "unit_price <= 0"),
    ("products", "unit_cost_positive", "unit_cost <= 0"),
    ("stores", "store_size_positive", "store_size_sqm <= 0"),
    ("promotions", "discount_within_0_1", "discount_pct < 0 OR discount_pct > 1"),
    ("promotions", "end_not_before_start", "end_date < start_date"),
    ("orders", "channel_known", "channel NOT IN ('Online', 'In-Store', 'Click & Collect')"),
    ("orders", "status_known",
     "status NOT IN ('Processing', 'Shipped', 'Delivered', 'Returned', 'Cancelled')"),
    ("order_items", "quantity_positive", "quantity <= 0"),
    ("order_items", "unit_price_positive", "unit_price <= 0"),
    ("order_items", "discount_not_negative", "discount_pct < 0"),
    ("order_items", "final_unit_price_positive", "final_unit_price <= 0"),
)

COLUMNS = {
    "customers": "customer_id, first_name, last_name, state, city, signup_date, customer_segment",
    "products": "product_id, product_name, category, subcategory, brand, unit_price, unit_cost, "
    "is_active",
    "stores": "store_id, store_name, state, city, opened_date, store_size_sqm",
    "promotions": "promo_id, promo_name, start_date, end_date, discount_pct",
    "orders": "order_id, customer_id, order_date, channel, store_id, promo_id, status",
    "order_items": "order_id, line_item, product_id, quantity, unit_price, discount_pct, "
    "final_unit_price",
}
#: tables with a column that has a default: nulls are counted before it is filled
DEFAULTED = ("products", "order_items")
OPTIONAL = {"orders": {"store_id", "promo_id"}}


def _all(selects) -> str:
    return over_star("\n" + "\nUNION ALL\n".join(selects))


def _key_text(key: tuple[str, ...]) -> str:
    parts = ", ".join(f"CAST({c} AS VARCHAR)" for c in key)
    return f"CAST(to_json([{parts}]) AS VARCHAR)"


def _copies(table: str) -> str:
    key = ", ".join(KEYS[table])
    return f"(SELECT {key}, count(*) AS copies FROM star_{table} GROUP BY {key} HAVING count(*) > 1)"


def _orphans(child: str, column: str, parent: str) -> str:
    return (
        f"(SELECT {column} AS k FROM star_{child} WHERE {column} IS NOT NULL "
        f"AND {column} NOT IN (SELECT {column} FROM star_{parent}))"
    )


def _sample(table: str, limit: str) -> str:
    casts = {
        "unit_price": "CAST(unit_price AS DOUBLE) AS unit_price",
        "unit_cost": "CAST(unit_cost AS DOUBLE) AS unit_cost",
        "discount_pct": "CAST(discount_pct AS DOUBLE) AS discount_pct",
        "final_unit_price": "CAST(final_unit_price AS DOUBLE) AS final_unit_price",
    }
    columns = COLUMNS[table].split(", ")
    picked = ", ".join(casts.get(c, c) for c in columns)
    rest = [c for c in columns if c not in KEYS[table]]
    order = ", ".join(f"s.{c} NULLS LAST" for c in (*KEYS[table], *rest))
    return over_star(f"\nSELECT {picked} FROM star_{table} s ORDER BY {order} {limit}")


_ROWS_GIVEN = "\nUNION ALL\n".join(
    f"SELECT CAST({at} AS BIGINT) AS load_order, '{t}' AS table_name, count(*) AS row_count "
    f"FROM star_{t}"
    for at, t in enumerate(KEYS, start=1)
)

CHECKS: dict[str, str] = {
    "w17_load_tables": over_star("\n" + _ROWS_GIVEN),
    "w17b_load_values": _all(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST(0 AS BIGINT) AS rows_lost, "
        f"CAST(0 AS BIGINT) AS rows_gained FROM star_{t}"
        for t in KEYS
    ),
    "w17c_load_rejects": over_star(f""",
spoilt AS (
    -- a row each, keys are not unique: how many of its cells, and of which columns
    SELECT 'order_items' AS table_name, ['quantity'] AS cells
    FROM star_order_items WHERE order_id % 97 = 0 AND line_item = 1
    UNION ALL
    SELECT 'orders', ['order_date'] FROM star_orders WHERE order_id % 101 = 0
    UNION ALL
    SELECT 'products',
           list_filter([if(product_id % 50 = 0, 'unit_price', NULL),
                        if(product_id % 75 = 0, 'is_active', NULL)], lambda c: c IS NOT NULL)
    FROM star_products WHERE product_id % 50 = 0 OR product_id % 75 = 0
),
rejects AS (
    SELECT table_name, count(*) AS set_aside, CAST(sum(len(cells)) AS BIGINT) AS cells,
           len(list_distinct(flatten(list(cells)))) AS columns
    FROM spoilt GROUP BY table_name
),
given AS ({_ROWS_GIVEN})
SELECT load_order, table_name, row_count - COALESCE(set_aside, 0) AS row_count,
       COALESCE(set_aside, 0) AS rows_set_aside, COALESCE(cells, 0) AS bad_cells,
       COALESCE(columns, 0) AS bad_columns
FROM given LEFT JOIN rejects USING (table_name)"""),
    "w25_order_facts": over_star("""
SELECT o.order_id, o.customer_id, o.order_date, o.channel, o.store_id, o.promo_id, o.status,
       CAST(ROUND(sum(quantity * final_unit_price), 2) AS DOUBLE) AS revenue,
       CAST(ROUND(sum(quantity * unit_price), 2) AS DOUBLE) AS list_value,
       CAST(sum(quantity) AS BIGINT) AS units,
       NULLIF(count(quantity), 0) AS line_count
FROM star_orders o LEFT JOIN star_order_items i USING (order_id)
GROUP BY ALL"""),
    "w18_primary_key_check": _all(
        f"SELECT '{t}' AS table_name, '{', '.join(key)}' AS key_columns, "
        "count(*) AS duplicate_keys, CAST(COALESCE(sum(copies - 1), 0) AS BIGINT) AS surplus_rows "
        f"FROM {_copies(t)}"
        for t, key in KEYS.items()
    ),
    "w18b_duplicate_keys": _all(
        f"SELECT '{t}' AS table_name, {_key_text(key)} AS key, copies "
        f"FROM {_copies(t)}"
        for t, key in KEYS.items()
    ),
    "w19_foreign_key_check": _all(
        f"SELECT '{child}' AS table_name, '{column}' AS column_name, '{parent}' AS parent_table, "
        "count(DISTINCT k) AS orphan_keys, count(*) AS orphan_rows "
        f"FROM {_orphans(child, column, parent)}"
        for child, column, parent in REFERENCES
    ),
    "w19b_orphan_keys": _all(
        f"SELECT '{child}' AS table_name, '{column}' AS column_name, '{parent}' AS parent_table, "
        "CAST(k AS VARCHAR) AS key, count(*) AS child_rows "
        f"FROM {_orphans(child, column, parent)} GROUP BY k"
        for child, column, parent in REFERENCES
    ),
    "w20_value_check": _all(
        f"SELECT '{t}' AS table_name, '{rule}' AS rule, count(*) FILTER ({broken}) AS violations "
        f"FROM star_{t}"
        for t, rule, broken in BROKEN
    ),
    "w21_not_null_check": _all(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_rows "
        f"FROM {'raw' if t in DEFAULTED else 'star'}_{t}"
        for t, columns in COLUMNS.items()
        for c in columns.split(", ")
        if c not in OPTIONAL.get(t, ())
    ),
    "w22_default_fill": _all(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, '{default}' AS default_value, "
        f"count(*) AS row_count, count(*) - count({c}) AS absent_before, "
        f"count(*) - count(COALESCE({c}, {default})) AS absent_after, "
        f"count(*) FILTER (COALESCE({c}, {default}) = {default}) AS rows_at_default FROM raw_{t}"
        for t, c, default in (("products", "is_active", "TRUE"), ("order_items", "discount_pct", "0"))
    ),
    "w23_table_profile": _all(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, '{columns}' AS column_names "
        f"FROM star_{t}"
        for t, columns in COLUMNS.items()
    ),
    **{
        f"w24_table_sample_{t}": _sample(t, "" if t == "promotions" else "LIMIT 5") for t in COLUMNS
    },
}
