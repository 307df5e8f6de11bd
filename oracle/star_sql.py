"""The test star as SQL common table expressions over the given tables."""

from __future__ import annotations

STAR = """
star_customers AS (
    SELECT c_custkey AS customer_id,
           split_part(c_name, '#', 1) AS first_name,
           split_part(c_name, '#', 2) AS last_name,
           n_name AS state,
           r_name AS city,
           CAST(DATE '1990-01-01' + CAST(c_custkey % 1826 AS INTEGER) AS DATE) AS signup_date,
           c_mktsegment AS customer_segment
    FROM customer
    LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
),
raw_products AS (
    SELECT p_partkey AS product_id,
           p_name AS product_name,
           p_type AS category,
           p_type || ' ' || p_size AS subcategory,
           p_brand AS brand,
           CAST(CAST(p_retailprice AS DECIMAL(10,2)) * 2 AS DECIMAL(10,2)) AS unit_price,
           CAST(p_retailprice AS DECIMAL(10,2)) AS unit_cost,
           CASE WHEN p_size = 1 THEN FALSE END AS is_active
    FROM part
),
star_products AS (
    SELECT * REPLACE (COALESCE(is_active, TRUE) AS is_active) FROM raw_products
),
star_stores AS (
    SELECT s_suppkey AS store_id,
           s_name AS store_name,
           n_name AS state,
           r_name AS city,
           CAST(DATE '1990-01-01' + CAST(s_suppkey % 1826 AS INTEGER) AS DATE) AS opened_date,
           CAST(200 + 100 * (s_suppkey % 11) AS INTEGER) AS store_size_sqm
    FROM supplier
    LEFT JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey
),
star_promotions AS (
    SELECT 'PR' || number AS promo_id,
           'Sale ' || (number % 5 + 1) AS promo_name,
           CAST(min(o_orderdate) AS DATE) AS start_date,
           CAST(max(o_orderdate) AS DATE) AS end_date,
           CAST(number * CAST(0.02 AS DECIMAL(3,2)) AS DECIMAL(4,2)) AS discount_pct
    FROM (SELECT o_orderkey % 9 + 1 AS number, o_orderdate FROM orders WHERE o_orderkey % 4 = 0)
    WHERE number <= 7
    GROUP BY number
),
star_orders AS (
    SELECT o_orderkey AS order_id,
           o_custkey AS customer_id,
           CAST(o_orderdate AS DATE) AS order_date,
           CASE o_orderpriority
               WHEN '1-URGENT' THEN 'Online'
               WHEN '2-HIGH' THEN 'In-Store'
               WHEN '3-MEDIUM' THEN 'In-Store'
               ELSE 'Click & Collect'
           END AS channel,
           CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderkey % 10 END AS store_id,
           CASE WHEN o_orderkey % 4 = 0 THEN 'PR' || (o_orderkey % 9 + 1) END AS promo_id,
           CASE o_orderstatus WHEN 'P' THEN 'Cancelled' WHEN 'O' THEN 'Returned'
                ELSE 'Delivered' END AS status
    FROM orders
),
priced_lines AS (
    SELECT *,
           CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) // CAST(l_quantity AS BIGINT)
               AS unit_cents,
           CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS percent_off
    FROM lineitem
),
raw_order_items AS (
    SELECT l_orderkey AS order_id,
           l_linenumber AS line_item,
           l_partkey AS product_id,
           CAST(l_quantity AS INTEGER) AS quantity,
           CAST(unit_cents * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(10,2)) AS unit_price,
           CAST(NULLIF(percent_off, 0) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(4,2))
               AS discount_pct,
           CAST((unit_cents * (100 - percent_off) + 50) // 100 * CAST(0.01 AS DECIMAL(3,2))
                AS DECIMAL(10,2)) AS final_unit_price
    FROM priced_lines
),
star_order_items AS (
    SELECT * REPLACE (CAST(COALESCE(discount_pct, 0) AS DECIMAL(4,2)) AS discount_pct)
    FROM raw_order_items
),
kept AS (
    SELECT * FROM star_orders WHERE status <> 'Cancelled'
),
sales AS (
    SELECT kept.*, i.product_id, i.quantity,
           i.quantity * i.final_unit_price AS net,
           i.quantity * i.unit_price AS gross
    FROM kept JOIN star_order_items i USING (order_id)
),
product_sales AS (
    SELECT * FROM sales JOIN star_products USING (product_id)
)
"""


def over_star(body: str) -> str:
    """A query on the star: ``body`` may add CTEs after a leading comma."""
    return f"WITH {STAR.strip()}{body if body.startswith(',') else chr(10) + body}"


def half_up(value: str, digits: int) -> str:
    """ROUND a DOUBLE that ends in halves on its decimal value: ROUND alone sees 1.005 as
    less than a tie. Medians only: for any quotient this would round twice."""
    return f"CAST(ROUND(CAST({value} AS DECIMAL(38,8)), {digits}) AS DOUBLE)"


def div(numerator: str, denominator: str, digits: int, times: int = 1) -> str:
    """Quotient of numbers of at most two places, half up in whole numbers."""
    above = f"CAST(ROUND(({numerator}) * 100) AS HUGEINT)"
    below = f"CAST(ROUND(({denominator}) * 100) AS HUGEINT)"
    size = (
        f"(2 * {times * 10**digits} * abs({above}) + abs({below})) // NULLIF(2 * abs({below}), 0)"
    )
    sign = f"if(({above} < 0) <> ({below} < 0), -1, 1)"
    return f"CAST({sign} * ({size}) AS DOUBLE) / {10**digits}"


def pct(numerator: str, denominator: str) -> str:
    return div(numerator, denominator, 1, times=100)


def cents(amount: str) -> str:
    return f"CAST(ROUND({amount}, 2) AS DOUBLE)"
