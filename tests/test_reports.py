"""The reports on hand-made shops, one rule at a time."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from tests.shop import customer, day, line, order, product, promotion, rows, shop, store
from tillscope.operators import baskets, commerce, customers, products, trends
from tillscope.plans.facts import materialise_order_facts


def test_summary_keeps_returns_and_drops_cancelled_and_empty_orders(spark):
    star = shop(
        spark,
        orders=[
            order("1", "a", "2023-01-01"),
            order("2", "a", "2023-01-02", status="Returned"),
            order("3", "b", "2023-01-03", status="Cancelled"),
            order("4", "b", "2023-01-04"),  # no lines
            order("5", "b", "2023-01-05"),  # unknown product only
        ],
        items=[line("1", "x", 2, 10), line("1", "y", 1, 5, at=2), line("2", "x", 1, 10),
               line("3", "x", 9, 10), line("5", "?", 1, 99)],
        products=[product("x", cost=4), product("y", cost=1)],
    )
    assert rows(commerce.executive_summary(star)) == [
        (2, 35.0, 22.0, 62.9, 17.5, 2.0, 1, 50.0)
    ]


def test_yoy_looks_at_the_previous_year_on_record(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2021-03-05"), order("2", "a", "2023-03-09"),
                order("3", "a", "2023-04-01")],
        items=[line("1", "x", 1, 100), line("2", "x", 1, 150), line("3", "x", 1, 7)],
    )
    assert rows(trends.monthly_revenue_yoy(star)) == [
        (day("2021-03-01"), 100.0, None, None),
        (day("2023-03-01"), 150.0, 100.0, 50.0),
        (day("2023-04-01"), 7.0, None, None),
    ]


def test_retention_counts_customers_and_stops_after_eight_quarters(spark):
    star = shop(
        spark,
        orders=[
            order("1", "a", "2020-02-01"), order("2", "a", "2020-03-01"),
            order("3", "a", "2022-02-01"),   # quarter 8
            order("4", "a", "2022-05-01"),   # quarter 9
            order("5", "b", "2020-01-15"),
            order("6", "c", "2019-01-01", status="Cancelled"),
        ],
        items=[line("1", "x", 1, 1)],
    )
    q = day("2020-01-01")
    assert rows(customers.cohort_retention(star)) == [(q, 2, 0, 2, 100.0), (q, 2, 8, 1, 50.0)]


def test_rfm_with_fewer_customers_than_buckets(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2024-12-30"), order("2", "b", "2024-12-01")],
        items=[line("1", "x", 1, 50), line("2", "x", 1, 10)],
    )
    found = customers.rfm_customers(star).orderBy("customer_id")
    assert rows(found) == [
        ("a", 1, 1, 50.0, 2, 1, 2, 212, "Others"),
        ("b", 30, 1, 10.0, 1, 2, 1, 121, "Others"),
    ]


def test_rfm_segments(spark):
    """Ten customers: later ones are more recent, spend more and buy more often."""
    names = [f"c{i}" for i in range(10)]
    orders, items = [], []
    for i, who in enumerate(names):
        for n in range(i + 1):
            key = f"{who}-{n}"
            orders.append(order(key, who, f"2024-{i + 1:02d}-{n + 1:02d}"))
            items.append(line(key, "x", 1, 10))
    scored = customers.rfm_customers(shop(spark, orders, items)).orderBy("customer_id")
    labels = [r.rfm_segment for r in scored.collect()]
    assert labels == ["Lost"] * 2 + ["Others"] * 2 + ["Potential Loyalists"] * 2 + ["Champions"] * 4
    shares = customers.rfm_segmentation(shop(spark, orders, items))
    assert sum(r.customer_count for r in shares.collect()) == 10
    assert rows(shares)[0][0] == "Champions"


def test_category_ranks_and_cumulative_share_on_tied_revenue(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01"), order("2", "a", "2023-01-02"),
                order("3", "b", "2023-01-03")],
        items=[line("1", "t", 1, 10), line("1", "u", 1, 10, at=2), line("2", "t", 1, 10),
               line("3", "c", 2, 10), line("1", "m", 1, 40, at=3)],
        products=[product("t", "Tea", cost=1), product("u", "Tea", cost=1),
                  product("c", "Coffee", cost=5), product("m", "Mugs", cost=39)],
    )
    assert rows(products.category_performance(star)) == [
        ("Mugs", 1, 1, 40.0, 1.0, 2.5, 1, 1, 3, 44.4),
        ("Tea", 2, 3, 30.0, 27.0, 90.0, 1, 2, 1, 77.8),
        ("Coffee", 1, 2, 20.0, 10.0, 50.0, 1, 3, 2, 100.0),
    ]


def test_top_products_break_ties_by_name_and_merge_equal_names(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01")],
        items=[line("1", key, 1, 5, at=i) for i, key in enumerate("abcd")],
        products=[("a", "B", "Tea", "s", "X", None, None, True),
                  ("b", "A", "Tea", "s", "X", None, None, True),
                  ("c", "A", "Tea", "s", "X", None, None, True),
                  ("d", "C", "Tea", "s", "X", None, None, True)],
    )
    assert rows(products.top_products_per_category(star, n=2)) == [
        ("Tea", "A", "X", 2, 10.0, 1),
        ("Tea", "B", "X", 1, 5.0, 2),
    ]


def test_promotions_keep_the_total_apart_from_orders_without_one(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01", promo="P1"), order("2", "a", "2023-01-02"),
                order("3", "a", "2023-01-03", promo="gone"),
                order("4", "a", "2023-01-03", promo="P2")],
        items=[line("1", "x", 2, 9, listed=10), line("2", "x", 1, 10), line("3", "x", 1, 10),
               line("4", "x", 1, 8, listed=10)],
        promotions=[promotion("P1", "Sale"), promotion("P2", "Sale")],
    )
    assert rows(commerce.promo_effectiveness(star)) == [
        ("No Promotion", 4, 11.5, 1.3, 46.0, 4.0, 8.0, True),
        ("Sale", 2, 13.0, 1.5, 26.0, 4.0, 13.3, False),
        ("No Promotion", 2, 10.0, 1.0, 20.0, 0.0, 0.0, False),
    ]


def test_channel_growth_skips_missing_quarters(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01"), order("2", "b", "2023-02-01", "In-Store"),
                order("3", "a", "2023-05-01", "In-Store"), order("4", "a", "2023-08-01"),
                order("5", "a", "2023-08-02")],
        items=[line("1", "x", 1, 30), line("2", "x", 1, 10), line("3", "x", 1, 5),
               line("4", "x", 1, 40), line("5", "x", 1, 5)],
    )
    assert rows(trends.channel_mix(star)) == [
        (day("2023-01-01"), "In-Store", 10.0, 1, 1, 25.0, None),
        (day("2023-01-01"), "Online", 30.0, 1, 1, 75.0, None),
        (day("2023-04-01"), "In-Store", 5.0, 1, 1, 100.0, -50.0),
        (day("2023-07-01"), "Online", 45.0, 2, 1, 100.0, 50.0),
    ]


def test_value_on_a_tier_edge_counts_in_both_tiers(spark):
    values = {"a": 49.99, "b": 50, "c": 200, "d": 500, "e": 500.01, "f": 300}
    star = shop(
        spark,
        orders=[order(k, k, "2023-01-01") for k in values] + [order("a2", "a", "2023-01-11")],
        items=[line(k, "x", 1, v) for k, v in values.items()],
    )
    # order a2 has no lines, so it stretches no tenure
    assert rows(customers.clv_distribution(star)) == [
        ("Regular", 6, 266.67, 250.0, 1.0, 0.0, 1, 2, 3, 1)
    ]


def test_clv_per_customer(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01"), order("2", "a", "2023-01-31")],
        items=[line("1", "x", 2, 10), line("1", "y", 1, 5, at=2), line("2", "x", 1, 10)],
        customers=[customer("a", "Premium", "VIC"), customer("idle")],
    )
    assert rows(customers.clv_customers(star)) == [
        ("a", "Premium", "VIC", day("2023-01-01"), day("2023-01-31"), 30, 2, 35.0, 11.67)
    ]


def test_states_against_the_nation(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01"), order("2", "a", "2023-01-02"),
                order("3", "b", "2023-01-01")],
        items=[line("1", "x", 1, 10), line("2", "x", 1, 20), line("3", "x", 1, 60)],
        customers=[customer("a", state="NSW"), customer("b", state="VIC")],
    )
    assert rows(commerce.state_benchmark(star)) == [
        ("VIC", 1, 1, 60.0, 60.0, 60.0, 30.0, 100.0, 66.7),
        ("NSW", 2, 1, 30.0, 15.0, 30.0, 30.0, -50.0, 33.3),
    ]


def test_rolling_mean_counts_rows_not_calendar_months(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01"), order("2", "a", "2023-02-01"),
                order("3", "a", "2023-06-01"), order("4", "a", "2023-07-01")],
        items=[line("1", "x", 1, 10), line("2", "x", 1, 20.01), line("3", "x", 1, 30),
               line("4", "x", 1, 10)],
    )
    assert rows(trends.rolling_revenue(star)) == [
        (day("2023-01-01"), 10.0, 10.0, 0.0, "On/Above Trend"),
        (day("2023-02-01"), 20.01, 15.01, 5.01, "On/Above Trend"),
        (day("2023-06-01"), 30.0, 20.0, 10.0, "On/Above Trend"),
        (day("2023-07-01"), 10.0, 20.0, -10.0, "Below Trend"),
    ]


def test_basket_lift_counts_orders_without_lines(spark):
    star = shop(
        spark,
        orders=[order(k, "a", "2023-01-01") for k in "1234"]
        + [order("5", "a", "2023-01-01", status="Cancelled")],
        items=[line("1", "t", 1, 1), line("1", "c", 1, 1, at=2), line("1", "t", 1, 1, at=3),
               line("2", "t", 1, 1), line("3", "c", 1, 1), line("3", "t", 1, 1, at=2),
               line("5", "m", 1, 1), line("5", "t", 1, 1, at=2)],
        products=[product("t", "Tea"), product("c", "Coffee"), product("m", "Mugs")],
    )
    assert rows(baskets.market_basket(star)) == [("Coffee", "Tea", 2, 2, 3, 1.333)]
    assert rows(baskets.item_pairs(star)) == [("Coffee", "Tea", 2)]


def _bought(seed: int) -> tuple[list, list, list]:
    """Orders of very different sizes over 40 products in 30 brands, with repeated lines."""
    draw = random.Random(seed)
    stock = [product(f"P{i:02}", brand=f"B{i % 30:02}") for i in range(40)]
    stock += [("NoBrand", "x", "Tea", "Any", None, None, None, True)]
    orders, items = [], []
    for i in range(60):
        status = "Cancelled" if i % 9 == 0 else "Delivered"
        orders.append(order(f"O{i}", "C1", "2023-01-01", status=status))
        size = draw.choice([0, 1, 2, 3, 5, 38])
        for at in range(size):
            which = draw.choice(["NoBrand", "Unknown", *(f"P{draw.randrange(40):02}" for _ in range(9))])
            items.append(line(f"O{i}", which, 1, 2, at=at))
    items += [line("O1", "P01", 1, 2, at=100 + i) for i in range(200)]
    return orders, items, stock


@pytest.mark.parametrize("least", [1, 4])
@pytest.mark.parametrize("longest", [2, 7, 64])
def test_bits_tree_and_blocks_count_the_same_pairs(spark, monkeypatch, least, longest):
    monkeypatch.setattr(baskets, "_LONGEST", longest)
    orders, items, stock = _bought(longest)
    star = shop(spark, orders, items, products=stock)
    brand_of = {p[0]: p[4] for p in stock}
    cancelled = {o[0] for o in orders if o[6] == "Cancelled"}
    held = {}
    for i in items:
        if brand_of.get(i[2]) and i[0] not in cancelled:
            held.setdefault(i[0], set()).add(brand_of[i[2]])
    counts = Counter(pair for own in held.values() for pair in combinations(sorted(own), 2))
    expected = sorted((a, b, n) for (a, b), n in counts.items() if n >= least)
    for few in (256, 0):
        found = rows(baskets.item_pairs(star, "brand", least_orders=least, few_items=few))
        assert found == expected
    bits, tree = (baskets.market_basket(star, "brand", least, few_items=n) for n in (256, 0))
    assert rows(bits) == rows(tree)


def test_baskets_without_items(spark):
    star = shop(spark, [order("O1", "C1", "2023-01-01")], [], products=[product("P1")])
    for few in (256, 0):
        assert rows(baskets.market_basket(star, "brand", few_items=few)) == []



def test_all_orders_of_the_first_day_are_new(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-05"), order("2", "a", "2023-01-05"),
                order("3", "a", "2023-01-09"), order("4", "b", "2023-01-01"),
                order("5", "b", "2023-01-02")],
        # the first order of b has no lines, its second one is still a return
        items=[line("1", "x", 1, 10), line("2", "x", 1, 10), line("3", "x", 1, 20),
               line("5", "x", 1, 40)],
    )
    assert rows(customers.new_vs_returning(star)) == [
        (day("2023-01-01"), "New", 2, 20.0, 25.0),
        (day("2023-01-01"), "Returning", 2, 60.0, 75.0),
    ]


def test_scorecard_drops_online_orders_and_idle_stores(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01", "In-Store", "S1"),
                order("2", "a", "2023-01-01", "Online", "S1"),
                order("3", "a", "2023-01-01", "Click & Collect", "S2"),
                order("4", "a", "2023-01-01", "In-Store", None)],
        items=[line("1", "x", 1, 10), line("1", "x", 4, 10, at=2), line("2", "x", 1, 99),
               line("3", "x", 1, 50), line("4", "x", 1, 99)],
        stores=[store("S1", 20), store("S2", 100), store("S3")],
    )
    assert rows(commerce.store_scorecard(star)) == [
        ("Store S1", "NSW", "Town", 20, 1, 50.0, 2.5, 50.0, 2.5, 1),
        ("Store S2", "NSW", "Town", 100, 1, 50.0, 0.5, 50.0, 1.0, 1),
    ]


def _visits(spark):
    dates = ["2023-01-01", "2023-01-01", "2023-01-08", "2023-01-16", "2023-04-16", "2023-07-16"]
    return shop(
        spark,
        orders=[order(str(i), "a", when) for i, when in enumerate(dates)]
        + [order("b", "once", "2023-01-01"),
           order("c", "a", "2023-01-02", status="Cancelled")],
        items=[line("1", "x", 1, 1)],
    )


def test_gaps_fall_into_buckets_by_their_upper_edge(spark):
    # 0, 7, 8, 90 and 91 days
    assert rows(customers.purchase_gap(_visits(spark))) == [
        ("0-7 days", 2, 3.5, 3.5),
        ("8-14 days", 1, 8.0, 8.0),
        ("61-90 days", 1, 90.0, 90.0),
        ("90+ days", 1, 91.0, 91.0),
    ]


@pytest.mark.parametrize("chunk", [1, 2, 4096])
def test_gap_rows_follow_each_other(spark, monkeypatch, chunk):
    monkeypatch.setattr(customers, "_CHUNK", chunk)
    found = customers.customer_gaps(_visits(spark)).orderBy("purchase_seq")
    assert rows(found) == [("a", 1, 0), ("a", 2, 7), ("a", 3, 8), ("a", 4, 90), ("a", 5, 91)]


def test_brand_rank_leaves_a_hole_after_a_tie(spark):
    star = shop(
        spark,
        orders=[order("1", "a", "2023-01-01")],
        items=[line("1", k, 1, p, at=i) for i, (k, p) in enumerate([("a", 5), ("b", 5), ("c", 2)])],
        products=[product("a", brand="A"), product("b", brand="B"), product("c", brand="C")],
    )
    assert rows(products.brand_share(star)) == [
        ("Tea", "A", 1, 5.0, 41.7, 1),
        ("Tea", "B", 1, 5.0, 41.7, 1),
        ("Tea", "C", 1, 2.0, 16.7, 3),
    ]


def test_reports_on_facts_at_rest_are_the_same(spark, tmp_path):
    star = _visits(spark)
    at_rest = materialise_order_facts(star, str(tmp_path / "facts"))
    for report in (trends.monthly_revenue_yoy, customers.new_vs_returning, commerce.state_benchmark):
        assert rows(report(at_rest)) == rows(report(star))
