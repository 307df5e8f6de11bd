"""What is bought together: pairs of categories, brands, products or any other attribute.

Both ways of counting are exact. Few items: an order is a row of bits, equal rows are
counted once. Many items: orders share the nodes of a prefix tree, pairs are counted per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.fixed_values import CANCELLED
from tillscope.functions.numbers import rounded_ratio, whole
from tillscope.plans.basket_facts import KEY, sold_lines
from tillscope.plans.facts import kept_orders
from tillscope.sources.star import Star

_WORD = 64
#: items that bits are kept for
FEW_ITEMS = 4 * _WORD
#: orders with more different items are counted in blocks, so that no row grows with them
_LONGEST = 64


def _in_baskets(star: Star, catalogue: DataFrame, excluded_status: str) -> DataFrame:
    """order_id and what ``catalogue`` says of the product, for every line of a kept order.

    ``catalogue`` has product_id; lines of a product that it lacks are left out.
    """
    return sold_lines(star, excluded_status).join(catalogue, "product_id").drop("product_id")


# --- few items: bits ---------------------------------------------------------------------


def _numbered(catalogue: DataFrame) -> DataFrame:
    """The items in order, numbered from 0; one task sees at most ``FEW_ITEMS`` rows."""
    names = catalogue.select("item").distinct()
    place = F.row_number().over(Window.orderBy("item")) - 1
    return names.select("item", place.alias("number"))


def _bit_sets(bought: DataFrame, words: int) -> DataFrame:
    """items (numbers, rising) and orders: each different basket once.

    A bit per item, OR-ed before the shuffle, so an order with any share of all lines sends
    one row of ``words`` numbers per map task; repeated lines need no DISTINCT.
    """
    bit = F.expr(f"shiftleft(1L, number % {_WORD})")

    def word(n: int) -> Column:
        return F.bit_or(F.when(F.floor(F.col("number") / _WORD) == n, bit).otherwise(F.lit(0)))

    names = [f"word{n}" for n in range(words)]
    baskets = (
        bought.groupBy(KEY)
        .agg(*(word(n).alias(name) for n, name in enumerate(names)))
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("orders"))
    )

    def held(n: int, name: str) -> Column:
        every = F.array(*(F.lit(n * _WORD + place) for place in range(_WORD)))
        return F.filter(every, lambda i: F.getbit(F.col(name), i - n * _WORD) == 1)

    items = F.concat(*(held(n, name) for n, name in enumerate(names)))
    return baskets.select(items.alias("items"), "orders")


def _pairs_of_sets(sets: DataFrame) -> DataFrame:
    """a, b and orders of every pair within the sorted ``items`` of a row."""
    first = sets.select("items", "orders", F.posexplode("items").alias("at", "a"))
    following = F.slice("items", F.col("at") + 2, F.size("items"))
    return (
        first.select("a", F.explode(following).alias("b"), "orders")
        .groupBy("a", "b")
        .agg(F.sum("orders").alias("orders"))
    )


# --- many items: a prefix tree -----------------------------------------------------------


def _supports(bought: DataFrame) -> DataFrame:
    return bought.groupBy("item").agg(F.count(F.lit(1)).alias("orders"))


def _tree_pairs(bought: DataFrame) -> DataFrame:
    """Pairs within orders of at most ``_LONGEST`` items, in rows of order, item, support.

    An order is a path from its most frequent item down. Equal paths are merged, then equal
    beginnings of paths: a node of the tree is one row with the orders below it, and
    pairs its last item with those before it once, not once per order.
    """
    path = F.sort_array(F.collect_list(F.struct((-F.col("support")).alias("rank"), "item")))
    paths = (
        bought.groupBy(KEY)
        .agg(path.alias("path"))
        .groupBy(F.col("path.item").alias("path"))
        .agg(F.count(F.lit(1)).alias("orders"))
    )
    nodes = (
        paths.select("orders", "path", F.posexplode("path").alias("at", "_"))
        .where("at > 0")
        .groupBy(F.slice("path", F.lit(1), F.col("at") + 1).alias("path"))
        .agg(F.sum("orders").alias("orders"))
    )
    last = F.element_at("path", -1)
    before = F.slice("path", F.lit(1), F.size("path") - 1)
    return nodes.select(last.alias("one"), F.explode(before).alias("other"), "orders")


def _block_pairs(bought: DataFrame) -> DataFrame:
    """Pairs within longer orders: their items in blocks, each two blocks in a row.

    However long the order, a row holds two blocks, and rows are dealt by order and block.
    """
    blocks = F.ceil(F.col("size") / _LONGEST)
    dealt = bought.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("item"), F.col("blocks"))
    )
    held = dealt.groupBy(KEY, "blocks", "block").agg(F.collect_list("item").alias("items"))
    left = held.select(
        KEY,
        F.col("items").alias("left"),
        "block",
        F.explode(F.sequence("block", F.col("blocks") - 1)).alias("with"),
    )
    right = held.select(KEY, F.col("block").alias("with"), F.col("items").alias("right"))
    one = (
        left.join(right, [KEY, "with"])
        .repartition(KEY, "block", "with")
        .select("right", F.explode("left").alias("one"), (F.col("block") == F.col("with")).alias("same"))
    )
    return (
        one.select("one", F.explode("right").alias("other"), "same")
        .where(~F.col("same") | (F.col("one") < F.col("other")))
        .select("one", "other", F.lit(1).cast("bigint").alias("orders"))
    )


def _pairs_of_many(bought: DataFrame, supports: DataFrame, least: int) -> DataFrame:
    """a, b and orders of every pair that at least ``least`` orders hold.

    An item in fewer orders is in no such pair and leaves first. ``bought`` has each item of
    an order once.
    """
    often = supports.where(F.col("orders") >= least)
    bought = bought.join(often.select("item", F.col("orders").alias("support")), "item")
    sizes = bought.groupBy(KEY).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = bought.join(sizes, KEY)
    met = _tree_pairs(sized.where(F.col("size") <= _LONGEST)).unionByName(
        _block_pairs(sized.where(F.col("size") > _LONGEST))
    )
    return (
        met.groupBy(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))
        .agg(F.sum("orders").alias("orders"))
        .where(F.col("orders") >= least)
    )


# --- reports -----------------------------------------------------------------------------


def _counted(
    star: Star, item: str, least: int, excluded_status: str, few: int
) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, orders) and items (item, orders), by the way that fits the catalogue.

    The catalogue's different items are counted when the plan is built, no further than
    one beyond ``few``.
    """
    catalogue = star.products.select("product_id", F.col(item).alias("item")).where(
        "item IS NOT NULL"
    )
    size = catalogue.select("item").distinct().limit(few + 1).count()
    if size > few:
        bought = _in_baskets(star, catalogue, excluded_status).distinct()
        supports = _supports(bought)
        return _pairs_of_many(bought, supports, least), supports
    numbers = _numbered(catalogue)
    products = catalogue.join(numbers, "item").select("product_id", "number")
    bought = _in_baskets(star, products, excluded_status)
    sets = _bit_sets(bought, max(1, -(-size // _WORD)))
    totals = sets.select(F.explode("items").alias("number"), "orders")
    items = totals.groupBy("number").agg(F.sum("orders").alias("orders")).join(numbers, "number")
    named = [numbers.select(F.col("item").alias(c), F.col("number").alias(f"no_{c}")) for c in "ab"]
    pairs = _pairs_of_sets(sets).withColumnsRenamed({"a": "no_a", "b": "no_b"})
    pairs = pairs.where(F.col("orders") >= least).join(named[0], "no_a").join(named[1], "no_b")
    return pairs.select("a", "b", "orders"), items.select("item", "orders")


def item_pairs(
    star: Star,
    item: str = "category",
    least_orders: int = 1,
    excluded_status: str = CANCELLED,
    few_items: int = FEW_ITEMS,
) -> DataFrame:
    """Orders that hold both items of a pair (the first sorts lower).

    ``item`` is any column of the products. Pairs in fewer than ``least_orders`` orders are
    left out. Up to ``few_items`` different items are kept as bits, more in a prefix tree.
    """
    pairs, _ = _counted(star, item, least_orders, excluded_status, min(few_items, FEW_ITEMS))
    first, second = f"{item}_a", f"{item}_b"
    return pairs.select(
        F.col("a").alias(first), F.col("b").alias(second), F.col("orders").alias("co_occurrence")
    ).orderBy(first, second)


def market_basket(
    star: Star,
    item: str = "category",
    least_orders: int = 1,
    excluded_status: str = CANCELLED,
    few_items: int = FEW_ITEMS,
) -> DataFrame:
    """Pairs of items bought together and their lift, as for ``item_pairs``.

    The lift is taken against all kept orders, also those without lines.
    """
    pairs, items = _counted(star, item, least_orders, excluded_status, min(few_items, FEW_ITEMS))
    all_orders = kept_orders(star, excluded_status).agg(F.count(F.lit(1)).alias("n")).scalar()
    left = items.select(F.col("item").alias("a"), F.col("orders").alias("orders_with_a"))
    right = items.select(F.col("item").alias("b"), F.col("orders").alias("orders_with_b"))
    together = whole(F.col("orders")) * F.col("all_orders")
    expected = whole(F.col("orders_with_a")) * F.col("orders_with_b")
    first, second = f"{item}_a", f"{item}_b"
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .withColumn("all_orders", all_orders)
        .select(
            F.col("a").alias(first),
            F.col("b").alias(second),
            F.col("orders").alias("co_occurrence"),
            "orders_with_a",
            "orders_with_b",
            rounded_ratio(together, expected, 3).alias("lift"),
        )
        .orderBy(F.desc("lift"), F.desc("co_occurrence"), first, second)
    )
