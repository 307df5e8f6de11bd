from __future__ import annotations

import random
from fractions import Fraction

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.shop import rows
from tillscope.functions.calendar import quarters_between
from tillscope.functions.labels import first_match
from tillscope.functions.numbers import dollar_ratio, in_cents, percent, rounded_ratio
from tillscope.functions.ordering import ntile_of, with_position
from tillscope.functions.selection import middle_values
from tillscope.plans.session import scale_settings


def test_ratio_by_zero_is_null(spark):
    df = spark.range(1).select(rounded_ratio(F.lit(3), F.lit(0), 1), percent(F.lit(1), F.lit(0)))
    assert rows(df) == [(None, None)]


@pytest.mark.parametrize(
    "numerator, denominator, digits, expected",
    [
        (1005, 1000, 2, 1.01), (-1005, 1000, 2, -1.01), (1005, -1000, 2, -1.01),
        (93447710, 2000, 2, 46723.86), (5, 2, 0, 3.0), (0, 7, 2, 0.0), (None, 1, 1, None),
        # just below a tie: rounding to eight places first would make it one
        (12_349_999_996, 10**9, 1, 12.3), (-12_349_999_996, 10**9, 1, -12.3),
        (2**63 - 1, 1, 0, float(2**63 - 1)), (2**63 - 1, 2**63 - 1, 3, 1.0),
    ],
)
def test_ratios_round_half_up_once(spark, numerator, denominator, digits, expected):
    df = spark.createDataFrame([(numerator, denominator)], "n long, d long")
    assert rows(df.select(rounded_ratio(F.col("n"), F.col("d"), digits))) == [(expected,)]


def test_ratios_equal_exact_fractions(spark):
    draw = random.Random(2)
    pairs = [(draw.randint(-(10**12), 10**12), draw.randint(1, 10 ** draw.randint(1, 9)))
             for _ in range(400)]
    df = spark.createDataFrame(pairs, "n long, d long")
    found = rows(df.select("n", "d", dollar_ratio(F.col("n"), F.col("d")), percent(F.col("n"), F.col("d"))))
    for n, d, dollars_each, share in found:
        for value, scale, got in ((Fraction(n, 100 * d), 100, dollars_each), (Fraction(100 * n, d), 10, share)):
            size = (2 * abs(value) * scale + 1) // 2
            assert got == (-size if n < 0 else size) / scale


def test_cents_are_exact_and_refuse_other_types(spark):
    df = spark.sql("SELECT CAST(19.99 AS DECIMAL(10,2)) AS p, 19.99D AS d, 1.2345 AS s")
    assert rows(df.select(in_cents(df, "p"))) == [(1999,)]
    for column in ("d", "s"):
        with pytest.raises(TypeError):
            in_cents(df, column)


def test_quarters_between_crosses_years(spark):
    df = spark.sql("SELECT DATE '2022-10-01' AS a, DATE '2023-04-01' AS b")
    assert rows(df.select(quarters_between(F.col("a"), F.col("b")))) == [(2,)]


def test_first_match_wins(spark):
    label = first_match([(F.col("id") < 1, "a"), (F.col("id") < 2, "b")], "c")
    assert rows(spark.range(3).select(label)) == [("a",), ("b",), ("c",)]


@pytest.fixture()
def separate_partitions(spark):
    """Small as they are, shuffle partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_positions_equal_row_number_with_a_hot_group_and_ties(
    spark, separate_partitions, threshold
):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # group 0 holds most rows and half of all rows share one value
    df = spark.range(0, 5000, 1, 7).select(
        F.when(F.col("id") % 5 < 3, 0).otherwise(F.nullif(F.col("id") % 11, F.lit(4))).alias("g"),
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.hash("id") % 50).alias("v"),
        F.col("id").cast("string").alias("k"),
    )
    window = Window.partitionBy("g")
    expected = df.select(
        "g",
        "v",
        "k",
        F.row_number().over(window.orderBy("v", "k")).cast("bigint"),
        F.count(F.lit(1)).over(window),
    )
    placed = with_position(df, "g", ["v", "k"])
    assert placed.columns == ["g", "v", "k", "position", "group_size"]
    assert len(placed.inputFiles()) > 4  # the hot group spans several
    found = rows(placed)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(found, key=repr) == sorted(rows(expected), key=repr)


@pytest.mark.parametrize("size", [1, 2, 4, 5, 6, 13, 20, 101])
@pytest.mark.parametrize("buckets", [1, 3, 5, 7])
def test_ntile_of_equals_ntile(spark, size, buckets):
    df = spark.range(1, size + 1).select(F.col("id").alias("position"))
    both = df.select(
        ntile_of(F.col("position"), F.lit(size), buckets),
        F.ntile(buckets).over(Window.orderBy("position")).cast("bigint"),
    )
    assert all(ours == theirs for ours, theirs in rows(both))


@pytest.mark.parametrize("bits", [63, 40, 30])
def test_middle_values_equal_sorted_middles(spark, bits):
    draw = random.Random(bits)
    top = (1 << bits) - 1
    groups = {
        "one": [5],
        "two": [-7, 12],
        "edges": [-top - 1, top, 0],
        "ties": [3] * 1000 + [4] * 1000,
        "hot": [draw.randint(0, 1 << 29) for _ in range(4001)],
        "wide": [draw.randint(-top, top) for _ in range(500)],
        "near": [(1 << (bits - 1)) + draw.randint(0, 300) for _ in range(501)],
        None: [None, 1, 2, 2],
    }
    values = [(g, v) for g, own in groups.items() for v in own] + [("empty", None)]
    df = spark.createDataFrame(values, "g string, v long").repartition(5)
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    expected = {}
    for g, own in groups.items():
        known = sorted(v for v in own if v is not None)
        expected[g] = (known[(len(known) - 1) // 2], known[len(known) // 2])
    found = {r.g: (r.low, r.high) for r in middle_values(counts, "g", "v", "n", bits).collect()}
    assert found == expected


def test_settings_grow_with_the_input_up_to_what_a_driver_tracks():
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    small, large = scale_settings(1 << 20, 8), scale_settings(100 << 40, 8000)
    middle = scale_settings(1 << 40, 64)
    assert (small[key], middle[key], large[key]) == ("16", "4096", "50000")
    assert small["spark.sql.files.maxPartitionBytes"] == "128m"
    assert large["spark.sql.files.maxPartitionBytes"] == "525m"
