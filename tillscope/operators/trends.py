"""Reports over time: month on month, quarter by channel, rolling mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope.fixed_values import BELOW_TREND, CANCELLED, ON_TREND, ROLLING_ROWS
from tillscope.functions.calendar import quarter_start
from tillscope.functions.numbers import dollar_ratio, dollars, percent
from tillscope.plans.facts import monthly_revenue, sold_orders
from tillscope.sources.star import Star


def monthly_revenue_yoy(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Revenue per month beside the same month of the previous year on record."""
    same_month = Window.partitionBy(F.month("month")).orderBy("month")
    monthly = monthly_revenue(star, excluded_status).withColumn(
        "same_month_prev_year", F.lag("revenue").over(same_month)
    )
    previous = F.col("same_month_prev_year")
    return monthly.select(
        "month",
        dollars("revenue").alias("revenue"),
        dollars("same_month_prev_year").alias("same_month_prev_year"),
        percent(F.col("revenue") - previous, previous).alias("yoy_growth_pct"),
    ).orderBy("month")


def channel_mix(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Per quarter and channel: sales, share of the quarter, growth in the channel.

    Orders are first added up per customer, which leaves one row for each
    customer to count instead of a DISTINCT over orders.
    """
    per_customer = (
        sold_orders(star, excluded_status)
        .groupBy(
            quarter_start(F.col("order_date")).alias("quarter"), "channel", "customer_id"
        )
        .agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )
    in_channel = Window.partitionBy("channel").orderBy("quarter")
    in_quarter = Window.partitionBy("quarter")
    mix = (
        per_customer.groupBy("quarter", "channel")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("orders").alias("orders"),
            F.count("customer_id").alias("customers"),
        )
        .withColumn("previous", F.lag("revenue").over(in_channel))
        .withColumn("quarter_revenue", F.sum("revenue").over(in_quarter))
    )
    revenue, previous = F.col("revenue"), F.col("previous")
    return mix.select(
        "quarter",
        "channel",
        dollars("revenue").alias("revenue"),
        "orders",
        "customers",
        percent(revenue, F.col("quarter_revenue")).alias("revenue_share_pct"),
        percent(revenue - previous, previous).alias("qoq_growth_pct"),
    ).orderBy("quarter", "channel")


def rolling_revenue(
    star: Star, rows: int = ROLLING_ROWS, excluded_status: str = CANCELLED
) -> DataFrame:
    """Monthly revenue against the mean of the last ``rows`` months on record.

    The window has no partition: its input is one row per month.
    """
    trailing = Window.orderBy("month").rowsBetween(1 - rows, 0)
    monthly = (
        monthly_revenue(star, excluded_status)
        .withColumn("recent", F.sum("revenue").over(trailing))
        .withColumn("months", F.count("revenue").over(trailing))
    )
    # how far the month is above the mean, times the number of months
    above = F.col("revenue") * F.col("months") - F.col("recent")
    return monthly.select(
        "month",
        dollars("revenue").alias("revenue"),
        dollar_ratio(F.col("recent"), F.col("months")).alias("rolling_3m_avg"),
        dollar_ratio(above, F.col("months")).alias("deviation_from_rolling"),
        F.when(above < 0, BELOW_TREND).otherwise(ON_TREND).alias("trend_flag"),
    ).orderBy("month")
