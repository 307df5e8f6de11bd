"""Reports on customers: cohorts, RFM, lifetime value, loyalty, purchase gaps."""

from __future__ import annotations

from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.fixed_values import (
    CANCELLED,
    CLV_TIERS,
    COHORT_PERIODS,
    GAP_BEYOND,
    GAP_BUCKETS,
    NEW_CUSTOMER,
    RETURNING_CUSTOMER,
    RFM_AS_OF,
    RFM_BUCKETS,
    RFM_OTHERS,
    RFM_SEGMENTS,
)
from tillscope.functions.calendar import (
    days_between,
    month_start,
    quarter_start,
    quarters_between,
)
from tillscope.functions.labels import first_match
from tillscope.functions.numbers import dollar_ratio, dollars, percent, rounded_ratio
from tillscope.functions.ordering import ntile_of, with_position
from tillscope.functions.selection import middle_values
from tillscope.plans.facts import customer_totals, kept_orders, order_facts
from tillscope.plans.session import stored
from tillscope.sources.star import Star


def cohort_retention(
    star: Star, max_periods: int = COHORT_PERIODS, excluded_status: str = CANCELLED
) -> DataFrame:
    """Per quarter of first purchase: who was active how many quarters later.

    The window over a customer sees one row per active quarter. A cohort's
    size is its number of customers active in quarter 0, which is all of them.
    """
    active = (
        kept_orders(star, excluded_status)
        .select("customer_id", quarter_start(F.col("order_date")).alias("quarter"))
        .distinct()
    )
    cohort = F.min("quarter").over(Window.partitionBy("customer_id"))
    counted = (
        active.withColumn("cohort_quarter", cohort)
        .withColumn(
            "quarters_since_first", quarters_between(F.col("cohort_quarter"), F.col("quarter"))
        )
        .filter(F.col("quarters_since_first") <= max_periods)
        .groupBy("cohort_quarter", "quarters_since_first")
        .agg(F.count("customer_id").alias("active_customers"))
    )
    founders = F.when(F.col("quarters_since_first") == 0, F.col("active_customers"))
    return (
        counted.withColumn(
            "cohort_size", F.max(founders).over(Window.partitionBy("cohort_quarter"))
        )
        .select(
            "cohort_quarter",
            "cohort_size",
            "quarters_since_first",
            "active_customers",
            percent(F.col("active_customers"), F.col("cohort_size")).alias("retention_pct"),
        )
        .orderBy("cohort_quarter", "quarters_since_first")
    )


def _between(score: str, bounds: tuple[int | None, int | None]) -> list[Column]:
    low, high = bounds
    at_least = [] if low is None else [F.col(score) >= low]
    at_most = [] if high is None else [F.col(score) <= high]
    return at_least + at_most


def _rfm_segment() -> Column:
    rules = []
    for name, recency, frequency, monetary in RFM_SEGMENTS:
        tests = (
            _between("r_score", recency)
            + _between("f_score", frequency)
            + _between("m_score", monetary)
        )
        rules.append((reduce(and_, tests), name))
    return first_match(rules, RFM_OTHERS)


def _rfm_scores(
    star: Star,
    as_of: date,
    buckets: int,
    excluded_status: str,
) -> DataFrame:
    """Measures (monetary in cents), scores and segment per customer.

    The three NTILEs rank all customers. Instead of three windows in one task,
    the measures are stacked as (measure, value, customer) and ranked by one
    distributed sort. Equal values are ordered by ``customer_id``.
    """
    base = customer_totals(star, excluded_status).select(
        "customer_id",
        days_between(F.col("last_order"), F.lit(as_of)).alias("recency_days"),
        F.col("orders").alias("frequency"),
        F.col("revenue").alias("monetary"),
    )
    # the most recent customers come last, in the highest bucket
    measures = {
        "r": -F.col("recency_days"),
        "f": F.col("frequency"),
        "m": F.col("monetary"),
    }
    stacked = base.select(
        "customer_id",
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(name).alias("measure"), value.alias("value"))
                    for name, value in measures.items()
                )
            )
        ),
    )
    ranked = with_position(stacked, "measure", ["value", "customer_id"]).withColumn(
        "score", ntile_of(F.col("position"), F.col("group_size"), buckets)
    )

    def of(measure: str, column: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col(column)))

    scores = ranked.groupBy("customer_id").agg(
        (-of("r", "value")).alias("recency_days"),
        of("f", "value").alias("frequency"),
        of("m", "value").alias("monetary"),
        of("r", "score").alias("r_score"),
        of("f", "score").alias("f_score"),
        of("m", "score").alias("m_score"),
    )
    combined = F.col("r_score") * 100 + F.col("f_score") * 10 + F.col("m_score")
    return scores.withColumn("rfm_combined", combined).withColumn("rfm_segment", _rfm_segment())


def rfm_customers(
    star: Star,
    as_of: date = RFM_AS_OF,
    buckets: int = RFM_BUCKETS,
    excluded_status: str = CANCELLED,
) -> DataFrame:
    """Recency, frequency and monetary scores and the segment of every customer."""
    scores = _rfm_scores(star, as_of, buckets, excluded_status)
    return scores.withColumn("monetary", dollars("monetary"))


def rfm_segmentation(
    star: Star,
    as_of: date = RFM_AS_OF,
    buckets: int = RFM_BUCKETS,
    excluded_status: str = CANCELLED,
) -> DataFrame:
    """Size, mean behaviour and revenue share of each RFM segment."""
    segments = (
        _rfm_scores(star, as_of, buckets, excluded_status)
        .groupBy("rfm_segment")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("recency_days").alias("recency_days"),
            F.sum("frequency").alias("frequency"),
            F.sum("monetary").alias("monetary"),
        )
        .withColumn("everyone", F.sum("monetary").over(Window.partitionBy()))
    )
    customers = F.col("customer_count")
    return segments.select(
        "rfm_segment",
        "customer_count",
        rounded_ratio(F.col("recency_days"), customers, 0).alias("avg_recency_days"),
        rounded_ratio(F.col("frequency"), customers, 1).alias("avg_frequency"),
        dollar_ratio(F.col("monetary"), customers).alias("avg_monetary"),
        dollars("monetary").alias("total_revenue"),
        percent(F.col("monetary"), F.col("everyone")).alias("revenue_share_pct"),
    ).orderBy(F.desc("total_revenue"), "rfm_segment")


def _lifetime_values(star: Star, excluded_status: str) -> DataFrame:
    profile = star.customers.select("customer_id", "customer_segment", "state")
    return (
        customer_totals(star, excluded_status)
        .join(profile, "customer_id")
        .select(
            "customer_id",
            "customer_segment",
            "state",
            "first_order",
            "last_order",
            days_between(F.col("first_order"), F.col("last_order")).alias("tenure_days"),
            F.col("orders").alias("lifetime_orders"),
            F.col("revenue").alias("lifetime_revenue"),
            dollar_ratio(F.col("revenue"), F.col("lines")).alias("avg_item_spend"),
        )
    )


def clv_customers(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Lifetime value and tenure of every customer."""
    return _lifetime_values(star, excluded_status).withColumn(
        "lifetime_revenue", dollars("lifetime_revenue")
    )


def clv_distribution(
    star: Star,
    tiers: tuple[float, float, float] = CLV_TIERS,
    excluded_status: str = CANCELLED,
) -> DataFrame:
    """Lifetime value per customer segment: mean, exact median, four tiers.

    Tiers include both of their edges, so a value on an edge counts twice. Customers are
    counted per segment and value, and these counts written when the plan is built, so that
    the lines are read once; the report is added up from them, and the median selected digit
    by digit.
    """
    low, middle, high = (round(edge * 100) for edge in tiers)
    value, times = F.col("lifetime_revenue"), F.col("customers")
    values = stored(
        _lifetime_values(star, excluded_status)
        .groupBy("customer_segment", "lifetime_revenue")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            F.sum("lifetime_orders").alias("orders"),
            F.sum("tenure_days").alias("tenure"),
        ),
        "lifetime-values",
    )

    def with_value(test: Column) -> Column:
        return F.sum(F.when(test, times).otherwise(0))

    most = values.agg(F.max(F.abs("lifetime_revenue"))).first()[0] or 0
    middles = middle_values(
        values, "customer_segment", "lifetime_revenue", "customers", most.bit_length()
    )
    middles = middles.withColumnRenamed("customer_segment", "own_segment")
    per_segment = (
        values.groupBy("customer_segment")
        .agg(
            F.sum("customers").alias("customers"),
            F.sum(value * times).alias("revenue"),
            F.sum("orders").alias("orders"),
            F.sum("tenure").alias("tenure"),
            with_value(value < low).alias("clv_under_50"),
            with_value(value.between(low, middle)).alias("clv_50_200"),
            with_value(value.between(middle, high)).alias("clv_200_500"),
            with_value(value > high).alias("clv_over_500"),
        )
        .join(middles, F.col("customer_segment").eqNullSafe(F.col("own_segment")), "left")
        .withColumn("central_sum", F.col("low") + F.col("high"))
    )
    customers = F.col("customers")
    return per_segment.select(
        "customer_segment",
        "customers",
        dollar_ratio(F.col("revenue"), customers).alias("avg_clv"),
        dollar_ratio(F.col("central_sum"), F.lit(2)).alias("median_clv"),
        rounded_ratio(F.col("orders"), customers, 1).alias("avg_orders"),
        rounded_ratio(F.col("tenure"), customers, 0).alias("avg_tenure_days"),
        "clv_under_50",
        "clv_50_200",
        "clv_200_500",
        "clv_over_500",
    ).orderBy(F.desc("avg_clv"), "customer_segment")


def new_vs_returning(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """Per month: revenue of first-day orders and of all later ones.

    An order without lines can be a customer's first, so these are kept until
    the first day is known. The window over a customer sees one row per day.
    """
    days = (
        order_facts(star, excluded_status)
        .groupBy("customer_id", "order_date")
        .agg(F.count("line_count").alias("orders"), F.sum("revenue").alias("revenue"))
    )
    first_day = F.min("order_date").over(Window.partitionBy("customer_id"))
    kind = F.when(F.col("order_date") == F.col("first_day"), NEW_CUSTOMER).otherwise(
        RETURNING_CUSTOMER
    )
    months = (
        days.withColumn("first_day", first_day)
        .filter(F.col("orders") > 0)
        .groupBy(month_start(F.col("order_date")).alias("month"), kind.alias("customer_type"))
        .agg(F.sum("orders").alias("orders"), F.sum("revenue").alias("revenue"))
        .withColumn("month_revenue", F.sum("revenue").over(Window.partitionBy("month")))
    )
    return months.select(
        "month",
        "customer_type",
        "orders",
        dollars("revenue").alias("revenue"),
        percent(F.col("revenue"), F.col("month_revenue")).alias("revenue_share_pct"),
    ).orderBy("month", "customer_type")


#: numbers of one row while the orders of a day are written out
_CHUNK = 256


def _order_days(star: Star, excluded_status: str) -> DataFrame:
    """Days on which a customer ordered, with the days until the next one.

    Orders of a day are counted before the window, which therefore sees one
    row per calendar day and customer however many orders there are.
    """
    in_order = Window.partitionBy("customer_id").orderBy("order_date")
    return (
        kept_orders(star, excluded_status)
        .groupBy("customer_id", "order_date")
        .agg(F.count(F.lit(1)).alias("orders"))
        .withColumn(
            "next_gap", days_between(F.col("order_date"), F.lead("order_date").over(in_order))
        )
    )


def customer_gaps(star: Star, excluded_status: str = CANCELLED) -> DataFrame:
    """One row per order that has a successor: its number and the days until then.

    Orders of one day follow each other after 0 days; the last of them is
    followed by the customer's next day.
    """
    earlier = (
        Window.partitionBy("customer_id")
        .orderBy("order_date")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    days = _order_days(star, excluded_status).withColumn(
        "before", F.coalesce(F.sum("orders").over(earlier), F.lit(0))
    )
    # a day with many orders is cut into ranges of numbers, which are dealt over all tasks
    # before they are written out; other days stay where they are
    few = days.where(F.col("orders") <= _CHUNK).withColumn("chunk", F.lit(1).cast("bigint"))
    tasks = int(days.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = (
        days.where(F.col("orders") > _CHUNK)
        .withColumn(
            "chunk",
            F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("orders"), F.lit(_CHUNK).cast("bigint"))),
        )
        .repartition(tasks)
    )
    last = F.least(F.col("chunk") + _CHUNK - 1, F.col("orders"))
    return (
        few.unionByName(many)
        .withColumn("nth", F.explode(F.sequence(F.col("chunk"), last)))
        .select(
            "customer_id",
            (F.col("before") + F.col("nth")).alias("purchase_seq"),
            F.when(F.col("nth") < F.col("orders"), F.lit(0).cast("bigint"))
            .otherwise(F.col("next_gap"))
            .alias("days_to_next_order"),
        )
        .filter(F.col("days_to_next_order").isNotNull())
    )


def purchase_gap(
    star: Star,
    buckets: tuple[tuple[int, str], ...] = GAP_BUCKETS,
    beyond: str = GAP_BEYOND,
    excluded_status: str = CANCELLED,
) -> DataFrame:
    """How many days pass between consecutive orders of a customer.

    Gaps are counted per length before anything else, so mean and exact
    median come from a histogram with one entry per number of days.
    """
    gap, times = F.col("gap"), F.col("times")
    same_day = F.struct(
        F.lit(0).cast("bigint").alias("gap"), (F.col("orders") - 1).alias("times")
    )
    next_day = F.struct(F.col("next_gap").alias("gap"), F.lit(1).cast("bigint").alias("times"))
    histogram = (
        _order_days(star, excluded_status)
        .select(F.inline(F.array(same_day, next_day)))
        .filter(gap.isNotNull() & (times > 0))
        .groupBy("gap")
        .agg(F.sum("times").alias("times"))
    )
    bucket = first_match([(gap <= edge, name) for edge, name in buckets], beyond)
    report = histogram.groupBy(bucket.alias("gap_bucket")).agg(
        F.sum("times").alias("occurrences"),
        F.sum(gap * times).alias("days"),
        F.percentile("gap", 0.5, times).alias("median"),
        F.min("gap").alias("shortest"),
    )
    return report.orderBy("shortest").select(
        "gap_bucket",
        "occurrences",
        rounded_ratio(F.col("days"), F.col("occurrences"), 1).alias("avg_gap_days"),
        rounded_ratio((F.col("median") * 2).cast("bigint"), F.lit(2), 1).alias("median_gap_days"),
    )
