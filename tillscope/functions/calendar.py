"""Date helpers. All results are DATE or BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def quarters_between(earlier: Column, later: Column) -> Column:
    years = F.year(later) - F.year(earlier)
    return (years * 4 + F.quarter(later) - F.quarter(earlier)).cast("bigint")


def days_between(earlier: Column, later: Column) -> Column:
    return F.date_diff(later, earlier).cast("bigint")
