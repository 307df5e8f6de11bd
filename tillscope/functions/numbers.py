"""Numeric conventions shared by every report.

Prices are DECIMAL with two places, so amounts are added up as whole cents in
BIGINT: exact, narrower in a shuffle than the DECIMAL(31,2) of a sum, and an
overflow raises. Ratios are taken of whole numbers, rounded half up in whole numbers, and
give NULL for a zero divisor. Reports publish amounts and ratios as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_cents(df: DataFrame, price: str) -> Column:
    """A price column in whole cents; refuses a type that cents cannot hold."""
    kind = df.schema[price].dataType
    if not (isinstance(kind, T.DecimalType) and kind.scale <= 2):
        raise TypeError(f"{price} is {kind.simpleString()}, not a DECIMAL of at most 2 places")
    return (F.col(price) * 100).cast("bigint")


def dollars(cents: Column | str) -> Column:
    return (F.col(cents) if isinstance(cents, str) else cents) / 100


#: wide enough for a product of two BIGINTs
_WHOLE = "decimal(38,0)"


def whole(value: Column) -> Column:
    """A whole number that may grow beyond BIGINT within an expression."""
    return value.cast(_WHOLE)


def half_up(numerator: Column, denominator: Column) -> Column:
    """The quotient of two whole numbers as BIGINT, halves away from zero.

    Taken in whole numbers, so no quotient is rounded twice: 12.349999996 is not a tie of
    12.3 and 12.4, and 1.005 is one of 1.00 and 1.01.
    """
    above, below = F.abs(whole(numerator)), F.abs(whole(denominator))
    size = F.call_function("div", above * 2 + below, F.nullif(below * 2, F.lit(0)))
    return F.when((numerator < 0) != (denominator < 0), -size).otherwise(size)


def rounded_ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """The quotient of two whole numbers as DOUBLE, rounded half up to ``digits``."""
    scale = 10**digits
    return half_up(whole(numerator) * scale, denominator).cast("double") / scale


def dollar_ratio(cents: Column, denominator: Column, digits: int = 2) -> Column:
    """Dollars for each of ``denominator``, from whole cents."""
    return rounded_ratio(cents, whole(denominator) * 100, digits)


def percent(numerator: Column, denominator: Column, digits: int = 1) -> Column:
    return rounded_ratio(whole(numerator) * 100, denominator, digits)
