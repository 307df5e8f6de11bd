"""Labels chosen by ordered rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first condition that holds."""
    label = F.lit(otherwise)
    for condition, name in reversed(rules):
        label = F.when(condition, name).otherwise(label)
    return label
