"""Ratios and averages of the metric layer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """Quotient as a double; zero when the whole is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def change_rate(delta: Column, previous: Column) -> Column:
    grown = F.when(delta == 0, 0.0).otherwise(1.0)
    return F.when(previous == 0, grown).otherwise(share(delta, previous))


def fixed(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", value.cast("double"))
