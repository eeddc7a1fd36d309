"""Guarded division: the operators run in ANSI mode, where ``/ 0`` raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, total: Column) -> Column:
    """100 * part / total as a double; null when total is 0."""
    return F.try_divide(part.cast("double") * 100, total.cast("double"))


def error_rate_over(errors: Column, messages: Column, limit: float) -> Column:
    """Error percentage above ``limit``; errors without any message count as above it."""
    return F.when(messages == 0, errors > 0).otherwise(percent(errors, messages) > limit)


def error_rate_under(errors: Column, messages: Column, limit: float) -> Column:
    """Error percentage below ``limit``; nothing at all (0 of 0) is not below it, as 0/0 has no value."""
    return F.when(messages == 0, F.lit(False)).otherwise(percent(errors, messages) < limit)
