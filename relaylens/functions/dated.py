"""Partition pruning for operators over tables that are partitioned by the day of a time column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = "event_date"
DAY_OF = "day_of"  # in the metadata of the day column: the time column it is the day of


def day_of(ts: str) -> Column:
    """The day column as tables hand it out, marked with its time column."""
    return F.col(DAY).alias(DAY, metadata={DAY_OF: ts})


def on_days(rows: DataFrame, ts: str, start: Column | None = None, end: Column | None = None, *, untimed: bool = False) -> DataFrame:
    """``rows`` narrowed to the days of ``start`` to ``end``, so that only their folders are read; the times are still to be compared.

    Rows that have no day column of ``ts`` come back as they are. A day more on either side covers sessions in another time zone.
    ``untimed`` also keeps the folder of rows without a time.
    """
    marked = [f for f in rows.schema.fields if f.name == DAY and (f.metadata or {}).get(DAY_OF) == ts]
    if not marked:
        return rows
    inside = F.lit(True)
    if start is not None:
        inside = inside & (F.col(DAY) >= F.date_sub(start.cast("date"), 1))
    if end is not None:
        inside = inside & (F.col(DAY) <= F.date_add(end.cast("date"), 1))
    return rows.filter(inside | F.col(DAY).isNull()) if untimed else rows.filter(inside)
