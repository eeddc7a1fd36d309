"""JSON text columns of the mirroring tables, decoded and encoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_ARRAY = "array<int>"
LONG_MAP = "map<string,bigint>"
OFFSET_MAP = "map<string,map<string,bigint>>"  # JSON keys are text


def int_array(column: str) -> Column:
    """Broker ids such as ``[1,2,3]``."""
    return F.from_json(F.col(column), INT_ARRAY)


def long_map(column: str) -> Column:
    """Offsets by topic such as ``{"orders":10}``."""
    return F.from_json(F.col(column), LONG_MAP)


def offset_map(column: str) -> Column:
    """Offsets by topic and partition such as ``{"orders":{"0":10}}``."""
    return F.transform_values(
        F.from_json(F.col(column), OFFSET_MAP),
        lambda _, offsets: F.transform_keys(offsets, lambda partition, _: partition.cast("int")),
    )


def sorted_map_json(entries: Column) -> Column:
    """A map as JSON text with its keys in order."""
    return F.to_json(F.map_from_entries(F.sort_array(F.map_entries(entries))))
