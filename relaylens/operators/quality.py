"""Data quality: duplicate keys, values outside their domain, orphans."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.schemas import COLUMN_DOMAINS, DOMAINS


def duplicate_keys(df: DataFrame, keys: Sequence[str], *, scope: Column | None = None) -> DataFrame:
    """Keys that occur more than once among the rows in scope, with how often."""
    rows = df if scope is None else df.filter(scope)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def domain_violations(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values of ``column`` outside its domain (null counts too), with their number of rows."""
    inside = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return (
        df.filter(~inside).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows_found"))
        .select(F.lit(column).alias("column_name"), "value", "rows_found")
    )


def table_violations(df: DataFrame, table: str) -> DataFrame:
    """Violations of all enumerated columns of a mirroring table that ``df`` has."""
    checks = [
        domain_violations(df, column, DOMAINS[domain]) for column, domain in COLUMN_DOMAINS[table].items() if column in df.columns
    ]
    return reduce(DataFrame.unionByName, checks)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child values without a parent row, with their number of rows; nulls refer to nothing and pass."""
    used = child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows_found"))
    known = parent.select(F.col(key).alias("value"))
    return used.join(known, "value", "left_anti").select(F.lit(column).alias("column_name"), "value", "rows_found")
