"""Retention, clean-up and updates, as the rows that remain or result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.functions.dated import on_days
from relaylens.operators.progress import newest_by_key

MIRROR_STATE_DAYS = 7


def retention_days(days: int) -> int:
    """Days to keep: 1 to 30; anything else means 30."""
    return days if 1 <= days <= 30 else 30


def kept_rows(rows: DataFrame, at: str, *, as_of: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; dates compare as midnight. Rows without a time are not older than anything and stay."""
    cutoff = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    return on_days(rows, at, cutoff, untimed=True).filter((F.col(at).cast("timestamp_ntz") >= cutoff) | F.col(at).isNull())


def pruned(rows: DataFrame, at: str, *, as_of: Column, days: int) -> DataFrame:
    """Metrics or events that survive the retention of ``days`` (1 to 30)."""
    return kept_rows(rows, at, as_of=as_of, days=retention_days(days))


def without_old_resolved_gaps(gaps: DataFrame, *, as_of: Column, days: int, at: str = "detected_at") -> DataFrame:
    """Gaps without resolved ones older than ``days``; gaps without a time or a status stay."""
    cutoff = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    old = (F.col(at).cast("timestamp_ntz") < cutoff) & (F.col("resolution_status") == "resolved")
    return gaps.filter(~F.coalesce(old, F.lit(False)))


def with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent survives (a cascade)."""
    return children.join(parents.select(key), key, "left_semi").select(*children.columns)


def merged(current: DataFrame, updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Current rows with updates applied: the newest row per key stays."""
    return newest_by_key(current.unionByName(updates), keys, order)


def resolve_gaps(gaps: DataFrame, resolutions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Gaps with the status, method and time of their resolution where one is given; others keep what is stored.

    ``resolutions`` has the keys, ``method`` and ``resolved_at``, one row per gap.
    """
    marked = resolutions.select(*keys, F.lit(True).alias("__given"), F.col("method").alias("__method"), F.col("resolved_at").alias("__resolved_at"))
    given = F.coalesce("__given", F.lit(False))

    def updated(new: Column, stored: str) -> Column:
        return F.when(given, new).otherwise(F.col(stored)) if stored in gaps.columns else F.when(given, new)

    rest = [c for c in gaps.columns if c not in ("resolution_status", "resolution_method", "resolved_at")]
    return gaps.join(marked, list(keys), "left").select(
        *rest,
        updated(F.lit("resolved"), "resolution_status").alias("resolution_status"),
        updated(F.col("__method"), "resolution_method").alias("resolution_method"),
        updated(F.col("__resolved_at"), "resolved_at").alias("resolved_at"),
    )


def validate_resume_points(resume: DataFrame, *, job_id: str | None = None) -> DataFrame:
    """Pending resume points of a job (or of all jobs) become validated."""
    pending = F.col("validation_status") == "pending"
    if job_id is not None:
        pending = pending & (F.col("job_id") == job_id)
    status = F.when(pending, "validated").otherwise(F.col("validation_status"))
    return resume.withColumn("validation_status", status)


def replace_recent(
    stored: DataFrame, fresh: DataFrame, *, as_of: Column, span: str = "INTERVAL 1 HOUR", at: str = "calculated_at"
) -> DataFrame:
    """Stored rows without those of the recalculated jobs from the last ``span``, plus the fresh ones. Rows without a time stay."""
    redone = fresh.select("job_id").distinct().withColumn("__redone", F.lit(True))
    recent = F.col(at).cast("timestamp_ntz") > as_of - F.expr(span)
    kept = stored.join(redone, "job_id", "left").filter(~(F.coalesce("__redone", F.lit(False)) & F.coalesce(recent, F.lit(False)))).select(*stored.columns)
    return kept.unionByName(fresh.select(*stored.columns))
