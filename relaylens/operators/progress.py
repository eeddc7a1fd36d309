"""Stored mirror state: newest rows per key, latest sets, period reads, ordered listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTITION_KEY = ("job_id", "source_topic", "partition_id")


def newest_by_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the newest by ``order``; combined before the shuffle, so hot keys stay cheap."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    return rows.groupBy(*keys).agg(newest.alias("row")).select(*keys, "row.*").select(*rows.columns)


def latest_rows(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """All rows at the newest ``at`` of their key; ties stay."""
    newest = rows.groupBy(*keys).agg(F.max(at).alias(at))
    return rows.join(newest, [*keys, at], "left_semi").select(*rows.columns)


def current_progress(history: DataFrame, *, at: str = "last_updated") -> DataFrame:
    """Newest progress row per job, topic and partition."""
    return newest_by_key(history, PARTITION_KEY, [at])


def calendar_period(period: str, as_of: Column) -> tuple[Column, Column]:
    """Half-open bounds of today, yesterday, this-week or last-week (Monday first); anything else is today.

    Today and this week end just after ``as_of``.
    """
    day, week = F.date_trunc("day", as_of), F.date_trunc("week", as_of)
    just_after = as_of + F.expr("INTERVAL 1 MICROSECOND")
    if period == "yesterday":
        return day - F.expr("INTERVAL 1 DAY"), day
    if period == "this-week":
        return week, just_after
    if period == "last-week":
        return week - F.expr("INTERVAL 7 DAYS"), week
    return day, just_after


def in_calendar_period(rows: DataFrame, at: str, period: str, *, as_of: Column) -> DataFrame:
    """Rows of a calendar period, newest first."""
    start, end = calendar_period(period, as_of)
    moment = F.col(at).cast("timestamp")
    return rows.filter((moment >= start.cast("timestamp")) & (moment < end.cast("timestamp"))).orderBy(F.col(at).desc())


def progress_listing(progress: DataFrame, *, topic: str | None = None) -> DataFrame:
    """Progress by topic and partition, or of one topic only."""
    rows = progress if topic is None else progress.filter(F.col("source_topic") == topic)
    return rows.orderBy("source_topic", "partition_id")


def newest_first(rows: DataFrame, at: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """Rows newest first, optionally only the first ``limit``."""
    ordered = rows.orderBy(*[F.col(c).desc() for c in at])
    return ordered if limit is None else ordered.limit(limit)


def unresolved_gaps(gaps: DataFrame) -> DataFrame:
    """Open gaps, newest first."""
    return newest_first(gaps.filter(F.col("resolution_status") == "unresolved"), ["detected_at"])


def latest_checkpoint(checkpoints: DataFrame, *, at: str = "created_at") -> DataFrame:
    """The newest migration checkpoint of each job."""
    return newest_by_key(checkpoints, ["job_id"], [at])


def mirror_state(progress: DataFrame, resume: DataFrame, gaps: DataFrame, analyses: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """The state of every job as rows ``(job_id, section, source_topic, partition_id, at, value)``.

    Sections: ``progress`` (newest target offset of each partition), ``resume`` (safe offsets of the last calculation), ``gap`` (sizes of
    the open ones), ``analysis`` (gaps the last one found) and ``checkpoint`` (offsets the last one committed). A job
    without rows of a kind has none in that section.
    """
    last = resume.groupBy("job_id").agg(F.max("calculated_at").alias("calculated_at"))

    def rows(df: DataFrame, section: str, at: str, value: str, by_partition: bool = True) -> DataFrame:
        topic, partition = (F.col("source_topic"), F.col("partition_id")) if by_partition else (F.lit(None), F.lit(None))
        return df.select(
            "job_id", F.lit(section).alias("section"), topic.cast("string").alias("source_topic"), partition.cast("int").alias("partition_id"),
            F.col(at).alias("at"), F.col(value).cast("long").alias("value"),
        )

    return (
        rows(current_progress(progress), "progress", "last_updated", "target_high_water_mark")
        .unionByName(rows(resume.join(last, ["job_id", "calculated_at"], "left_semi"), "resume", "calculated_at", "safe_resume_offset"))
        .unionByName(rows(gaps.filter(F.col("resolution_status") == "unresolved"), "gap", "detected_at", "gap_size"))
        .unionByName(rows(newest_by_key(analyses, ["job_id"], ["analyzed_at"]), "analysis", "analyzed_at", "gaps", False))
        .unionByName(rows(latest_checkpoint(checkpoints), "checkpoint", "created_at", "committed", False))
    )
