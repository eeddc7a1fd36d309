"""Insights: search, quality figures, text documents and log context for analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.functions.ratios import percent


def search(
    insights: DataFrame,
    *,
    insight_types: Sequence[str] = (),
    job_id: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Insights newest first, filtered by type and job, optionally limited."""
    rows = insights
    if insight_types:
        rows = rows.filter(F.col("insight_type").isin(*insight_types))
    if job_id is not None:
        rows = rows.filter(F.col("job_id") == job_id)
    rows = rows.orderBy(F.col("ts").desc(), F.col("id").desc())
    return rows if limit is None else rows.limit(limit)


def praised(feedback: Column) -> Column:
    """Feedback that calls an insight helpful or accurate, in any case."""
    return F.coalesce(feedback.ilike("%helpful%") | feedback.ilike("%accurate%"), F.lit(False))


def praised_insights(insights: DataFrame) -> DataFrame:
    return insights.filter(praised(F.col("user_feedback")))


def quality(insights: DataFrame) -> DataFrame:
    """Number of insights, average response time of answered ones, accuracy of resolved ones, counts by use."""
    resolved = F.col("resolution_status") == "resolved"
    right = F.coalesce(F.col("accuracy_score") >= 0.7, F.lit(False)) | praised(F.col("user_feedback"))
    answered = F.when(F.col("response_time_ms") > 0, F.col("response_time_ms"))
    return insights.agg(
        F.count(F.lit(1)).alias("total_insights"),
        F.round(F.coalesce(F.try_divide(F.sum(answered).cast("double"), F.count(answered)), F.lit(0.0)), 6).alias(
            "avg_response_time_ms"
        ),
        F.round(F.coalesce(percent(F.count_if(resolved & right), F.count_if(resolved)), F.lit(0.0)), 6).alias("accuracy_rate"),
        F.count_if(F.col("insight_type") == "anomaly").alias("anomaly_count"),
        F.count_if(F.col("insight_type").isin("optimization", "recommendation")).alias("recommendation_count"),
    )


def by_type(insights: DataFrame) -> DataFrame:
    return insights.groupBy("insight_type").agg(F.count(F.lit(1)).alias("insights"))


def statistics_documents(statistics: DataFrame) -> DataFrame:
    """One text per job from its series statistics."""
    text = F.format_string(
        "job: %s\npoints: %d\nthroughput: avg %d, range %d - %d, trend %s\nlag: avg %d, range %d - %d\nerrors: %d",
        "job_id", "points", "avg_throughput", "min_throughput", "max_throughput", "trend", "avg_lag", "min_lag",
        "max_lag", "total_errors",
    )
    return statistics.select("job_id", text.alias("document"))


def daily_documents(daily: DataFrame, *, days: int) -> DataFrame:
    """One text per job with a line per day of its rollup; a job has at most ``days`` + 1 lines."""
    line = F.format_string(
        "- %s: %d messages, lag %d, %d errors", "period", "messages_total", F.floor(F.col("avg_lag") + 0.5), "total_errors"
    )
    lines = F.sort_array(F.collect_list(line))
    return daily.groupBy("job_id").agg(
        F.concat_ws("\n", F.format_string(f"job: %s\ndays: {int(days)}", "job_id"), F.array_join(lines, "\n")).alias("document")
    )


def analysis_context(points: DataFrame, logs: DataFrame, *, minutes: int = 30, ts: str = "ts") -> DataFrame:
    """Metrics and log counts of the same job and time window side by side.

    Both sides are first aggregated per (job, window), so the join is an equi join of small rows and no
    point meets a log line.
    """

    def window_end(moment: str) -> Column:
        width = minutes * 60
        seconds = F.unix_micros(F.col(moment).cast("timestamp")) / F.lit(1_000_000)
        end = (F.floor(seconds / F.lit(width)) + 1) * width
        return F.timestamp_seconds(end).cast("timestamp_ntz")

    measured = points.groupBy("job_id", window_end(ts).alias("window_end")).agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("messages_replicated_delta").alias("messages"),
        F.max("avg_lag").alias("max_lag"),
        F.sum("error_count_delta").alias("errors"),
    )
    logged = logs.filter(F.col("job_id") != "").groupBy("job_id", window_end("ts").alias("window_end")).agg(
        F.count(F.lit(1)).alias("log_lines"),
        F.count_if(F.col("level") == "ERROR").alias("error_lines"),
        F.count_if(F.col("level") == "WARN").alias("warn_lines"),
    )
    return measured.join(logged, ["job_id", "window_end"], "left").na.fill(0, ["log_lines", "error_lines", "warn_lines"])
