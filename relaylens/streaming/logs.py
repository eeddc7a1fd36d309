"""Log and topic metadata streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.operators.logs import parse_log_lines


def pattern_windows(lines: DataFrame, *, every: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Log entries per level, category, subcategory, job and tumbling window of a stream of lines."""
    parsed = parse_log_lines(lines).withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        parsed.withWatermark("ts", delay)
        .groupBy("level", "category", "subcategory", "job_id", F.window("ts", every))
        .agg(F.count(F.lit(1)).alias("lines"))
        .select("level", "category", "subcategory", "job_id", F.col("window.start").alias("window_start"), "lines")
    )


def health_alerts(snapshots: DataFrame) -> DataFrame:
    """Alerts from a stream of topic snapshots ``(name, partition_info)``; no state is needed.

    ``partition_info`` is an array of structs with ``replicas`` and ``isr``; a topic without any partition
    is missing.
    """
    behind = F.size(F.filter("partition_info", lambda p: F.size(p["isr"]) < F.size(p["replicas"])))
    partitions = F.coalesce(F.size("partition_info"), F.lit(0))
    text = F.format_string("Topic %s is unhealthy. Under-replicated partitions: %d", "name", F.greatest(behind, F.lit(0)))
    return snapshots.filter((partitions <= 0) | (behind > 0)).select(
        "name", F.lit("topic_health_alert").alias("event_type"), F.lit("system").alias("initiator"), text.alias("details")
    )
