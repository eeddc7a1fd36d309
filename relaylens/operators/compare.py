"""Offsets of two clusters: comparison, lag, holes, gaps, resume points, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.functions.timeline import along, block_of

# Advice texts of the analysis and of the migration verdict.
GAPS_FOUND = "Found %d replication gaps that need to be resolved before safe migration"
NO_COMMITTED_OFFSETS = (
    "Consumer group has no committed offsets - replication will start from earliest/latest based on configuration"
)
COMMITTED_OFFSETS = "Consumer group offsets detected - can resume from last committed positions"
MIGRATION_UNSAFE = (
    "Migration not recommended due to detected gaps or critical issues",
    "Review offset comparison results and resolve gaps before migration",
)
MIGRATION_SAFE = ("Migration appears safe to proceed", "Monitor replication closely after migration")


def high_water_marks(records: DataFrame) -> DataFrame:
    """Last offset and high-water mark (the next offset) per topic and partition."""
    return records.groupBy("topic", "partition_id").agg(
        F.max("rec_offset").alias("last_offset"), (F.max("rec_offset") + 1).alias("high_water_mark")
    )


def compare_offsets(source: DataFrame, target: DataFrame, mapping: DataFrame) -> DataFrame:
    """Source against target per mapped topic and partition.

    A partition the target lacks has target offset -1, the whole source as its gap, and resumes at 0.
    """
    left = mapping.withColumnRenamed("topic", "source_topic").join(
        source.select(
            F.col("topic").alias("source_topic"), "partition_id", F.col("last_offset").alias("source_offset"),
            F.col("high_water_mark").alias("source_high_water_mark"),
        ),
        "source_topic",
    )
    right = target.select(
        F.col("topic").alias("target_topic"), "partition_id", F.col("last_offset").alias("t_offset"),
        F.col("high_water_mark").alias("t_hwm"),
    )
    missing = F.col("t_hwm").isNull()
    gap = F.col("source_high_water_mark") - F.coalesce("t_hwm", F.lit(0))
    return left.join(right, ["target_topic", "partition_id"], "left").select(
        "job_id", "source_topic", "target_topic", "partition_id", "source_offset",
        F.coalesce("t_offset", F.lit(-1)).alias("target_offset"),
        "source_high_water_mark",
        F.coalesce("t_hwm", F.lit(0)).alias("target_high_water_mark"),
        gap.alias("gap"),
        F.greatest(F.coalesce("t_hwm", F.lit(0)), F.lit(0)).alias("safe_resume_offset"),
        (missing | (gap > 0)).alias("has_gap"),
        missing.alias("target_missing"),
    )


def topic_comparison(comparison: DataFrame, *, lag_limit: int = 10_000) -> DataFrame:
    """Gaps and lag per mapped topic. Missing partitions are gaps but add nothing to ``total_lag``."""
    gap, missing = F.col("gap"), F.col("target_missing")
    return comparison.groupBy("job_id", "source_topic", "target_topic").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.count_if("has_gap").alias("gaps_detected"),
        F.coalesce(F.sum(F.when(~missing, gap)), F.lit(0)).alias("total_lag"),
        F.coalesce(F.sum(F.when(~missing & (gap > 0), gap)), F.lit(0)).alias("positive_lag"),
        F.count_if(missing).alias("missing_partitions"),
    ).withColumn("high_lag", F.col("total_lag") > lag_limit)


def job_comparison(mapping: DataFrame, topics: DataFrame) -> DataFrame:
    """Totals per job; mapped topics that could not be compared are critical issues."""
    return (
        mapping.select("job_id", F.col("topic").alias("source_topic"), "target_topic")
        .join(topics, ["job_id", "source_topic", "target_topic"], "left")
        .groupBy("job_id")
        .agg(
            F.count("partitions").alias("topics_compared"),
            F.coalesce(F.sum("gaps_detected"), F.lit(0)).alias("gaps_detected"),
            F.coalesce(F.sum("total_lag"), F.lit(0)).alias("total_lag"),
            F.coalesce(F.sum("positive_lag"), F.lit(0)).alias("positive_lag"),
            F.coalesce(F.sum("missing_partitions"), F.lit(0)).alias("missing_partitions"),
            F.count_if(F.col("partitions").isNull()).alias("critical_issues"),
            F.count_if(F.coalesce("high_lag", F.lit(False))).alias("warnings"),
        )
    )


def critical_issues(mapping: DataFrame, topics: DataFrame) -> DataFrame:
    """The mapped topics that could not be compared."""
    pairs = mapping.select("job_id", F.col("topic").alias("source_topic"), "target_topic")
    return pairs.join(topics, ["job_id", "source_topic", "target_topic"], "left_anti")


def mirror_analysis(jobs: DataFrame, committed: DataFrame) -> DataFrame:
    """A :func:`job_comparison` with advice; ``committed`` lists jobs whose group has committed offsets."""
    known = committed.select("job_id").distinct().withColumn("has_offsets", F.lit(True))
    advice = F.array_compact(
        F.array(
            F.when(F.col("gaps_detected") > 0, F.format_string(GAPS_FOUND, F.col("gaps_detected"))),
            F.when(F.col("has_offsets"), COMMITTED_OFFSETS).otherwise(NO_COMMITTED_OFFSETS),
        )
    )
    return jobs.join(known, "job_id", "left").select(
        "job_id", F.lit("gap_detection").alias("analysis_type"), "topics_compared", "gaps_detected",
        F.col("critical_issues").alias("critical_issues_count"), F.col("warnings").alias("warning_issues_count"),
        F.to_json(advice).alias("recommendations"),
    )


def migration_verdict(jobs: DataFrame) -> DataFrame:
    """Safe only without gaps and critical issues; risk is high with gaps, medium with warnings."""
    safe = (F.col("gaps_detected") == 0) & (F.col("critical_issues") == 0)
    risk = F.when(F.col("gaps_detected") > 0, "high").when(F.col("warnings") > 0, "medium").otherwise("low")

    def texts(lines: tuple[str, ...]) -> Column:
        return F.to_json(F.array(*[F.lit(t) for t in lines]))

    return jobs.select(
        "job_id", safe.alias("migration_safe"), risk.alias("risk_level"), "gaps_detected", "critical_issues", "warnings",
        F.when(safe, texts(MIGRATION_SAFE)).otherwise(texts(MIGRATION_UNSAFE)).alias("recommendations"),
    )


def consumer_lag(offsets: DataFrame, by: list[str]) -> DataFrame:
    """Sum of max(high-water mark - next offset to read, 0); an unread partition starts at offset 0."""
    position = F.coalesce("last_offset", F.lit(-1)) + 1
    return offsets.groupBy(*by).agg(
        F.sum(F.greatest(F.col("high_water_mark") - position, F.lit(0))).alias("lag"),
        F.count(F.lit(1)).alias("partitions"),
        F.count_if(F.col("last_offset").isNull()).alias("unread_partitions"),
    )


def mapping_lag(mapping: DataFrame, offsets: DataFrame) -> DataFrame:
    """Lag per job and mapped topic; a topic without offsets has lag 0."""
    lag = consumer_lag(offsets, ["topic"])
    return mapping.join(lag, "topic", "left").select(
        "job_id", "topic", "target_topic", F.coalesce("lag", F.lit(0)).alias("lag")
    )


def progress_rows(comparison: DataFrame, *, as_of: Column) -> DataFrame:
    """Mirror progress per partition: completed without gap, error above 10000, else active."""
    status = F.when(F.col("gap") == 0, "completed").when(F.col("gap") > 10_000, "error").otherwise("active")
    return comparison.select(
        "job_id", "source_topic", "target_topic", "partition_id", "source_offset", "target_offset",
        "source_high_water_mark", "target_high_water_mark", F.col("target_offset").alias("last_replicated_offset"),
        F.col("gap").alias("replication_lag"), as_of.alias("last_updated"), status.alias("status"),
    )


def gap_rows(comparison: DataFrame, *, as_of: Column) -> DataFrame:
    """Gaps as half-open offset ranges between the target's and the source's high-water mark."""
    return comparison.filter(F.col("has_gap") & (F.col("gap") > 0)).select(
        "job_id", "source_topic", "target_topic", "partition_id",
        F.col("target_high_water_mark").alias("gap_start_offset"),
        F.col("source_high_water_mark").alias("gap_end_offset"),
        F.col("gap").alias("gap_size"), as_of.alias("detected_at"),
        F.lit("offset_mismatch").alias("gap_type"), F.lit("unresolved").alias("resolution_status"),
    )


def resume_points(comparison: DataFrame, *, as_of: Column) -> DataFrame:
    """Safe resume offsets; all rows of one calculation share ``calculated_at``."""
    return comparison.select(
        "job_id", "source_topic", "target_topic", "partition_id", "safe_resume_offset", as_of.alias("calculated_at"),
        F.lit("pending").alias("validation_status"), (F.col("safe_resume_offset") > 0).alias("gap_detected"),
    )


def with_target_topic(resume: DataFrame, mappings: DataFrame) -> DataFrame:
    """Resume rows with the target of the first rule for that source name, or the source name itself."""
    first = mappings.groupBy("job_id", F.col("topic").alias("source_topic")).agg(
        F.min(F.struct("rule_pos", "target_topic")).alias("rule")
    )
    return resume.join(first, ["job_id", "source_topic"], "left").select(
        *resume.columns, F.coalesce("rule.target_topic", "source_topic").alias("target_topic")
    )


def offset_holes(records: DataFrame, *, block: Column | None = None) -> DataFrame:
    """Runs of missing offsets inside each partition: half-open ranges between neighbouring records.

    Copies of a record are dropped first, before the shuffle where they meet, so that a much replayed one does
    not fill its block.
    """
    stepped = along(
        records.select("topic", "partition_id", "rec_offset").distinct(), ["topic", "partition_id"], ["rec_offset"],
        block_of("rec_offset") if block is None else block, previous={"before": F.col("rec_offset")},
    )
    return stepped.filter(F.col("rec_offset") - F.col("before") > 1).select(
        "topic", "partition_id", (F.col("before") + 1).alias("gap_start_offset"),
        F.col("rec_offset").alias("gap_end_offset"), (F.col("rec_offset") - F.col("before") - 1).alias("gap_size"),
        F.lit("missing_messages").alias("gap_type"),
    )


def missing_at_target(source: DataFrame, target: DataFrame, mapping: DataFrame, *, block: int = 4096) -> DataFrame:
    """Source records of an offset-preserving mirror that the target lacks.

    Offsets are compared in blocks first: both sides count the records of a block and add up a hash of their offsets, combined before
    the shuffle. Only records of blocks that differ are compared one by one. ``block`` is the number of offsets in a block.
    """
    routes = mapping.select("topic", "target_topic").distinct()
    number = F.expr(f"CAST(rec_offset DIV {int(block)} AS BIGINT)").alias("block")
    # offsets of a mirror are unique; the sum of hashes tells apart blocks with as many records
    here = (F.count(F.lit(1)), F.sum(F.xxhash64("rec_offset").cast("decimal(38,0)")))
    in_source = source.groupBy("topic", "partition_id", number).agg(here[0].alias("n"), here[1].alias("h")).join(routes, "topic")
    in_target = target.groupBy(F.col("topic").alias("target_topic"), "partition_id", number).agg(here[0].alias("m"), here[1].alias("k"))
    keys = ["target_topic", "partition_id", "block"]
    differing = in_source.join(in_target, keys, "left").filter(~(F.col("n").eqNullSafe(F.col("m")) & F.col("h").eqNullSafe(F.col("k"))))
    open_ = differing.select("topic", *keys)
    keyed = source.select("topic", "partition_id", "rec_offset", number).join(open_, ["topic", "partition_id", "block"])
    present = target.select(F.col("topic").alias("target_topic"), "partition_id", "rec_offset", number).join(
        open_.select(*keys).distinct(), keys, "left_semi"
    )
    return keyed.join(present, ["target_topic", "partition_id", "block", "rec_offset"], "left_anti").select(
        "topic", "target_topic", "partition_id", "rec_offset"
    )


def checkpoint_snapshot(offsets: DataFrame, *, page_size: int = 1000) -> DataFrame:
    """Committed offsets and high-water marks as JSON maps from partition to offset, by topic.

    A topic's partitions come in pages of ``page_size`` ids, so a row stays bounded.
    """

    def as_map(value: Column) -> Column:
        entries = F.sort_array(F.collect_list(F.struct(F.col("partition_id"), value.alias("v"))))
        return F.to_json(F.map_from_entries(entries))

    committed = F.coalesce("last_offset", F.lit(-1)) + 1
    page = F.expr(f"CAST(partition_id DIV {int(page_size)} AS BIGINT)").alias("page")
    return offsets.groupBy("topic", page).agg(
        as_map(committed).alias("source_consumer_group_offsets"),
        as_map(F.col("high_water_mark")).alias("target_high_water_marks"),
        F.count(F.lit(1)).alias("partitions"),
    )
