"""Cluster inventories: compression, compatibility, topic health, counts, the snapshot tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.functions.json_columns import int_array

# Compression settings a topic can carry; anything else counts as none.
COMPRESSIONS = ("gzip", "snappy", "lz4", "zstd", "producer")


def compression_class(raw: Column) -> Column:
    return F.when(raw.isin(*COMPRESSIONS), raw).otherwise("NONE")


def configured_compression(config: Column) -> Column:
    """Compression of a topic from its configuration map."""
    return compression_class(F.try_element_at(config, F.lit("compression.type")))


def topic_compression(topics: DataFrame) -> DataFrame:
    return topics.withColumn("compression_type", compression_class(F.col("compression_raw"))).drop("compression_raw")


def clamped_replication_factor(factor: Column, brokers: Column) -> Column:
    """At least 1, and at most the number of target brokers when that is known."""
    asked = F.when(factor <= 0, F.lit(1)).otherwise(factor)
    return F.when(brokers <= 0, asked).otherwise(F.least(asked, brokers))


def replication_factors(topics: DataFrame, *, brokers: int) -> DataFrame:
    clamped = clamped_replication_factor(F.col("replication_factor"), F.lit(brokers))
    return topics.filter(F.col("cluster_type") == "source").select(
        "topic_name", "replication_factor", clamped.alias("target_replication_factor"),
        (clamped != F.col("replication_factor")).alias("changed"),
    )


def _pairs(topics: DataFrame) -> DataFrame:
    def side(kind: str) -> DataFrame:
        return topics.filter(F.col("cluster_type") == kind).select(
            "topic_name", F.col("partition_count").alias(f"{kind}_partitions"),
            F.col("replication_factor").alias(f"{kind}_replication_factor"),
            compression_class(F.col("compression_raw")).alias(f"{kind}_compression"),
        )

    return side("source").join(side("target"), "topic_name")


def compression_compatibility(topics: DataFrame) -> DataFrame:
    """Compression of source against target topic: matched, mismatch, enhancement or different."""
    source, target = F.col("source_compression"), F.col("target_compression")
    relation = (
        F.when(source == target, "matched")
        .when(target == "NONE", "mismatch")
        .when(source == "NONE", "enhancement")
        .otherwise("different")
    )
    return _pairs(topics).select("topic_name", source, target, relation.alias("relation"))


def topic_compatibility(topics: DataFrame) -> DataFrame:
    """Partition counts must agree; a different replication factor is only a warning."""
    same = F.col("source_partitions") == F.col("target_partitions")
    status = (
        F.when(~same, "partition_mismatch")
        .when(F.col("source_replication_factor") != F.col("target_replication_factor"), "replication_warning")
        .otherwise("compatible")
    )
    return _pairs(topics).select(
        "topic_name", "source_partitions", "target_partitions", "source_replication_factor", "target_replication_factor",
        status.alias("status"),
    )


def topic_health(requested: DataFrame, partitions: DataFrame) -> DataFrame:
    """Partitions, replication factor and under-replicated partitions of requested topics; absent ones are unhealthy."""
    replicas = F.size(int_array("replica_ids"))
    # replicas in sync that are not known count as none
    isr = F.greatest(F.coalesce(F.size(int_array("isr_ids")), F.lit(0)), F.lit(0))
    found = partitions.groupBy("topic_name").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.min_by(replicas, F.col("partition_id")).cast("long").alias("replication_factor"),
        F.count_if(isr < replicas).alias("under_replicated_partitions"),
    )
    counts = ("partitions", "replication_factor", "under_replicated_partitions")
    return (
        requested.select("topic_name").distinct().join(found, "topic_name", "left")
        .withColumn("is_healthy", F.coalesce(F.col("under_replicated_partitions") == 0, F.lit(False)))
        .na.fill(0, list(counts))
    )


def health_alerts(health: DataFrame) -> DataFrame:
    """An operational event per unhealthy topic."""
    text = F.format_string(
        "Topic %s is unhealthy. Under-replicated partitions: %d", "topic_name", "under_replicated_partitions"
    )
    return health.filter(~F.col("is_healthy")).select(
        "topic_name", F.lit("topic_health_alert").alias("event_type"), F.lit("system").alias("initiator"), text.alias("details")
    )


def cluster_counts(clusters: DataFrame, topics: DataFrame, partitions: DataFrame, brokers: DataFrame | None = None) -> DataFrame:
    """Brokers, topics, partitions and internal topics per snapshot and cluster.

    ``brokers`` lists ``(cluster_inventory_id, broker_id)``. Without it the brokers that lead a partition are counted.
    """
    per_topic = partitions.groupBy("topic_inventory_id").agg(
        F.count(F.lit(1)).alias("partitions"), F.collect_set("leader_id").alias("leaders")
    )
    per_cluster = topics.join(per_topic, "topic_inventory_id", "left").groupBy("cluster_inventory_id").agg(
        F.count(F.lit(1)).alias("total_topics"),
        F.coalesce(F.sum("partitions"), F.lit(0)).alias("total_partitions"),
        F.count_if(F.col("topic_name").startswith("__")).alias("internal_topics"),
    )
    leaders = (
        topics.select("topic_inventory_id", "cluster_inventory_id").join(per_topic, "topic_inventory_id")
        .select("cluster_inventory_id", F.explode("leaders").alias("leader"))
        .groupBy("cluster_inventory_id").agg(F.count_distinct("leader").alias("broker_count"))
    )
    if brokers is not None:
        leaders = brokers.groupBy("cluster_inventory_id").agg(F.count_distinct("broker_id").alias("broker_count"))
    counts = ["total_topics", "total_partitions", "internal_topics", "broker_count"]
    return (
        clusters.join(per_cluster, "cluster_inventory_id", "left").join(leaders, "cluster_inventory_id", "left")
        .select("snapshot_id", "cluster_name", "cluster_type", *counts).na.fill(0, counts)
    )


def inventory_tree(
    snapshots: DataFrame, clusters: DataFrame, topics: DataFrame, partitions: DataFrame, *, page_size: int = 1000
) -> DataFrame:
    """Snapshots with their clusters, topics and nested partitions.

    Partitions are nested in pages of ``page_size`` partition ids, so a row stays bounded however many
    partitions a topic has; a topic without partitions is one row with an empty page.
    """
    pages = (
        partitions.groupBy("topic_inventory_id", F.expr(f"CAST(partition_id DIV {int(page_size)} AS BIGINT)").alias("page"))
        .agg(
            F.to_json(F.sort_array(F.collect_list(F.struct("partition_id", "leader_id")))).alias("partitions"),
            F.count(F.lit(1)).alias("partitions_in_page"),
        )
    )
    return (
        snapshots.join(clusters, "snapshot_id", "left")
        .join(topics, "cluster_inventory_id", "left")
        .join(pages, "topic_inventory_id", "left")
        .select(
            "snapshot_id", "job_id", "snapshot_type", "cluster_type", "cluster_name", "topic_inventory_id", "topic_name", "page",
            "partitions", F.coalesce("partitions_in_page", F.lit(0)).alias("partitions_in_page"),
        )
    )


def snapshots_of_job(snapshots: DataFrame, *, job_id: str | None = None) -> DataFrame:
    """Snapshots newest first, of one job or of all."""
    rows = snapshots if job_id is None else snapshots.filter(F.col("job_id") == job_id)
    return rows.orderBy("job_id", F.col("created_at").desc())


def group_offsets(groups: DataFrame, offsets: DataFrame) -> DataFrame:
    """Committed offsets of every snapshot's consumer groups, with the lag of each partition."""
    current = F.coalesce("current_offset", F.lit(-1))
    return groups.join(offsets, "group_inventory_id").select(
        "snapshot_id", "group_id", "topic_name", "partition_id", current.alias("current_offset"), "high_water_mark",
        F.greatest(F.col("high_water_mark") - current - 1, F.lit(0)).alias("lag"),
    )


def group_lag(groups: DataFrame, offsets: DataFrame) -> DataFrame:
    """Partitions and total lag per snapshot and consumer group; groups without offsets have none."""
    behind = F.greatest(F.col("high_water_mark") - F.coalesce("current_offset", F.lit(-1)) - 1, F.lit(0))
    per_group = offsets.groupBy("group_inventory_id").agg(F.count(F.lit(1)).alias("partitions"), F.sum(behind).alias("lag"))
    return groups.join(per_group, "group_inventory_id", "left").select(
        "snapshot_id", "group_id", F.coalesce("partitions", F.lit(0)).alias("partitions"), F.coalesce("lag", F.lit(0)).alias("lag")
    )
