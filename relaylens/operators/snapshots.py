"""Whole inventory snapshots: clusters, topics, partitions, consumer groups, their offsets, and connections, in bounded pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.functions.json_columns import int_array

# What each section's items show, in this order.
SNAPSHOT = ("snapshot_id", "job_id", "snapshot_type", "created_at")
CLUSTER = ("cluster_inventory_id", "cluster_type", "cluster_name", "provider", "brokers", "broker_count", "total_topics", "controller_id", "cluster_id")
TOPIC = ("topic_inventory_id", "topic_name", "partition_count", "replication_factor", "is_internal", "config_data")
PARTITION = ("partition_id", "leader_id", "replica_ids", "isr_ids", "high_water_mark")
GROUP = ("group_inventory_id", "group_id", "group_state", "protocol_type", "protocol", "member_count")
OFFSET = ("topic_name", "partition_id", "current_offset", "high_water_mark", "lag")
CONNECTION = (
    "connection_type", "provider", "brokers", "security_protocol", "sasl_mechanism", "api_key_prefix", "connection_successful", "connection_time_ms",
    "error_message",
)


def _paged(rows: DataFrame, parent: str, number: str, fields: Sequence[str], order: Sequence[str], size: int, sums: dict[str, Column]) -> DataFrame:
    """(parent_id, page, n_items, items, *sums): the items of a parent whose ``number`` lies in the same ``size`` numbers, as JSON."""
    item = F.struct(F.struct(*order).alias("at"), F.struct(*fields).alias("item"))
    items = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"])
    return rows.groupBy(F.col(parent).cast("long").alias("parent_id"), F.expr(f"CAST({number} DIV {int(size)} AS BIGINT)").alias("page")).agg(
        F.count(F.lit(1)).alias("n_items"), F.to_json(items, {"ignoreNullFields": "false"}).alias("items"), *[v.alias(k) for k, v in sums.items()]
    )


def _rolled(pages: DataFrame, parent: str, count: str, sums: Sequence[str]) -> DataFrame:
    """One row per parent: how many items its pages hold, and their sums."""
    return pages.groupBy(F.col("parent_id").alias(parent)).agg(F.sum("n_items").alias(count), *[F.sum(s).alias(s) for s in sums])


def inventory_sections(
    snapshots: DataFrame, clusters: DataFrame, topics: DataFrame, partitions: DataFrame, groups: DataFrame, offsets: DataFrame,
    connections: DataFrame, *, page_size: int = 1000,
) -> DataFrame:
    """Every snapshot with all its sections, as pages ``(section, parent_id, page, n_items, items)``.

    Built from the bottom up: partitions are nested per topic, topics (each with the number of its partitions, of those under-replicated, and
    the sum of their high-water marks) per cluster, clusters, consumer groups (with partitions and lag) and connections per snapshot.
    A page holds the items whose id (partitions: partition number) lies in the same ``page_size`` numbers, so no row and no task holds more
    however large a topic or cluster is. Totals of a level are summed from the pages below it. ``parent_id`` is the id of what an item belongs
    to; the snapshot itself is its one page of section ``snapshot``. Rows whose parent is missing belong to no snapshot and
    are left out; a parent without items has no page.
    """
    def counted(rows: DataFrame, below: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
        return rows.join(below, key, "left").na.fill(0, list(names))

    in_sync, wanted = F.greatest(F.coalesce(F.size(int_array("isr_ids")), F.lit(0)), F.lit(0)), F.size(int_array("replica_ids"))
    tally = ("partitions", "under_replicated", "high_water_marks")
    partition_pages = _paged(partitions, "topic_inventory_id", "partition_id", PARTITION, ("partition_id",), page_size, {
        "under_replicated": F.count_if(in_sync < wanted), "high_water_marks": F.sum("high_water_mark"),
    })
    per_topic = _rolled(partition_pages, "topic_inventory_id", "partitions", tally[1:])
    with_partitions = counted(topics, per_topic, "topic_inventory_id", tally)
    topic_pages = _paged(
        with_partitions, "cluster_inventory_id", "topic_inventory_id", (*TOPIC, *tally), ("topic_name", "topic_inventory_id"), page_size,
        {s: F.sum(s) for s in tally},
    )
    per_cluster = _rolled(topic_pages, "cluster_inventory_id", "topics", tally)
    with_topics = counted(clusters, per_cluster, "cluster_inventory_id", ("topics", *tally))
    cluster_pages = _paged(
        with_topics, "snapshot_id", "cluster_inventory_id", (*CLUSTER, "topics", *tally), ("cluster_type", "cluster_inventory_id"), page_size,
        {s: F.sum(s) for s in ("topics", "partitions")},
    )
    offset_pages = _paged(
        offsets, "group_inventory_id", "offset_inventory_id", OFFSET, ("topic_name", "partition_id", "offset_inventory_id"), page_size, {"total_lag": F.sum("lag")}
    )
    per_group = _rolled(offset_pages, "group_inventory_id", "offsets", ("total_lag",))
    with_offsets = counted(groups, per_group, "group_inventory_id", ("offsets", "total_lag"))
    group_pages = _paged(
        with_offsets, "snapshot_id", "group_inventory_id", (*GROUP, "offsets", "total_lag"), ("group_id", "group_inventory_id"), page_size,
        {"offsets": F.sum("offsets")},
    )
    connection_pages = _paged(
        connections, "snapshot_id", "connection_inventory_id", CONNECTION, ("connection_type", "connection_inventory_id"), page_size, {}
    )

    totals = snapshots.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    for pages, count, sums in (
        (cluster_pages, "clusters", ("topics", "partitions")), (group_pages, "groups", ("offsets",)), (connection_pages, "connections", ()),
    ):
        totals = counted(totals, _rolled(pages, "snapshot_id", count, sums), "snapshot_id", (count, *sums))
    snapshot_pages = totals.select(
        F.col("snapshot_id").cast("long").alias("parent_id"), F.lit(0).cast("long").alias("page"), F.lit(1).cast("long").alias("n_items"),
        F.to_json(F.array(F.struct(*SNAPSHOT, "clusters", "topics", "partitions", "groups", "offsets", "connections")), {"ignoreNullFields": "false"}).alias("items"),
    )

    of_cluster = clusters.select("cluster_inventory_id", "snapshot_id", "cluster_type")
    of_topic = topics.select("topic_inventory_id", "cluster_inventory_id").join(of_cluster, "cluster_inventory_id")
    of_group = groups.select("group_inventory_id", "snapshot_id")
    none = F.lit(None).cast("string").alias("cluster_type")

    def section(name: str, pages: DataFrame, parents: DataFrame | None, key: str) -> DataFrame:
        placed = pages.withColumn("snapshot_id", F.col("parent_id")) if parents is None else pages.join(parents, F.col("parent_id") == parents[key])
        kind = "cluster_type" if "cluster_type" in placed.columns else none
        return placed.select(F.col("snapshot_id"), kind, F.lit(name).alias("section"), "parent_id", "page", "n_items", "items")

    every = section("snapshot", snapshot_pages, None, "snapshot_id")
    for name, pages, parents, key in (
        ("clusters", cluster_pages, None, "snapshot_id"), ("topics", topic_pages, of_cluster, "cluster_inventory_id"),
        ("partitions", partition_pages, of_topic, "topic_inventory_id"), ("consumer_groups", group_pages, None, "snapshot_id"),
        ("consumer_offsets", offset_pages, of_group, "group_inventory_id"), ("connections", connection_pages, None, "snapshot_id"),
    ):
        every = every.unionByName(section(name, pages, parents, key))
    of_job = snapshots.select("snapshot_id", "job_id", "snapshot_type")
    return of_job.join(every, "snapshot_id").select("snapshot_id", "job_id", "snapshot_type", "cluster_type", "section", "parent_id", "page", "n_items", "items")


def section_items(sections: DataFrame, section: str, schema: str) -> DataFrame:
    """The items of one section of :func:`inventory_sections` as rows; ``schema`` names the fields to read, as DDL."""
    rows = sections.filter(F.col("section") == section).select("snapshot_id", "cluster_type", "parent_id", F.explode(F.from_json("items", f"array<struct<{schema}>>")).alias("i"))
    return rows.select("snapshot_id", "cluster_type", "parent_id", "i.*")
