"""Named queries over the mirror state of several jobs, clean-up of its tables, and inputs with odd values."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylens.operators import audit, inventory, maintenance, progress, snapshots
from relaylens.plans.bindings import as_of
from relaylens.plans.governance import TREE, inventory_tables
from relaylens.plans.registry import query

NOW = "CAST('2024-01-31 00:00:00' AS TIMESTAMP)"
JOBS = """WITH p AS (SELECT 'job-' || CAST(partition_id % 3 AS VARCHAR) AS job_id, * EXCLUDE (job_id) FROM progress),
c AS (SELECT job_id, last_updated AS created_at, count(*) AS partitions, CAST(sum(target_high_water_mark) AS BIGINT) AS committed FROM p GROUP BY ALL),
r AS (SELECT job_id, source_topic, partition_id, target_high_water_mark AS safe_resume_offset, last_updated AS calculated_at FROM p
  WHERE target_high_water_mark % 5 <> 0),
g AS (SELECT job_id, source_topic, partition_id, source_high_water_mark - target_high_water_mark AS gap_size, last_updated AS detected_at FROM p
  WHERE source_high_water_mark > target_high_water_mark AND source_high_water_mark % 2 <> 0),
a AS (SELECT job_id, last_updated AS analyzed_at, count(*) FILTER (source_high_water_mark > target_high_water_mark) AS gaps FROM p GROUP BY ALL)
"""


def _progress(v):
    return v.progress.withColumn("job_id", F.expr("concat('job-', partition_id % 3)"))


def _checkpoints(v):
    return _progress(v).groupBy("job_id", F.col("last_updated").alias("created_at")).agg(
        F.count(F.lit(1)).alias("partitions"), F.sum("target_high_water_mark").cast("long").alias("committed")
    )


def _resume(v):
    return _progress(v).filter("target_high_water_mark % 5 <> 0").selectExpr(
        "job_id", "source_topic", "partition_id", "target_high_water_mark AS safe_resume_offset", "last_updated AS calculated_at"
    )


def _gaps(v):
    return _progress(v).filter("source_high_water_mark > target_high_water_mark").selectExpr(
        "job_id", "source_topic", "partition_id", "source_high_water_mark - target_high_water_mark AS gap_size", "last_updated AS detected_at",
        "IF(source_high_water_mark % 2 = 0, 'resolved', 'unresolved') AS resolution_status",
    )


def _analyses(v):
    return _progress(v).groupBy("job_id", F.col("last_updated").alias("analyzed_at")).agg(
        F.count_if(F.col("source_high_water_mark") > F.col("target_high_water_mark")).alias("gaps")
    )


@query("latest_checkpoint", JOBS + "SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC) = 1")
def _(v):
    return progress.latest_checkpoint(_checkpoints(v))


@query("mirror_state", JOBS + """
SELECT job_id, 'progress' AS section, source_topic, partition_id, last_updated AS at, target_high_water_mark AS value FROM p
  QUALIFY row_number() OVER (PARTITION BY job_id, source_topic, partition_id ORDER BY last_updated DESC) = 1
UNION ALL SELECT job_id, 'resume', source_topic, partition_id, calculated_at, safe_resume_offset FROM r
  QUALIFY calculated_at = max(calculated_at) OVER (PARTITION BY job_id)
UNION ALL SELECT job_id, 'gap', source_topic, partition_id, detected_at, gap_size FROM g
UNION ALL SELECT job_id, 'analysis', NULL, NULL, analyzed_at, gaps FROM a QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY analyzed_at DESC) = 1
UNION ALL SELECT job_id, 'checkpoint', NULL, NULL, created_at, committed FROM c QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC) = 1
""")
def _(v):
    return progress.mirror_state(_progress(v), _resume(v), _gaps(v), _analyses(v), _checkpoints(v))


@query("retained_resume_points", JOBS + f"SELECT * FROM r WHERE calculated_at >= {NOW} - INTERVAL 7 DAYS")
def _(v):
    return maintenance.kept_rows(_resume(v), "calculated_at", as_of=as_of(), days=maintenance.MIRROR_STATE_DAYS)


@query("retained_analyses", JOBS + f"SELECT * FROM a WHERE analyzed_at >= {NOW} - INTERVAL 7 DAYS")
def _(v):
    return maintenance.kept_rows(_analyses(v), "analyzed_at", as_of=as_of(), days=maintenance.MIRROR_STATE_DAYS)


@query("retained_gaps", JOBS + f"SELECT job_id, source_topic, partition_id, gap_size, detected_at FROM g WHERE detected_at >= {NOW} - INTERVAL 7 DAYS")
def _(v):
    open_ = _gaps(v).filter("resolution_status = 'unresolved'").drop("resolution_status")
    return maintenance.kept_rows(open_, "detected_at", as_of=as_of(), days=maintenance.MIRROR_STATE_DAYS)


@query("checkpoints_after_cleanup", JOBS + f"SELECT * FROM c WHERE created_at >= {NOW} - INTERVAL 14 DAYS")
def _(v):
    return maintenance.kept_rows(_checkpoints(v), "created_at", as_of=as_of(), days=14)


@query("compression_from_config", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'gzip' WHEN 1 THEN 'producer' ELSE 'NONE' END AS compression_type FROM part""")
def _(v):
    config = F.expr(
        "CASE p_partkey % 5 WHEN 0 THEN map('compression.type', 'gzip', 'retention.ms', '1') WHEN 1 THEN map('compression.type', 'producer') "
        "WHEN 2 THEN map('compression.type', 'other') WHEN 3 THEN map('retention.ms', '1') END"
    )
    return v.table("part").select("p_partkey", inventory.configured_compression(config).alias("compression_type"))


@query("topic_health_unknown_isr", """
SELECT 't' || CAST(o_custkey % 50 AS VARCHAR) AS topic_name, count(*) AS partitions, CAST(3 AS BIGINT) AS replication_factor,
  count(*) FILTER (o_orderkey % 9 IN (0, 1, 2)) AS under_replicated_partitions, count(*) FILTER (o_orderkey % 9 IN (0, 1, 2)) = 0 AS is_healthy
FROM orders GROUP BY 1""")
def _(v):
    partitions = v.table("orders").selectExpr(
        "concat('t', o_custkey % 50) AS topic_name", "CAST(o_orderkey AS INT) AS partition_id", "'[1,2,3]' AS replica_ids",
        "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN '[]' ELSE '[1,2,3]' END AS isr_ids",
    )
    return inventory.topic_health(partitions.select("topic_name"), partitions)


_BODY = """CASE event_id % 7 WHEN 0 THEN 'not json' WHEN 1 THEN '{"name": 5, "username": ["u"], "source_cluster_name": "a"}' WHEN 2 THEN '[1]' WHEN 3 THEN ''
  WHEN 4 THEN NULL WHEN 5 THEN '{"name": "n", "provider": "p", "username": "u", "role": "r", "source_cluster_name": "a", "target_cluster_name": "b"}'
  ELSE '{}' END"""
_FIELDS = ("name", "provider", "username", "role", "source_cluster_name", "target_cluster_name")
_READ = ", ".join(f"CASE WHEN is_object AND json_type(doc, '$.{n}') = 'VARCHAR' THEN json_extract_string(doc, '$.{n}') ELSE '' END AS f_{n}" for n in _FIELDS)


@query("audit_odd_bodies", f"""
WITH q AS (SELECT event_id, event_type, {_BODY} AS body FROM events WHERE event_type IN ('view', 'click', 'signup')),
j AS (SELECT *, CASE WHEN json_valid(body) THEN body END AS doc FROM q),
t AS (SELECT *, coalesce(json_type(doc) = 'OBJECT', false) AS is_object FROM j),
f AS (SELECT *, {_READ} FROM t)
SELECT event_id, CASE event_type
  WHEN 'view' THEN CASE WHEN is_object THEN format('Created job ''{{}}'' from {{}} to {{}}', f_name, f_source_cluster_name, f_target_cluster_name)
    ELSE 'Created new replication job' END
  WHEN 'click' THEN CASE WHEN is_object THEN format('Created cluster ''{{}}'' (provider: {{}})', f_name, f_provider) ELSE 'Created new cluster' END
  ELSE CASE WHEN is_object THEN format('Created user ''{{}}'' with role ''{{}}''', f_username, f_role) ELSE 'Created new user' END END AS details FROM f""")
def _(v):
    path = F.expr("CASE event_type WHEN 'view' THEN '/api/v1/jobs' WHEN 'click' THEN '/api/v1/clusters' ELSE '/api/v1/users' END")
    requests = v.events.filter("event_type IN ('view', 'click', 'signup')").select("event_id", path.alias("path"), F.expr(_BODY).alias("body"))
    return requests.select("event_id", audit.request_details(F.col("path"), F.lit("POST"), F.col("body")).alias("details"))


@query("cluster_broker_counts", TREE + """, brokers AS (SELECT n_nationkey AS cluster_inventory_id, 3 + n_nationkey % 4 AS listed FROM nation)
SELECT snapshot_id, cluster_name, cluster_type, count(DISTINCT topic_inventory_id) AS total_topics, count(partition_id) AS total_partitions,
  count(DISTINCT topic_inventory_id) FILTER (WHERE topic_name LIKE '\\_\\_%' ESCAPE '\\') AS internal_topics, CAST(max(listed) AS BIGINT) AS broker_count
FROM inv_clusters LEFT JOIN inv_topics USING (cluster_inventory_id) LEFT JOIN inv_partitions USING (topic_inventory_id) LEFT JOIN brokers USING (cluster_inventory_id)
GROUP BY cluster_inventory_id, snapshot_id, cluster_name, cluster_type""")
def _(v):
    _, clusters, topics, partitions = inventory_tables(v)
    # more brokers than lead a partition
    brokers = v.table("nation").selectExpr("n_nationkey AS cluster_inventory_id", "explode(sequence(1, CAST(3 + n_nationkey % 4 AS INT))) AS broker_id")
    return inventory.cluster_counts(clusters, topics, partitions, brokers)


# --- whole inventory snapshots ---------------------------------------------------------------------

_CLUSTERS = """n_nationkey AS cluster_inventory_id, n_regionkey AS snapshot_id, CASE WHEN n_nationkey % 2 = 0 THEN 'source' ELSE 'target' END AS cluster_type,
  n_name AS cluster_name, CASE n_nationkey % 3 WHEN 0 THEN 'confluent' WHEN 1 THEN 'redpanda' ELSE 'plain' END AS provider,
  concat('kafka-', n_nationkey, ':9092') AS brokers, CAST(3 + n_nationkey % 4 AS INTEGER) AS broker_count, n_nationkey * 10 AS total_topics,
  CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey % 3 END AS controller_id, concat('lkc-', n_nationkey) AS cluster_id"""
_TOPICS = """c_custkey AS topic_inventory_id, c_nationkey AS cluster_inventory_id, concat(CASE WHEN c_custkey % 25 = 0 THEN '__' ELSE '' END, c_name) AS topic_name,
  c_custkey % 7 AS partition_count, CAST(1 + c_custkey % 3 AS INTEGER) AS replication_factor, c_custkey % 25 = 0 AS is_internal,
  CASE WHEN c_custkey % 4 > 0 THEN concat('{"compression.type":"', c_mktsegment, '"}') END AS config_data"""
_PARTITIONS = """o_custkey AS topic_inventory_id, o_orderkey AS partition_id, CAST(1 + o_orderkey % 3 AS INTEGER) AS leader_id, '[1,2,3]' AS replica_ids,
  CASE WHEN o_orderkey % 97 = 0 THEN '[1]' WHEN o_orderkey % 89 = 0 THEN NULL ELSE '[1,2,3]' END AS isr_ids, o_orderkey * 7 % 100003 AS high_water_mark"""
_GROUPS = """s_suppkey AS group_inventory_id, s_nationkey % 5 AS snapshot_id, s_name AS group_id,
  CASE WHEN s_suppkey % 3 = 0 THEN 'Empty' ELSE 'Stable' END AS group_state, 'consumer' AS protocol_type, CASE WHEN s_suppkey % 3 > 0 THEN 'range' END AS protocol,
  CAST(s_suppkey % 3 AS INTEGER) AS member_count"""
_CONNECTIONS = """n_nationkey AS connection_inventory_id, n_nationkey % 5 AS snapshot_id, CASE WHEN n_nationkey % 2 = 0 THEN 'source_consumer' ELSE 'target_producer' END AS connection_type,
  'confluent' AS provider, concat('kafka-', n_nationkey, ':9092') AS brokers, 'SASL_SSL' AS security_protocol, 'PLAIN' AS sasl_mechanism, substring(n_name, 1, 4) AS api_key_prefix,
  n_nationkey % 6 > 0 AS connection_successful, CASE WHEN n_nationkey % 6 > 0 THEN n_nationkey * 3 END AS connection_time_ms,
  CASE WHEN n_nationkey % 6 = 0 THEN concat('dial "', n_name, '" refused') END AS error_message"""


def _duck_item(names: tuple[str, ...]) -> str:
    return "{" + ", ".join(f"'{n}': {n}" for n in names) + "}"


def _duck_pages(source: str, parent: str, number: str, names: tuple[str, ...], order: str) -> str:
    return (
        f"SELECT {parent}::BIGINT AS parent_id, ({number} // 1000)::BIGINT AS page, count(*) AS n_items, CAST(to_json(list({_duck_item(names)} ORDER BY {order})) AS VARCHAR) AS items"
        f" FROM {source} GROUP BY 1, 2"
    )


_TALLY = ("partitions", "under_replicated", "high_water_marks")
SECTIONS = f"""
WITH s AS (SELECT r_regionkey AS snapshot_id, 'job-' || r_regionkey AS job_id,
    CASE r_regionkey % 3 WHEN 0 THEN 'startup' WHEN 1 THEN 'periodic' ELSE 'manual' END AS snapshot_type,
    strftime(TIMESTAMP '2024-01-31 00:00:00' - to_days(r_regionkey * 12), '%Y-%m-%d %H:%M:%S') AS created_at FROM region),
p AS (SELECT {_PARTITIONS} FROM orders),
t AS (SELECT {_TOPICS}, coalesce(partitions, 0) AS partitions, coalesce(under_replicated, 0) AS under_replicated, coalesce(high_water_marks, 0) AS high_water_marks
  FROM customer LEFT JOIN (SELECT topic_inventory_id AS k, count(*) AS partitions, count(*) FILTER (isr_ids IS NULL OR isr_ids = '[1]') AS under_replicated,
    sum(high_water_mark)::BIGINT AS high_water_marks FROM p GROUP BY 1) ON k = c_custkey),
k AS (SELECT {_CLUSTERS}, coalesce(topics, 0) AS topics, coalesce(partitions, 0) AS partitions, coalesce(under_replicated, 0) AS under_replicated,
    coalesce(high_water_marks, 0) AS high_water_marks
  FROM nation LEFT JOIN (SELECT cluster_inventory_id AS k, count(*) AS topics, sum(partitions)::BIGINT AS partitions, sum(under_replicated)::BIGINT AS under_replicated,
    sum(high_water_marks)::BIGINT AS high_water_marks FROM t GROUP BY 1) ON k = n_nationkey),
o AS (SELECT *, current_offset + partition_id AS high_water_mark, partition_id - 1 AS lag
  FROM (SELECT l_suppkey AS group_inventory_id, l_suppkey * 100 + l_partkey % 10 * 8 + l_linenumber AS offset_inventory_id, 't' || l_partkey % 10 AS topic_name,
    l_linenumber AS partition_id, max(l_orderkey) AS current_offset FROM lineitem GROUP BY 1, 2, 3, 4)),
g AS (SELECT {_GROUPS}, coalesce(offsets, 0) AS offsets, coalesce(total_lag, 0) AS total_lag
  FROM supplier LEFT JOIN (SELECT group_inventory_id AS k, count(*) AS offsets, sum(lag)::BIGINT AS total_lag FROM o GROUP BY 1) ON k = s_suppkey),
n AS (SELECT {_CONNECTIONS} FROM nation),
sums AS (SELECT s.*, (SELECT count(*) FROM k WHERE k.snapshot_id = s.snapshot_id) AS clusters,
    coalesce((SELECT sum(topics)::BIGINT FROM k WHERE k.snapshot_id = s.snapshot_id), 0) AS topics,
    coalesce((SELECT sum(partitions)::BIGINT FROM k WHERE k.snapshot_id = s.snapshot_id), 0) AS partitions,
    (SELECT count(*) FROM g WHERE g.snapshot_id = s.snapshot_id) AS groups,
    coalesce((SELECT sum(offsets)::BIGINT FROM g WHERE g.snapshot_id = s.snapshot_id), 0) AS offsets,
    (SELECT count(*) FROM n WHERE n.snapshot_id = s.snapshot_id) AS connections FROM s),
pages AS (
  SELECT parent_id AS snapshot_id, NULL AS cluster_type, 'snapshot' AS section, parent_id, page, n_items, items
    FROM ({_duck_pages("(SELECT *, 0 AS zero FROM sums)", "snapshot_id", "zero", (*snapshots.SNAPSHOT, "clusters", "topics", "partitions", "groups", "offsets", "connections"), "snapshot_id")})
  UNION ALL SELECT parent_id, NULL, 'clusters', * FROM ({_duck_pages("k", "snapshot_id", "cluster_inventory_id", (*snapshots.CLUSTER, "topics", *_TALLY), "cluster_type, cluster_inventory_id")})
  UNION ALL SELECT k.snapshot_id, k.cluster_type, 'topics', x.* FROM ({_duck_pages("t", "cluster_inventory_id", "topic_inventory_id", (*snapshots.TOPIC, *_TALLY), "topic_name, topic_inventory_id")}) AS x
    JOIN k ON x.parent_id = k.cluster_inventory_id
  UNION ALL SELECT k.snapshot_id, k.cluster_type, 'partitions', x.* FROM ({_duck_pages("p", "topic_inventory_id", "partition_id", snapshots.PARTITION, "partition_id")}) AS x
    JOIN t ON x.parent_id = t.topic_inventory_id JOIN k USING (cluster_inventory_id)
  UNION ALL SELECT parent_id, NULL, 'consumer_groups', * FROM ({_duck_pages("g", "snapshot_id", "group_inventory_id", (*snapshots.GROUP, "offsets", "total_lag"), "group_id, group_inventory_id")})
  UNION ALL SELECT g.snapshot_id, NULL, 'consumer_offsets', x.* FROM ({_duck_pages("o", "group_inventory_id", "offset_inventory_id", snapshots.OFFSET, "topic_name, partition_id, offset_inventory_id")}) AS x
    JOIN g ON x.parent_id = g.group_inventory_id
  UNION ALL SELECT parent_id, NULL, 'connections', * FROM ({_duck_pages("n", "snapshot_id", "connection_inventory_id", snapshots.CONNECTION, "connection_type, connection_inventory_id")}))
SELECT s.snapshot_id, job_id, snapshot_type, cluster_type, section, parent_id, page, n_items, items FROM pages JOIN s ON pages.snapshot_id = s.snapshot_id
"""


def _sections(v):
    def shaped(table, columns):
        return v.table(table).select(F.expr(f"struct({columns})").alias("row")).select("row.*")

    offsets = v.table("lineitem").groupBy(
        F.col("l_suppkey").alias("group_inventory_id"), F.expr("l_suppkey * 100 + l_partkey % 10 * 8 + l_linenumber").alias("offset_inventory_id"),
        F.expr("concat('t', l_partkey % 10)").alias("topic_name"), F.col("l_linenumber").alias("partition_id"),
    ).agg(F.max("l_orderkey").alias("current_offset"))
    offsets = offsets.selectExpr("*", "current_offset + partition_id AS high_water_mark", "partition_id - 1 AS lag")
    return snapshots.inventory_sections(
        inventory_tables(v)[0], shaped("nation", _CLUSTERS), shaped("customer", _TOPICS), shaped("orders", _PARTITIONS), shaped("supplier", _GROUPS), offsets,
        shaped("nation", _CONNECTIONS),
    )


@query("inventory_sections", SECTIONS)
def _(v):
    return _sections(v)


@query("inventory_under_replicated", SECTIONS.split("sums AS")[0].rstrip().rstrip(",") + """
SELECT k.snapshot_id, k.cluster_type, cluster_inventory_id::BIGINT AS parent_id, topic_name, t.partitions, t.under_replicated
FROM t JOIN k USING (cluster_inventory_id) JOIN s USING (snapshot_id) WHERE t.under_replicated > 0""")
def _(v):
    items = snapshots.section_items(_sections(v), "topics", "topic_name: string, partitions: bigint, under_replicated: bigint")
    return items.filter("under_replicated > 0")


# --- upkeep of rows without a time, and of gaps resolved before ------------------------------------

UNTIMED = """WITH u AS (SELECT * EXCLUDE (last_updated), CASE WHEN source_high_water_mark % 3 > 0 THEN last_updated END AS last_updated FROM progress),
h AS (SELECT job_id, source_topic, partition_id, last_updated AS detected_at, source_high_water_mark AS gap_end_offset,
    CASE source_high_water_mark % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'ignored' END AS resolution_status,
    CASE WHEN source_high_water_mark % 4 = 0 THEN 'manual' END AS resolution_method,
    CASE WHEN source_high_water_mark % 4 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' END AS resolved_at FROM u)
"""


def _untimed(v):
    return v.progress.withColumn("last_updated", F.expr("IF(source_high_water_mark % 3 > 0, last_updated, NULL)"))


def _handled_gaps(v):
    return _untimed(v).selectExpr(
        "job_id", "source_topic", "partition_id", "last_updated AS detected_at", "source_high_water_mark AS gap_end_offset",
        "CASE source_high_water_mark % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'unresolved' WHEN 2 THEN 'ignored' END AS resolution_status",
        "IF(source_high_water_mark % 4 = 0, 'manual', NULL) AS resolution_method",
        "IF(source_high_water_mark % 4 = 0, TIMESTAMP_NTZ'2024-01-02 00:00:00', NULL) AS resolved_at",
    )


@query("retained_untimed_progress", UNTIMED + f"SELECT * FROM u WHERE (last_updated < {NOW} - INTERVAL 7 DAYS) IS NOT TRUE")
def _(v):
    return maintenance.kept_rows(_untimed(v), "last_updated", as_of=as_of(), days=maintenance.MIRROR_STATE_DAYS)


@query("untimed_gaps_after_cleanup", UNTIMED + f"SELECT * FROM h WHERE (detected_at < {NOW} - INTERVAL 7 DAYS AND resolution_status = 'resolved') IS NOT TRUE")
def _(v):
    return maintenance.without_old_resolved_gaps(_handled_gaps(v), as_of=as_of(), days=7)


@query("gap_resolutions_over_earlier_ones", UNTIMED + f"""
SELECT job_id, source_topic, partition_id, detected_at, gap_end_offset, CASE WHEN gap_end_offset % 5 = 0 THEN 'resolved' ELSE resolution_status END AS resolution_status,
  CASE WHEN gap_end_offset % 5 = 0 THEN 'replayed' ELSE resolution_method END AS resolution_method,
  CASE WHEN gap_end_offset % 5 = 0 THEN {NOW} ELSE resolved_at END AS resolved_at FROM h""")
def _(v):
    keys = ["job_id", "source_topic", "partition_id", "gap_end_offset"]
    gaps = _handled_gaps(v)
    fifth = gaps.filter("gap_end_offset % 5 = 0").select(*keys, F.lit("replayed").alias("method"), as_of().alias("resolved_at"))
    return maintenance.resolve_gaps(gaps, fifth, keys)


@query("recalculated_untimed_progress", UNTIMED + """
SELECT job_id, source_topic, partition_id, last_updated, target_high_water_mark FROM u
  WHERE (last_updated > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 1 HOUR) IS NOT TRUE
UNION ALL SELECT 'job-0', 'fresh', 0, NULL, 1 FROM u HAVING count(*) > 0""")
def _(v):
    stored = _untimed(v).select("job_id", "source_topic", "partition_id", "last_updated", "target_high_water_mark")
    fresh = stored.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").selectExpr(
        "'job-0' AS job_id", "'fresh' AS source_topic", "CAST(0 AS INT) AS partition_id", "CAST(NULL AS DATE) AS last_updated", "1L AS target_high_water_mark"
    )
    return maintenance.replace_recent(stored, fresh, as_of=F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), at="last_updated")
