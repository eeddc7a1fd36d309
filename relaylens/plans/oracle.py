"""DuckDB text of the test views (FIXTURES.md, part 2) and assembly of oracle queries."""

from __future__ import annotations

import re

VIEW_SQL: dict[str, str] = {
    "records": r"""
SELECT event_id, 'job-' || CAST(user_id % 8 AS STRING) AS job_id, 'events-' || event_type AS topic,
       CAST(user_id % 4 AS INT) AS partition_id,
       CAST(row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS rec_offset,
       CAST(user_id AS STRING) AS rec_key, props AS rec_value, ts, value >= 150 AS send_failed
FROM events
""",
    "target_records": r"""
SELECT 'dr-' || substring(topic, 8) AS topic, partition_id, rec_offset, rec_key, rec_value, ts
FROM records
WHERE NOT (topic = 'events-view' AND partition_id = 3) AND rec_offset % 101 <> 50
  AND NOT (topic = 'events-click' AND partition_id = 1 AND ts >= CAST('2024-01-25 00:00:00' AS TIMESTAMP))
""",
    "doc_records": r"""
SELECT 'docs-' || lang AS topic, CAST(doc_id % 3 AS INT) AS partition_id, doc_id AS rec_offset,
       CAST(doc_id AS STRING) AS rec_key, text AS rec_value FROM documents
""",
    "topic_listing": r"""
SELECT DISTINCT topic FROM records
""",
    "rules": r"""
SELECT * FROM (VALUES ('job-0', 1, 'events-(.*)', 'dr-$1', true), ('job-1', 1, 'events-click', 'clicks', true),
  ('job-1', 2, 'events-(p.*|s.*)', 'x-$1', true), ('job-2', 1, 'events-.*', 'all', true),
  ('job-3', 1, 'events-view', '', true), ('job-3', 2, 'nothing-(.*)', 'y-$1', true),
  ('job-4', 1, 'events-error', 'err', false), ('job-5', 1, 'events-missing', 'm', true))
  AS t(job_id, rule_pos, source_pattern, target_pattern, enabled)
""",
    "metric_points": r"""
SELECT event_id, 'job-' || CAST(user_id % 8 AS STRING) AS job_id, ts,
       CASE WHEN user_id % 8 >= 6 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value) AS BIGINT) + 1 END AS messages_replicated_delta,
       CASE WHEN user_id % 8 >= 6 THEN CAST(0 AS BIGINT) ELSE CAST(round(value * 100) AS BIGINT) END AS bytes_transferred_delta,
       CASE WHEN user_id % 8 = 6 THEN CAST(0 AS BIGINT) ELSE CAST(floor(value) AS BIGINT) + 2 END AS messages_consumed_delta,
       CASE WHEN user_id % 8 = 6 THEN CAST(0 AS BIGINT) ELSE CAST(round(value * 110) AS BIGINT) END AS bytes_consumed_delta,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * CASE WHEN user_id % 8 = 5 THEN 120 ELSE 25 END AS avg_lag,
       CASE WHEN event_type = 'error' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS error_count_delta
FROM events
""",
    "raw_metrics": r"""
SELECT event_id, job_id, ts,
       CAST(SUM(messages_replicated_delta) OVER w AS BIGINT) AS messages_replicated,
       CAST(SUM(bytes_transferred_delta) OVER w AS BIGINT) AS bytes_transferred,
       CAST(SUM(messages_consumed_delta) OVER w AS BIGINT) AS messages_consumed,
       CAST(SUM(bytes_consumed_delta) OVER w AS BIGINT) AS bytes_consumed,
       avg_lag AS current_lag, CAST(SUM(error_count_delta) OVER w AS BIGINT) AS error_count
FROM metric_points
WINDOW w AS (PARTITION BY job_id, date_trunc('week', ts) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""",
    "offsets": r"""
SELECT topic, partition_id, MAX(rec_offset) + 1 AS high_water_mark,
       MAX(CASE WHEN ts < CAST('2024-01-28 00:00:00' AS TIMESTAMP) AND NOT (topic = 'events-view' AND partition_id = 3) THEN rec_offset END) AS last_offset
FROM records GROUP BY topic, partition_id
""",
    "progress": r"""
SELECT 'job-0' AS job_id, topic AS source_topic, 'dr-' || substring(topic, 8) AS target_topic, partition_id,
       CAST(date_trunc('day', ts) AS DATE) AS last_updated, MAX(rec_offset) + 1 AS source_high_water_mark,
       greatest(MAX(rec_offset) + 1 - partition_id * 7, 0) AS target_high_water_mark
FROM records GROUP BY topic, partition_id, CAST(date_trunc('day', ts) AS DATE)
""",
    "gaps": r"""
SELECT job_id, source_topic, target_topic, partition_id, target_high_water_mark AS gap_start_offset,
       source_high_water_mark AS gap_end_offset, source_high_water_mark - target_high_water_mark AS gap_size, last_updated AS detected_at,
       CASE WHEN source_high_water_mark % 2 = 0 THEN 'resolved' ELSE 'unresolved' END AS resolution_status
FROM progress WHERE source_high_water_mark > target_high_water_mark
""",
    "resume": r"""
SELECT job_id, source_topic, partition_id, target_high_water_mark AS safe_resume_offset, last_updated AS calculated_at,
       'pending' AS validation_status FROM progress WHERE target_high_water_mark % 5 <> 0
""",
    "analyses": r"""
SELECT job_id, last_updated AS analyzed_at, SUM(CASE WHEN source_high_water_mark > target_high_water_mark THEN 1 ELSE 0 END) AS gaps
FROM progress GROUP BY job_id, last_updated
""",
    "ops_events": r"""
SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'auth_login' WHEN 'error' THEN 'auth_failed' WHEN 'click' THEN 'permission_denied'
         WHEN 'purchase' THEN 'config_change' ELSE 'job_created' END AS event_type,
       CASE WHEN user_id % 10 = 0 THEN 'system' ELSE 'user-' || CAST(user_id AS STRING) END AS initiator, props AS details
FROM events
""",
    "audit_requests": r"""
SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method,
       CASE event_type WHEN 'view' THEN '/api/v1/jobs' WHEN 'click' THEN '/api/v1/clusters' WHEN 'purchase' THEN '/api/v1/config'
         WHEN 'signup' THEN '/api/v1/users' ELSE '/api/v1/jobs/' || CAST(user_id AS STRING) || '/start' END AS path,
       CASE WHEN user_id % 7 = 0 THEN 403 ELSE 200 END AS status,
       CASE WHEN user_id % 11 = 0 THEN NULL ELSE 'user-' || CAST(user_id AS STRING) END AS username,
       '{"name": "n' || CAST(event_id AS STRING) || '", "api_key": "k' || CAST(user_id AS STRING) || '", "note": "' || md5(CAST(event_id AS STRING)) || '"}' AS body
FROM events
""",
    "insights": r"""
SELECT d.doc_id AS id, 'job-' || CAST(d.doc_id % 8 AS STRING) AS job_id,
       CASE d.doc_id % 5 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'optimization' WHEN 2 THEN 'recommendation' WHEN 3 THEN 'log_analysis' ELSE 'throttling_adjustment' END AS insight_type,
       CASE d.doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS severity_level,
       CASE WHEN d.doc_id % 6 = 0 THEN CAST(0 AS BIGINT) ELSE d.n_chars END AS response_time_ms, CAST(l.quality AS DOUBLE) AS accuracy_score,
       CASE d.doc_id % 7 WHEN 0 THEN 'very Helpful' WHEN 1 THEN 'not accurate' WHEN 2 THEN 'noise' END AS user_feedback,
       CASE WHEN d.doc_id % 3 = 0 THEN 'resolved' ELSE 'new' END AS resolution_status,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) + CAST(d.doc_id % 720 AS INT) * INTERVAL '1' HOUR AS ts
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "log_lines": r"""
SELECT event_id, CASE WHEN event_id % 50 = 49 THEN 'malformed ' || CAST(event_id AS STRING) ELSE
       '[' || rpad(CAST(ts AS STRING), 23, '0') || '] ' || CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN ' ELSE 'INFO ' END ||
       ' [consumer.go:' || CAST(event_id % 500 AS STRING) || '] ' ||
       CASE event_id % 3 WHEN 0 THEN '[AI:metrics:milestone] [job:job-' || CAST(user_id % 8 AS STRING) || '] '
         WHEN 1 THEN '[AI:incident:start] [job:job-' || CAST(user_id % 8 AS STRING) || '] [component:producer] ' ELSE '' END ||
       'value=' || CAST(user_id AS STRING) END AS line
FROM events
""",
    "topic_inv": r"""
SELECT 'source' AS cluster_type, CASE WHEN p_partkey % 25 = 0 THEN '__t' ELSE 't' END || CAST(p_partkey AS STRING) AS topic_name, p_size AS partition_count,
       CAST(p_partkey % 5 AS INT) AS replication_factor,
       CASE p_partkey % 7 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zstd' WHEN 2 THEN 'producer' WHEN 3 THEN 'uncompressed' ELSE NULL END AS compression_raw FROM part
UNION ALL
SELECT 'target', CASE WHEN p_partkey % 25 = 0 THEN '__t' ELSE 't' END || CAST(p_partkey AS STRING), p_size + CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE 0 END,
       CAST(least(p_partkey % 5, 3) AS INT), CASE p_partkey % 6 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zstd' ELSE NULL END FROM part WHERE p_partkey % 40 <> 0
""",
    "partitions_inv": r"""
SELECT 't' || CAST(o_custkey % 50 AS STRING) AS topic_name,
       CAST(row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS INT) AS partition_id, CAST(1 + o_orderkey % 3 AS INT) AS leader_id,
       '[1,2,3]' AS replica_ids, CASE o_orderkey % 997 WHEN 0 THEN '[1]' WHEN 5 THEN '[1,2]' ELSE '[1,2,3]' END AS isr_ids FROM orders
""",
    "clusters": r"""
SELECT 'cluster-' || CAST(s_suppkey AS STRING) AS name, CASE s_suppkey % 4 WHEN 0 THEN 'confluent' WHEN 1 THEN 'redpanda' WHEN 2 THEN 'azure' ELSE 'plain' END AS provider,
       'lkc-' || CAST(s_suppkey % 37 AS STRING) AS cluster_id,
       CASE s_suppkey % 4 WHEN 0 THEN 'pkc-1.eu.aws.confluent.cloud:9092' WHEN 1 THEN 'seed-1.redpanda.cloud:99999' WHEN 2 THEN 'ns.servicebus.windows.net:9093' ELSE 'kafka-0:9092,, kafka-1' END AS brokers,
       CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'archived' END AS status,
       CAST('2024-01-31 00:00:00' AS TIMESTAMP) - CAST(s_suppkey % 10 AS INT) * INTERVAL '1' DAY AS updated_at FROM supplier
""",
    "connections": r"""
SELECT name, provider, CASE WHEN provider = 'plain' THEN 'abc' ELSE md5(name) END AS api_key FROM clusters
""",
    "jobs": r"""
SELECT 'job-' || CAST(n_nationkey AS STRING) AS job_id, n_name AS name, 'cluster-' || CAST(n_nationkey % 9 + 1 AS STRING) AS source_cluster_name,
       'cluster-' || CAST((n_nationkey + 4) % 9 + 1 AS STRING) AS target_cluster_name, CASE n_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' ELSE 'failed' END AS status,
       100 * (n_nationkey % 20 + 1) AS batch_size, n_nationkey % 20 + 1 AS parallelism FROM nation
""",
    "rbac_user_roles": r"""
SELECT c_custkey AS user_id, c_name AS username, CAST(c_custkey % 5 AS INT) AS role_id FROM customer
""",
    "rbac_role_permissions": r"""
SELECT n_regionkey AS role_id, n_nationkey AS permission_id, n_name AS permission FROM nation
""",
    "calendar": r"""
SELECT DISTINCT p.period, date_trunc('hour', e.ts) AS now_ts FROM events e CROSS JOIN (VALUES ('daily'), ('weekly'), ('monthly')) AS p(period)
""",
}


def with_views(sql: str) -> str:
    """``sql`` with a WITH clause holding just the views it needs, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEW_SQL:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                needed.add(name)
                visit(VIEW_SQL[name])

    visit(sql)
    ordered = [f"{name} AS ({VIEW_SQL[name].strip()})" for name in VIEW_SQL if name in needed]
    if not ordered:
        return sql.strip()
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body, re.IGNORECASE):
        return "WITH RECURSIVE " + ",\n".join(ordered) + ",\n" + re.sub(r"(?i)^WITH\s+RECURSIVE\s+", "", body)
    if re.match(r"WITH\b", body, re.IGNORECASE):
        return "WITH " + ",\n".join(ordered) + ",\n" + re.sub(r"(?i)^WITH\s+", "", body)
    return "WITH " + ",\n".join(ordered) + "\n" + body
