"""Queries over compliance, insights, logs, audit, access, inventories, data quality and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylens.functions.json_columns import int_array, long_map, sorted_map_json
from relaylens.operators import (
    access, audit, compliance, detect, insights, inventory, logs, maintenance, metrics, quality,
)
from relaylens.plans.bindings import Views, as_of
from relaylens.plans.registry import query
from relaylens.schemas import DOMAINS
from relaylens.sources import payloads

ORDER = ("ts", "event_id")
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
REPORT_AT = "2024-01-30 12:00:00"


def report_at():
    return F.lit(REPORT_AT).cast("timestamp_ntz")


# --- compliance -----------------------------------------------------------------------------------

PERIODS = f"""
WITH periods AS (SELECT * FROM (VALUES
  ('daily', TIMESTAMP '2024-01-30 00:00:00', TIMESTAMP '2024-01-31 00:00:00'),
  ('weekly', TIMESTAMP '2024-01-23 12:00:00', TIMESTAMP '{REPORT_AT}'),
  ('monthly', TIMESTAMP '2023-12-30 12:00:00', TIMESTAMP '{REPORT_AT}')) AS t(period, s, e)),
ev AS MATERIALIZED (
  SELECT period, count(*) FILTER (WHERE event_type = 'auth_login') AS total_login_attempts,
    count(*) FILTER (WHERE event_type = 'auth_failed') AS failed_login_attempts,
    count(DISTINCT initiator) FILTER (WHERE initiator <> 'system') AS unique_active_users,
    count(*) FILTER (WHERE event_type = 'permission_denied') AS permission_denied_events,
    count(*) FILTER (WHERE event_type = 'config_change') AS configuration_changes
  FROM periods LEFT JOIN ops_events ON ts BETWEEN s AND e GROUP BY 1),
events_by AS MATERIALIZED (
  SELECT *, permission_denied_events AS security_incidents,
    coalesce(round(100.0 * (total_login_attempts - failed_login_attempts) / nullif(total_login_attempts, 0), 6), 0.0::DOUBLE) AS success_rate
  FROM ev),
mt AS MATERIALIZED (
  SELECT period, CAST(coalesce(sum(messages_replicated_delta), 0) AS BIGINT) AS total_messages,
    CAST(coalesce(sum(bytes_transferred_delta), 0) AS BIGINT) AS total_bytes,
    CAST(coalesce(sum(error_count_delta), 0) AS BIGINT) AS total_errors,
    coalesce(round(CAST(sum(avg_lag) AS DOUBLE) / nullif(count(event_id), 0), 6), 0.0::DOUBLE) AS average_lag,
    coalesce(round(CAST(sum(messages_replicated_delta) AS DOUBLE) / nullif(count(event_id), 0), 6), 0.0::DOUBLE) AS average_throughput,
    coalesce(round(100.0 * sum(error_count_delta) / nullif(sum(messages_replicated_delta), 0), 6), 0.0::DOUBLE) AS error_rate_percentage,
    coalesce(round(100.0 * count(*) FILTER (WHERE messages_replicated_delta > 0) / nullif(count(event_id), 0), 6), 0.0::DOUBLE) AS uptime_percentage
  FROM periods LEFT JOIN metric_points ON ts BETWEEN s AND e GROUP BY 1),
scored AS MATERIALIZED (
  SELECT *, round(greatest(100.0::DOUBLE - permission_denied_events * 0.5::DOUBLE - error_rate_percentage * 10, 0), 6) AS overall_health_score
  FROM events_by JOIN mt USING (period)),
health AS MATERIALIZED (
  SELECT *, CASE WHEN overall_health_score < 70 THEN 'NON_COMPLIANT' WHEN overall_health_score < 90 THEN 'ATTENTION_REQUIRED'
      ELSE 'COMPLIANT' END AS compliance_status,
    CASE WHEN overall_health_score < 90 OR permission_denied_events > 10 OR error_rate_percentage > 1 THEN
      '[' || concat_ws(',', CASE WHEN overall_health_score < 90 THEN '"{compliance.LOW_SCORE_ADVICE}"' END,
        CASE WHEN permission_denied_events > 10 THEN '"{compliance.DENIED_ADVICE}"' END,
        CASE WHEN error_rate_percentage > 1 THEN '"{compliance.ERROR_ADVICE}"' END) || ']'
      ELSE '["{compliance.NORMAL_ADVICE}"]' END AS recommendations
  FROM scored),
usage AS MATERIALIZED (
  SELECT period, insight_type, count(*) AS insights FROM periods JOIN insights ON ts BETWEEN s AND e GROUP BY 1, 2),
active AS (SELECT count(*) AS active_jobs FROM jobs WHERE status = 'active')
"""


@query("access_audit", PERIODS + "SELECT period, total_login_attempts, failed_login_attempts, unique_active_users, success_rate FROM events_by")
def _(v):
    return compliance.access_audit(v.ops_events, as_of=report_at())


@query("data_processing_summary", PERIODS + "SELECT period, total_messages, total_bytes, average_lag, active_jobs FROM mt CROSS JOIN active")
def _(v):
    return compliance.data_processing(v.metric_points, v.jobs, as_of=report_at())


@query("security_events", PERIODS + "SELECT period, permission_denied_events, configuration_changes, security_incidents FROM events_by")
def _(v):
    return compliance.security_events(v.ops_events, as_of=report_at())


@query("config_change_trail", PERIODS + """
SELECT period, ts, event_id, initiator, details FROM periods JOIN ops_events ON ts BETWEEN s AND e
WHERE event_type = 'config_change'""")
def _(v):
    return compliance.config_changes(v.ops_events, as_of=report_at())


@query("audit_trail_pages", PERIODS + """
SELECT period, event_id // 200 AS page, count(*) AS changes,
  CAST(to_json(list({'event_id': event_id, 'initiator': initiator, 'details': details} ORDER BY event_id)) AS VARCHAR) AS trail
FROM periods JOIN ops_events ON ts BETWEEN s AND e WHERE event_type = 'config_change' GROUP BY ALL""")
def _(v):
    return compliance.audit_trail_pages(v.ops_events, as_of=report_at(), page_size=200)


@query("insight_usage", PERIODS + """
SELECT period, insight_type, insights, CAST(sum(insights) OVER (PARTITION BY period) AS BIGINT) AS total_insights FROM usage""")
def _(v):
    return compliance.insight_usage(v.insights, as_of=report_at())


@query("performance_summary", PERIODS + "SELECT period, average_throughput, total_errors, error_rate_percentage, uptime_percentage FROM mt")
def _(v):
    return compliance.performance(v.metric_points, as_of=report_at())


@query("compliance_health", PERIODS + """
SELECT period, permission_denied_events, error_rate_percentage, overall_health_score, compliance_status, recommendations FROM health""")
def _(v):
    return compliance.health_summary(v.ops_events, v.metric_points, as_of=report_at())


def _reports(v: Views):
    return compliance.compliance_reports(v.ops_events, v.metric_points, v.insights, v.jobs, as_of=report_at())


@query("compliance_reports", PERIODS + """
SELECT h.*, p.s AS start_date, p.e AS end_date, active_jobs, coalesce(u.total, 0) AS total_insights_generated,
  coalesce(u.by_type, '{}') AS insights_by_type
FROM health h JOIN periods p USING (period) CROSS JOIN active LEFT JOIN (
  SELECT period, CAST(sum(insights) AS BIGINT) AS total,
    '{' || string_agg('"' || insight_type || '":' || insights, ',' ORDER BY insight_type) || '}' AS by_type
  FROM usage GROUP BY 1) u USING (period)""")
def _(v):
    return _reports(v)


@query("newest_compliance_reports", PERIODS + f"""
SELECT period, p.s AS start_date, p.e AS end_date, CAST(0 AS BIGINT) AS generated_by, TIMESTAMP '{REPORT_AT}' AS generated_at,
  total_messages, compliance_status FROM health JOIN periods p USING (period)""")
def _(v):
    stored = compliance.newest_reports(compliance.stored_reports(_reports(v), as_of=report_at()))
    return stored.select(
        "period", "start_date", "end_date", "generated_by", "generated_at",
        F.get_json_object("report_data", "$.total_messages").cast("long").alias("total_messages"),
        F.get_json_object("report_data", "$.compliance_status").alias("compliance_status"),
    )


@query("report_csv_rows", PERIODS + f"""
SELECT section, CAST(NULL AS TIMESTAMP) AS at, CAST(NULL AS BIGINT) AS row_id, c1, c2, c3 FROM (
  SELECT unnest([
    {{'section': 1, 'c1': 'Compliance Report', 'c2': '', 'c3': ''}}, {{'section': 2, 'c1': 'Period', 'c2': period, 'c3': ''}},
    {{'section': 3, 'c1': 'Date Range', 'c2': strftime(s, '%Y-%m-%d') || ' to ' || strftime(e, '%Y-%m-%d'), 'c3': ''}},
    {{'section': 4, 'c1': 'Generated', 'c2': '{REPORT_AT}', 'c3': ''}}, {{'section': 5, 'c1': '', 'c2': '', 'c3': ''}},
    {{'section': 6, 'c1': 'COMPLIANCE SUMMARY', 'c2': '', 'c3': ''}}, {{'section': 7, 'c1': 'Metric', 'c2': 'Value', 'c3': ''}},
    {{'section': 8, 'c1': 'Health Score', 'c2': printf('%.1f', overall_health_score) || '%', 'c3': ''}},
    {{'section': 9, 'c1': 'Status', 'c2': compliance_status, 'c3': ''}}, {{'section': 10, 'c1': '', 'c2': '', 'c3': ''}},
    {{'section': 11, 'c1': 'AUDIT TRAIL (Configuration Changes)', 'c2': '', 'c3': ''}},
    {{'section': 12, 'c1': 'Timestamp', 'c2': 'Initiator', 'c3': 'Details'}}], recursive := true)
  FROM health JOIN periods USING (period) WHERE period = 'weekly')
UNION ALL
SELECT 13, ts, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), initiator, details FROM periods JOIN ops_events ON ts BETWEEN s AND e
WHERE event_type = 'config_change' AND period = 'weekly'""")
def _(v):
    return compliance.report_rows(_reports(v), v.ops_events, "weekly", as_of=report_at())


@query("report_window_events", PERIODS + """
SELECT period, event_type, count(*) AS events FROM periods JOIN ops_events ON ts BETWEEN s AND e GROUP BY 1, 2""")
def _(v):
    return compliance.in_windows(v.ops_events, as_of=report_at()).groupBy("period", "event_type").agg(
        F.count(F.lit(1)).alias("events")
    )


@query("due_reports", """
SELECT * FROM (SELECT period, now_ts, now_ts - CASE WHEN day(now_ts) % 3 = 0 THEN INTERVAL 2 HOURS ELSE INTERVAL 50 HOURS END AS last_run
  FROM calendar)
WHERE hour(now_ts) = 6 AND CASE period
  WHEN 'daily' THEN CAST(now_ts AS DATE) <> CAST(last_run AS DATE)
  WHEN 'weekly' THEN isodow(now_ts) = 1 AND (isoyear(now_ts), week(now_ts)) <> (isoyear(last_run), week(last_run))
  ELSE day(now_ts) = 1 AND (year(now_ts), month(now_ts)) <> (year(last_run), month(last_run)) END""")
def _(v):
    last = F.col("now_ts") - F.when(F.dayofmonth("now_ts") % 3 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(
        F.expr("INTERVAL 50 HOURS")
    )
    return compliance.due_reports(v.calendar.withColumn("last_run", last), run_hour=6)


@query("retention_classes", """
SELECT category, retention_years, CAST(day + to_years(retention_years) AS DATE) AS expires_on, count(*) AS events FROM (
  SELECT CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('job_created', 'job_updated', 'job_deleted') THEN 'Job Management'
    ELSE 'General Operations' END AS category,
    CAST(CASE WHEN event_type IN ('job_created', 'job_updated', 'job_deleted') THEN 7 ELSE 1 END AS INTEGER) AS retention_years
  FROM ops_events) GROUP BY 1, 2, 3""")
def _(v):
    return compliance.retention_classes(v.ops_events)


@query("newest_events", "SELECT * FROM ops_events ORDER BY ts DESC, event_id DESC LIMIT 100")
def _(v):
    return compliance.newest_events(v.ops_events)


# --- insights -------------------------------------------------------------------------------------


@query("insight_search", """
SELECT * FROM insights WHERE insight_type IN ('anomaly', 'recommendation') AND job_id = 'job-2' ORDER BY ts DESC, id DESC LIMIT 20""")
def _(v):
    return insights.search(v.insights, insight_types=("anomaly", "recommendation"), job_id="job-2", limit=20)


@query("insights_anomalies", "SELECT * FROM insights WHERE insight_type = 'anomaly'")
def _(v):
    return insights.search(v.insights, insight_types=("anomaly",))


@query("praised_insights", "SELECT * FROM insights WHERE user_feedback ILIKE '%helpful%' OR user_feedback ILIKE '%accurate%'")
def _(v):
    return insights.praised_insights(v.insights)


@query("insight_quality", """
SELECT count(*) AS total_insights,
  round(CAST(sum(response_time_ms) FILTER (WHERE response_time_ms > 0) AS DOUBLE) / count(*) FILTER (WHERE response_time_ms > 0), 6)
    AS avg_response_time_ms,
  round(100.0 * count(*) FILTER (WHERE resolution_status = 'resolved' AND (accuracy_score >= 0.7 OR user_feedback ILIKE '%helpful%'
    OR user_feedback ILIKE '%accurate%')) / count(*) FILTER (WHERE resolution_status = 'resolved'), 6) AS accuracy_rate,
  count(*) FILTER (WHERE insight_type = 'anomaly') AS anomaly_count,
  count(*) FILTER (WHERE insight_type IN ('optimization', 'recommendation')) AS recommendation_count
FROM insights""")
def _(v):
    return insights.quality(v.insights)


@query("insights_by_type", "SELECT insight_type, count(*) AS insights FROM insights GROUP BY 1")
def _(v):
    return insights.by_type(v.insights)


@query("statistics_documents", f"""
SELECT job_id, 'job: ' || job_id || chr(10) || 'points: ' || n || chr(10) || 'throughput: avg ' || a || ', range ' || mi || ' - ' || ma
  || ', trend ' || CASE WHEN s2 > 1.2::DOUBLE * (s1::DOUBLE * n2 / nullif(n1, 0)) THEN 'increasing'
    WHEN s2 < 0.8::DOUBLE * (s1::DOUBLE * n2 / nullif(n1, 0)) THEN 'decreasing' ELSE 'stable' END
  || chr(10) || 'lag: avg ' || la || ', range ' || lmi || ' - ' || lma || chr(10) || 'errors: ' || e AS document
FROM (SELECT job_id, count(*) AS n, CAST(sum(m) // count(*) AS BIGINT) AS a, min(m) AS mi, max(m) AS ma,
    CAST(sum(lag) // count(*) AS BIGINT) AS la, min(lag) AS lmi, max(lag) AS lma, CAST(sum(e) AS BIGINT) AS e,
    coalesce(sum(m) FILTER (WHERE rn <= c // 2), 0) AS s1, coalesce(sum(m) FILTER (WHERE rn > c // 2), 0) AS s2,
    count(*) FILTER (WHERE rn <= c // 2) AS n1, count(*) FILTER (WHERE rn > c // 2) AS n2
  FROM (SELECT job_id, messages_replicated_delta AS m, avg_lag AS lag, error_count_delta AS e,
      row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY job_id) AS c
    FROM metric_points WHERE ts > {NOW} - INTERVAL 10 DAYS AND ts <= {NOW}) GROUP BY job_id)""")
def _(v):
    stats = detect.series_statistics(v.metric_points, as_of=as_of(), span="INTERVAL 10 DAYS", order=ORDER)
    return insights.statistics_documents(stats)


@query("daily_documents", f"""
SELECT job_id, 'job: ' || job_id || chr(10) || 'days: 30' || chr(10) || string_agg('- ' || period || ': ' || m || ' messages, lag ' || l ||
  ', ' || e || ' errors', chr(10) ORDER BY period) AS document
FROM (SELECT job_id, strftime(ts, '%Y-%m-%d') AS period, CAST(sum(messages_replicated_delta) AS BIGINT) AS m,
    CAST(floor(round(CAST(sum(avg_lag) AS DOUBLE) / count(*), 6) + 0.5) AS BIGINT) AS l, CAST(sum(error_count_delta) AS BIGINT) AS e
  FROM metric_points WHERE ts >= {NOW} - INTERVAL 30 DAYS GROUP BY 1, 2) GROUP BY job_id""")
def _(v):
    return insights.daily_documents(metrics.rollup(v.metric_points, "daily", as_of=as_of(), days=30), days=30)


# --- logs -----------------------------------------------------------------------------------------

PARSED = rf"""
WITH parsed AS MATERIALIZED (
  SELECT event_id, try_strptime(regexp_extract(line, p, 1), '%Y-%m-%d %H:%M:%S.%g') AS ts, regexp_extract(line, p, 2) AS level,
    regexp_extract(line, p, 3) AS caller, regexp_extract(line, p, 4) AS category, regexp_extract(line, p, 5) AS subcategory,
    regexp_extract(line, p, 6) AS job_id, regexp_extract(line, p, 7) AS component, trim(regexp_extract(line, p, 8)) AS message, line
  FROM (SELECT *, '{logs.LINE}' AS p FROM log_lines)),
entries AS MATERIALIZED (SELECT * EXCLUDE line FROM parsed WHERE ts IS NOT NULL)
"""


def _parsed(v: Views):
    return logs.parse_log_lines(v.log_lines)


@query("parse_log_lines", PARSED + "SELECT * FROM entries")
def _(v):
    return _parsed(v)


@query("malformed_log_lines", PARSED + "SELECT event_id, line FROM parsed WHERE ts IS NULL")
def _(v):
    return logs.malformed_log_lines(v.log_lines)


@query("job_log_entries", PARSED + "SELECT * FROM entries WHERE job_id = 'job-3' AND ts > TIMESTAMP '2024-01-10 00:00:00'")
def _(v):
    return logs.job_log_entries(_parsed(v), since=F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"), job_id="job-3")


@query("log_pattern_counts", PARSED + """
SELECT level, category, subcategory, job_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS lines
FROM entries GROUP BY 1, 2, 3, 4, 5""")
def _(v):
    return logs.pattern_counts(_parsed(v))


@query("job_log_summary", PARSED + """,
ranked AS (SELECT *, component = 'producer' AS p, row_number() OVER (PARTITION BY job_id, component = 'producer'
  ORDER BY ts DESC, event_id DESC) AS rn FROM entries WHERE job_id <> '')
SELECT job_id, count(*) FILTER (WHERE level = 'ERROR') AS error_count, count(*) FILTER (WHERE level = 'WARN') AS warn_count,
  coalesce(string_agg(message, chr(10) ORDER BY rn) FILTER (WHERE p AND rn <= 50), '') AS producer_logs,
  coalesce(string_agg(message, chr(10) ORDER BY rn) FILTER (WHERE NOT p AND rn <= 50), '') AS consumer_logs,
  CASE WHEN count(*) FILTER (WHERE level = 'ERROR') > 10 THEN 'high' WHEN count(*) FILTER (WHERE level = 'ERROR') > 0 THEN 'medium'
    ELSE 'low' END AS severity
FROM ranked GROUP BY job_id""")
def _(v):
    return logs.job_log_summary(_parsed(v), order=ORDER)


@query("analysis_context", PARSED + """,
m AS (SELECT job_id, make_timestamp((epoch_us(ts) // 1800000000 + 1) * 1800000000) AS window_end, count(*) AS points,
    CAST(sum(messages_replicated_delta) AS BIGINT) AS messages, max(avg_lag) AS max_lag, CAST(sum(error_count_delta) AS BIGINT) AS errors
  FROM metric_points GROUP BY 1, 2),
l AS (SELECT job_id, make_timestamp((epoch_us(ts) // 1800000000 + 1) * 1800000000) AS window_end, count(*) AS log_lines,
    count(*) FILTER (WHERE level = 'ERROR') AS error_lines, count(*) FILTER (WHERE level = 'WARN') AS warn_lines
  FROM entries WHERE job_id <> '' GROUP BY 1, 2)
SELECT job_id, window_end, points, messages, max_lag, errors, coalesce(log_lines, 0) AS log_lines,
  coalesce(error_lines, 0) AS error_lines, coalesce(warn_lines, 0) AS warn_lines
FROM m LEFT JOIN l USING (job_id, window_end)""")
def _(v):
    return insights.analysis_context(v.metric_points, _parsed(v))


# --- audit and access -------------------------------------------------------------------------------

MASK = r"""regexp_replace(regexp_replace({body}, '"(api_key|token|password|secret)":\s*"[^"]*"', '"\1":"***MASKED***"', 'g'),
  '"([^"]*)":\s*"(sk-|Bearer |[A-Za-z0-9+/]{{20,}})"', '"\1":"***MASKED***"', 'g')"""


@query("masked_requests", f"""
SELECT event_id, ts, CASE WHEN length(d) > 500 THEN substring(d, 1, 497) || '...' ELSE d END AS details
FROM (SELECT event_id, ts, {MASK.format(body='body')} AS d FROM audit_requests)""")
def _(v):
    return audit.masked_requests(v.audit_requests)


@query("audit_events", f"""
SELECT event_id, ts, method || ' ' || path AS event_type,
  CASE WHEN status = 401 THEN 'auth_failed' WHEN status = 403 THEN 'permission_denied' WHEN path LIKE '%/auth/login%' THEN 'auth_login'
    WHEN path LIKE '%/config%' THEN 'config_change' ELSE 'other' END AS event_class,
  coalesce(username, 'Anonymous') AS initiator,
  CASE WHEN path LIKE '%/jobs%' AND method = 'POST' THEN 'Created job ''' || (body->>'name') || ''' from  to '
    WHEN path LIKE '%/jobs%' AND path LIKE '%/start%' THEN 'Started replication job: ' || regexp_extract(path, '/jobs/([^/]+)', 1)
    WHEN path LIKE '%/clusters%' AND method = 'POST' THEN 'Created cluster ''' || (body->>'name') || ''' (provider: )'
    WHEN path LIKE '%/config%' AND method = 'PUT' THEN 'Updated system configuration'
    WHEN path LIKE '%/users%' AND method = 'POST' THEN 'Created user '''' with role '''''
    ELSE {MASK.format(body='body')} END AS details
FROM audit_requests
WHERE (method NOT IN ('GET', 'HEAD', 'OPTIONS') AND status >= 200 AND status < 300) OR status IN (401, 403)""")
def _(v):
    return audit.audit_events(v.audit_requests)


@query("masked_connections", """
SELECT name, provider, CASE WHEN length(api_key) <= 4 THEN '****' ELSE substring(api_key, 1, 4) || '****' END AS api_key_prefix
FROM connections""")
def _(v):
    return audit.masked_connections(v.connections)


@query("effective_permissions", """
SELECT DISTINCT user_id, username, permission FROM rbac_user_roles JOIN rbac_role_permissions USING (role_id)""")
def _(v):
    return access.effective_permissions(v.rbac_user_roles, v.rbac_role_permissions)


@query("unauthorised_actions", """
WITH need(event_type, permission) AS (VALUES ('auth_login', 'NATION_1'), ('auth_failed', 'NATION_2'),
  ('permission_denied', 'NATION_3'), ('config_change', 'NATION_4'), ('job_created', 'NATION_5')),
held AS (SELECT DISTINCT 'user-' || user_id AS initiator, permission FROM rbac_user_roles JOIN rbac_role_permissions USING (role_id))
SELECT o.initiator, o.event_type, n.permission, count(*) AS events, min(ts) AS first_at, max(ts) AS last_at
FROM ops_events o JOIN need n ON n.event_type = o.event_type
WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.initiator = o.initiator AND h.permission = n.permission) GROUP BY 1, 2, 3""")
def _(v):
    required = v.spark.createDataFrame(
        [("auth_login", "NATION_1"), ("auth_failed", "NATION_2"), ("permission_denied", "NATION_3"),
         ("config_change", "NATION_4"), ("job_created", "NATION_5")],
        "event_type string, permission string",
    )
    users = v.rbac_user_roles.withColumn("username", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    held = access.effective_permissions(users, v.rbac_role_permissions)
    return access.unauthorised_actions(v.ops_events, required, held)


@query("user_roles", """
SELECT user_id, username, r_name AS role FROM rbac_user_roles JOIN region ON r_regionkey = role_id""")
def _(v):
    roles = v.table("region").selectExpr("r_regionkey AS role_id", "r_name AS role")
    return access.user_roles_listing(v.rbac_user_roles, roles)


@query("job_state_corrections", f"""
SELECT job_id, status, running AS is_running, CASE WHEN status IS NULL THEN 'unregistered' WHEN running THEN 'active' ELSE 'paused' END
  AS corrected_status
FROM (SELECT coalesce(j.job_id, m.job_id) AS job_id, status, m.job_id IS NOT NULL AS running FROM jobs j
  FULL JOIN (SELECT DISTINCT job_id FROM metric_points WHERE ts > {NOW} - INTERVAL 3 DAYS AND ts <= {NOW}) m ON m.job_id = j.job_id)
WHERE status IS NULL OR (status = 'active' AND NOT running) OR (status = 'paused' AND running)""")
def _(v):
    return access.state_corrections(v.jobs, access.running_jobs(v.metric_points, as_of=as_of(), span="INTERVAL 3 DAYS"))


# --- inventories ------------------------------------------------------------------------------------

CLASS = "CASE WHEN compression_raw IN ('gzip', 'snappy', 'lz4', 'zstd', 'producer') THEN compression_raw ELSE 'NONE' END"
PAIRS = f"""
WITH pairs AS (SELECT s.topic_name, s.partition_count AS source_partitions, t.partition_count AS target_partitions,
    s.replication_factor AS source_replication_factor, t.replication_factor AS target_replication_factor,
    s.c AS source_compression, t.c AS target_compression
  FROM (SELECT *, {CLASS} AS c FROM topic_inv) s JOIN (SELECT *, {CLASS} AS c FROM topic_inv) t
    ON s.topic_name = t.topic_name AND s.cluster_type = 'source' AND t.cluster_type = 'target')
"""


@query("topic_compression", f"SELECT cluster_type, topic_name, partition_count, replication_factor, {CLASS} AS compression_type FROM topic_inv")
def _(v):
    return inventory.topic_compression(v.topic_inv)


@query("compression_compatibility", PAIRS + """
SELECT topic_name, source_compression, target_compression, CASE WHEN source_compression = target_compression THEN 'matched'
  WHEN target_compression = 'NONE' THEN 'mismatch' WHEN source_compression = 'NONE' THEN 'enhancement' ELSE 'different' END AS relation
FROM pairs""")
def _(v):
    return inventory.compression_compatibility(v.topic_inv)


@query("replication_factors", """
SELECT topic_name, replication_factor, CAST(least(greatest(replication_factor, 1), 3) AS INTEGER) AS target_replication_factor,
  least(greatest(replication_factor, 1), 3) <> replication_factor AS changed
FROM topic_inv WHERE cluster_type = 'source'""")
def _(v):
    return inventory.replication_factors(v.topic_inv, brokers=3)


@query("topic_compatibility", PAIRS + """
SELECT topic_name, source_partitions, target_partitions, source_replication_factor, target_replication_factor,
  CASE WHEN source_partitions <> target_partitions THEN 'partition_mismatch'
    WHEN source_replication_factor <> target_replication_factor THEN 'replication_warning' ELSE 'compatible' END AS status FROM pairs""")
def _(v):
    return inventory.topic_compatibility(v.topic_inv)


HEALTH = """
WITH found AS (SELECT topic_name, count(*) AS partitions,
    CAST(arg_min(json_array_length(replica_ids), partition_id) AS BIGINT) AS replication_factor,
    count(*) FILTER (WHERE json_array_length(isr_ids) < json_array_length(replica_ids)) AS under_replicated_partitions
  FROM partitions_inv GROUP BY 1),
health AS (SELECT topic_name, coalesce(partitions, 0) AS partitions, coalesce(replication_factor, 0) AS replication_factor,
    coalesce(under_replicated_partitions, 0) AS under_replicated_partitions,
    coalesce(under_replicated_partitions = 0, false) AS is_healthy
  FROM (SELECT DISTINCT topic_name FROM topic_inv) LEFT JOIN found USING (topic_name))
"""


@query("topic_health", HEALTH + "SELECT * FROM health")
def _(v):
    return inventory.topic_health(v.topic_inv, v.partitions_inv)


@query("topic_health_alerts", HEALTH + """
SELECT topic_name, 'topic_health_alert' AS event_type, 'system' AS initiator,
  'Topic ' || topic_name || ' is unhealthy. Under-replicated partitions: ' || under_replicated_partitions AS details
FROM health WHERE NOT is_healthy""")
def _(v):
    return inventory.health_alerts(inventory.topic_health(v.topic_inv, v.partitions_inv))


TREE = """
WITH snapshots AS (SELECT r_regionkey AS snapshot_id, 'job-' || r_regionkey AS job_id,
    CASE r_regionkey % 3 WHEN 0 THEN 'startup' WHEN 1 THEN 'periodic' ELSE 'manual' END AS snapshot_type,
    TIMESTAMP '2024-01-31 00:00:00' - to_days(r_regionkey * 12) AS created_at FROM region),
inv_clusters AS (SELECT n_nationkey AS cluster_inventory_id, n_regionkey AS snapshot_id, n_name AS cluster_name,
    CASE n_nationkey % 2 WHEN 0 THEN 'source' ELSE 'target' END AS cluster_type FROM nation),
inv_topics AS (SELECT c_custkey AS topic_inventory_id, c_nationkey AS cluster_inventory_id,
    CASE WHEN c_custkey % 25 = 0 THEN '__' ELSE '' END || c_name AS topic_name FROM customer),
inv_partitions AS (SELECT o_custkey AS topic_inventory_id, o_orderkey AS partition_id, CAST(1 + o_orderkey % 3 AS INTEGER) AS leader_id
  FROM orders)
"""


def inventory_tables(v: Views):
    snapshots = v.table("region").selectExpr(
        "r_regionkey AS snapshot_id", "concat('job-', r_regionkey) AS job_id",
        "CASE r_regionkey % 3 WHEN 0 THEN 'startup' WHEN 1 THEN 'periodic' ELSE 'manual' END AS snapshot_type",
        "TIMESTAMP_NTZ'2024-01-31 00:00:00' - make_dt_interval(r_regionkey * 12) AS created_at",
    )
    clusters = v.table("nation").selectExpr(
        "n_nationkey AS cluster_inventory_id", "n_regionkey AS snapshot_id", "n_name AS cluster_name",
        "IF(n_nationkey % 2 = 0, 'source', 'target') AS cluster_type",
    )
    topics = v.table("customer").selectExpr(
        "c_custkey AS topic_inventory_id", "c_nationkey AS cluster_inventory_id",
        "concat(IF(c_custkey % 25 = 0, '__', ''), c_name) AS topic_name",
    )
    partitions = v.table("orders").selectExpr(
        "o_custkey AS topic_inventory_id", "o_orderkey AS partition_id", "CAST(1 + o_orderkey % 3 AS INT) AS leader_id"
    )
    return snapshots, clusters, topics, partitions


@query("inventory_tree", TREE + """
SELECT snapshot_id, job_id, snapshot_type, cluster_type, cluster_name, topic_inventory_id, topic_name, page, partitions,
  coalesce(partitions_in_page, 0) AS partitions_in_page
FROM snapshots LEFT JOIN inv_clusters USING (snapshot_id) LEFT JOIN inv_topics USING (cluster_inventory_id)
LEFT JOIN (SELECT topic_inventory_id, partition_id // 1000 AS page, count(*) AS partitions_in_page,
    '[' || string_agg('{"partition_id":' || partition_id || ',"leader_id":' || leader_id || '}', ',' ORDER BY partition_id) || ']' AS partitions
  FROM inv_partitions GROUP BY 1, 2) USING (topic_inventory_id)""")
def _(v):
    return inventory.inventory_tree(*inventory_tables(v))


@query("cluster_counts", TREE + """
SELECT snapshot_id, cluster_name, cluster_type, count(DISTINCT topic_inventory_id) AS total_topics,
  count(partition_id) AS total_partitions, count(DISTINCT topic_inventory_id) FILTER (WHERE topic_name LIKE '\\_\\_%' ESCAPE '\\') AS internal_topics,
  count(DISTINCT leader_id) AS broker_count
FROM inv_clusters LEFT JOIN inv_topics USING (cluster_inventory_id) LEFT JOIN inv_partitions USING (topic_inventory_id)
GROUP BY cluster_inventory_id, snapshot_id, cluster_name, cluster_type""")
def _(v):
    _, clusters, topics, partitions = inventory_tables(v)
    return inventory.cluster_counts(clusters, topics, partitions)


@query("snapshots_newest_first", TREE + "SELECT * FROM snapshots")
def _(v):
    return inventory.snapshots_of_job(inventory_tables(v)[0])


GROUPS = """
WITH inv_groups AS (SELECT s_suppkey AS group_inventory_id, s_nationkey % 5 AS snapshot_id, s_name AS group_id FROM supplier),
group_rows AS (SELECT l_suppkey AS group_inventory_id, 't' || l_partkey % 10 AS topic_name, l_linenumber AS partition_id,
    max(CASE WHEN l_returnflag = 'N' THEN l_orderkey END) AS current_offset, max(l_orderkey) + 1 AS high_water_mark
  FROM lineitem GROUP BY 1, 2, 3)
"""


def _groups(v: Views):
    groups = v.table("supplier").selectExpr(
        "s_suppkey AS group_inventory_id", "s_nationkey % 5 AS snapshot_id", "s_name AS group_id"
    )
    offsets = v.table("lineitem").selectExpr(
        "l_suppkey AS group_inventory_id", "concat('t', l_partkey % 10) AS topic_name", "l_linenumber AS partition_id",
        "l_orderkey", "l_returnflag",
    ).groupBy("group_inventory_id", "topic_name", "partition_id").agg(
        F.max(F.when(F.col("l_returnflag") == "N", F.col("l_orderkey"))).alias("current_offset"),
        (F.max("l_orderkey") + 1).alias("high_water_mark"),
    )
    return groups, offsets


@query("consumer_group_offsets", GROUPS + """
SELECT snapshot_id, group_id, topic_name, partition_id, coalesce(current_offset, -1) AS current_offset, high_water_mark,
  greatest(high_water_mark - coalesce(current_offset, -1) - 1, 0) AS lag
FROM inv_groups JOIN group_rows USING (group_inventory_id)""")
def _(v):
    return inventory.group_offsets(*_groups(v))


@query("consumer_group_lag", GROUPS + """
SELECT snapshot_id, group_id, count(partition_id) AS partitions,
  CAST(coalesce(sum(greatest(high_water_mark - coalesce(current_offset, -1) - 1, 0)), 0) AS BIGINT) AS lag
FROM inv_groups LEFT JOIN group_rows USING (group_inventory_id) GROUP BY 1, 2""")
def _(v):
    return inventory.group_lag(*_groups(v))


# --- data quality -----------------------------------------------------------------------------------


@query("duplicate_cluster_ids", """
SELECT cluster_id, count(*) AS copies FROM clusters WHERE provider IN ('confluent', 'redpanda') AND cluster_id <> ''
GROUP BY 1 HAVING count(*) > 1""")
def _(v):
    hosted = F.col("provider").isin("confluent", "redpanda") & (F.col("cluster_id") != "")
    return quality.duplicate_keys(v.clusters, ["cluster_id"], scope=hosted)


@query("replayed_records", """
SELECT topic, partition_id, rec_offset, count(*) AS copies FROM (
  SELECT topic, partition_id, rec_offset FROM records UNION ALL
  SELECT topic, partition_id, rec_offset FROM records WHERE send_failed) GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def _(v):
    replay = v.records.unionByName(v.records.filter("send_failed"))
    return quality.duplicate_keys(replay, ["topic", "partition_id", "rec_offset"])


@query("duplicate_names", """
SELECT p_name, count(*) AS copies FROM part GROUP BY 1 HAVING count(*) > 1""")
def _(v):
    return quality.duplicate_keys(v.table("part"), ["p_name"])


@query("table_domain_violations", """
SELECT 'insight_type' AS column_name, insight_type AS value, count(*) AS rows_found FROM insights
WHERE insight_type NOT IN ('anomaly', 'optimization', 'prediction', 'incident_report', 'recommendation', 'enhanced_analysis',
  'log_analysis', 'incident_analysis', 'historical_trend', 'fallback_analysis', 'throttling_adjustment') GROUP BY 2
UNION ALL SELECT 'resolution_status', validation_status, count(*) FROM resume
  WHERE validation_status NOT IN ('unresolved', 'in_progress', 'resolved', 'ignored') GROUP BY 2""")
def _(v):
    pending = v.resume.withColumnRenamed("validation_status", "resolution_status")
    return quality.table_violations(v.insights, "ai_insights").unionByName(quality.table_violations(pending, "mirror_gaps"))


@query("domain_violations", """
SELECT 'status' AS column_name, status AS value, count(*) AS rows_found FROM clusters
  WHERE status NOT IN ('active', 'inactive', 'unknown') GROUP BY 2
UNION ALL SELECT 'insight_type', insight_type, count(*) FROM insights WHERE insight_type NOT IN ('anomaly', 'optimization', 'prediction',
  'incident_report', 'recommendation', 'enhanced_analysis', 'incident_analysis', 'historical_trend') GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM jobs WHERE status NOT IN ('active', 'failed', 'running') GROUP BY 2""")
def _(v):
    without_logs = [t for t in DOMAINS["insight_type"] if t not in ("log_analysis", "throttling_adjustment", "fallback_analysis")]
    without_paused = [s for s in DOMAINS["job_status"] if s != "paused"]
    return (
        quality.domain_violations(v.clusters, "status", ("active", "inactive", "unknown"))
        .unionByName(quality.domain_violations(v.insights, "insight_type", without_logs))
        .unionByName(quality.domain_violations(v.jobs, "status", without_paused))
    )


@query("orphan_references", """
SELECT 'source_cluster_name' AS column_name, source_cluster_name AS value, count(*) AS rows_found FROM jobs
  WHERE source_cluster_name NOT IN (SELECT name FROM clusters WHERE status <> 'archived') GROUP BY 2
UNION ALL SELECT 'job_id', job_id, count(*) FROM metric_points
  WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status <> 'failed') GROUP BY 2""")
def _(v):
    return quality.orphans(v.jobs, "source_cluster_name", v.clusters.filter("status <> 'archived'"), "name").unionByName(
        quality.orphans(v.metric_points, "job_id", v.jobs.filter("status <> 'failed'"), "job_id")
    )


# --- maintenance ------------------------------------------------------------------------------------


@query("retained_metric_points", f"SELECT * FROM metric_points WHERE ts >= {NOW} - INTERVAL 7 DAYS")
def _(v):
    return maintenance.pruned(v.metric_points, "ts", as_of=as_of(), days=7)


@query("retained_events", f"SELECT * FROM ops_events WHERE ts >= {NOW} - INTERVAL 30 DAYS")
def _(v):
    return maintenance.pruned(v.ops_events, "ts", as_of=as_of(), days=45)


@query("retained_progress", f"SELECT * FROM progress WHERE last_updated >= {NOW} - INTERVAL 7 DAYS")
def _(v):
    return maintenance.kept_rows(v.progress, "last_updated", as_of=as_of(), days=maintenance.MIRROR_STATE_DAYS)


@query("gaps_after_cleanup", f"SELECT * FROM gaps WHERE NOT (detected_at < {NOW} - INTERVAL 7 DAYS AND resolution_status = 'resolved')")
def _(v):
    return maintenance.without_old_resolved_gaps(v.gaps, as_of=as_of(), days=7)


@query("retained_snapshot_clusters", TREE + f"""
SELECT c.* FROM inv_clusters c WHERE snapshot_id IN (SELECT snapshot_id FROM snapshots WHERE created_at >= {NOW} - INTERVAL 30 DAYS)""")
def _(v):
    snapshots, clusters, _, _ = inventory_tables(v)
    kept = maintenance.kept_rows(snapshots, "created_at", as_of=as_of(), days=30)
    return maintenance.with_parent(clusters, kept, "snapshot_id")


@query("merged_progress", """
SELECT t.* FROM progress t JOIN (SELECT job_id, source_topic, partition_id, max(last_updated) AS last_updated FROM progress GROUP BY 1, 2, 3)
USING (job_id, source_topic, partition_id, last_updated)""")
def _(v):
    old, new = v.progress.filter("last_updated < DATE'2024-01-20'"), v.progress.filter("last_updated >= DATE'2024-01-20'")
    return maintenance.merged(old, new, ["job_id", "source_topic", "partition_id"], ["last_updated"])


@query("resolved_gap_updates", f"""
SELECT job_id, source_topic, target_topic, partition_id, gap_start_offset, gap_end_offset, gap_size, detected_at,
  CASE WHEN gap_size <= 7 THEN 'resolved' ELSE resolution_status END AS resolution_status,
  CASE WHEN gap_size <= 7 THEN 'replayed' END AS resolution_method, CASE WHEN gap_size <= 7 THEN {NOW} END AS resolved_at FROM gaps""")
def _(v):
    keys = ["job_id", "source_topic", "partition_id", "detected_at"]
    small = v.gaps.filter("gap_size <= 7").select(*keys, F.lit("replayed").alias("method"), as_of().alias("resolved_at"))
    return maintenance.resolve_gaps(v.gaps, small, keys)


@query("validated_resume_points", """
SELECT job_id, source_topic, partition_id, safe_resume_offset, calculated_at, 'validated' AS validation_status FROM resume""")
def _(v):
    return maintenance.validate_resume_points(v.resume)


@query("recalculated_resume_points", """
SELECT * FROM resume WHERE calculated_at <= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 1 HOUR
UNION ALL SELECT job_id, source_topic, partition_id, safe_resume_offset + 1, DATE '2024-01-30', validation_status FROM resume
  WHERE calculated_at = DATE '2024-01-30'""")
def _(v):
    fresh = v.resume.filter("calculated_at = DATE'2024-01-30'").withColumn("safe_resume_offset", F.col("safe_resume_offset") + 1)
    at = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return maintenance.replace_recent(v.resume, fresh, as_of=at)


# --- payloads and JSON columns ------------------------------------------------------------------------

FLAGGED = """
WITH flagged AS (SELECT *, current_lag > 200 AS critical_lag,
    error_count > 0 AND messages_replicated > 0
      AND CAST(error_count AS DOUBLE) > messages_replicated * CAST(0.1 AS DOUBLE) AS high_error_rate,
    tick > 6 AND messages_consumed = 0 AS source_stalled,
    tick > 6 AND messages_consumed > 0 AND messages_replicated = 0 AS target_stalled, error_count > 0 AS error_spike
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS tick FROM raw_metrics))
"""
KEY = ("job_id", "event_id", "ts")


def _flagged(v: Views):
    return detect.flagged_samples(v.raw_metrics, order=ORDER)


@query("gauge_rows", FLAGGED + """
SELECT job_id, event_id, ts, 'relaylens_' || name AS metric, value FROM (
  UNPIVOT (SELECT job_id, event_id, ts, messages_replicated::DOUBLE AS messages_replicated, bytes_transferred::DOUBLE AS bytes_transferred,
    messages_consumed::DOUBLE AS messages_consumed, bytes_consumed::DOUBLE AS bytes_consumed, current_lag::DOUBLE AS current_lag,
    error_count::DOUBLE AS error_count, source_stalled::INT::DOUBLE AS incident_source_stalled,
    target_stalled::INT::DOUBLE AS incident_target_stalled, critical_lag::INT::DOUBLE AS incident_critical_lag,
    high_error_rate::INT::DOUBLE AS incident_high_error_rate, error_spike::INT::DOUBLE AS incident_error_spike FROM flagged)
  ON COLUMNS(* EXCLUDE (job_id, event_id, ts)) INTO NAME name VALUE value)""")
def _(v):
    return payloads.gauges(_flagged(v), key=KEY)


@query("log_stream_lines", FLAGGED + """
SELECT job_id, event_id, ts, CAST(epoch_us(ts) * 1000 AS VARCHAR) AS ts_ns,
  'messages_replicated=' || messages_replicated || ' bytes_transferred=' || bytes_transferred || ' messages_consumed=' || messages_consumed
  || ' bytes_consumed=' || bytes_consumed || ' current_lag=' || current_lag || ' error_count=' || error_count
  || ' source_stalled=' || source_stalled || ' target_stalled=' || target_stalled || ' critical_lag=' || critical_lag
  || ' high_error_rate=' || high_error_rate || ' error_spike=' || error_spike AS line FROM flagged""")
def _(v):
    return payloads.log_stream_lines(_flagged(v), key=KEY)


@query("event_envelopes", FLAGGED + """
SELECT job_id, event_id, ts, CAST(to_json({'job_id': job_id, 'messages_replicated': messages_replicated,
    'bytes_transferred': bytes_transferred, 'messages_consumed': messages_consumed, 'bytes_consumed': bytes_consumed,
    'current_lag': current_lag, 'error_count': error_count, 'source_stalled': source_stalled, 'target_stalled': target_stalled,
    'critical_lag': critical_lag, 'high_error_rate': high_error_rate, 'error_spike': error_spike}) AS VARCHAR) AS event,
  'relaylens' AS source, '_json' AS sourcetype, 'main' AS index FROM flagged""")
def _(v):
    return payloads.event_envelopes(_flagged(v), key=KEY)


@query("json_columns", """
SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, 1 AS entries, '{"k":' || (props->>'k') || '}' AS rewritten FROM events""")
def _(v):
    decoded = v.events.withColumn("decoded", long_map("props"))
    return decoded.select(
        "event_id", F.element_at("decoded", "k").alias("k"), F.size("decoded").alias("entries"),
        sorted_map_json(F.col("decoded")).alias("rewritten"),
    )


@query("broker_arrays", """
SELECT topic_name, partition_id, replica_id, list_contains(CAST(isr_ids AS JSON)::INTEGER[], replica_id) AS in_sync
FROM (SELECT topic_name, partition_id, isr_ids, unnest(CAST(replica_ids AS JSON)::INTEGER[]) AS replica_id FROM partitions_inv)""")
def _(v):
    decoded = v.partitions_inv.select(
        "topic_name", "partition_id", F.explode(int_array("replica_ids")).alias("replica_id"), int_array("isr_ids").alias("isr")
    )
    return decoded.select("topic_name", "partition_id", "replica_id", F.array_contains("isr", F.col("replica_id")).alias("in_sync"))
