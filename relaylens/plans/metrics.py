"""Queries over metric samples and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylens.functions.timeline import block_of
from relaylens.operators import detect, metrics
from relaylens.plans.bindings import as_of
from relaylens.plans.registry import query

ORDER = ("ts", "event_id")
POINT_COLUMNS = """event_id, job_id, ts, messages_replicated_delta, bytes_transferred_delta,
  messages_consumed_delta, bytes_consumed_delta, error_count_delta, avg_lag"""
NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@query("counter_deltas", """
SELECT event_id, job_id, ts,
  CASE WHEN a < pa THEN a ELSE a - coalesce(pa, 0) END AS messages_replicated_delta,
  CASE WHEN b < pb THEN b ELSE b - coalesce(pb, 0) END AS bytes_transferred_delta,
  CASE WHEN c < pc THEN c ELSE c - coalesce(pc, 0) END AS messages_consumed_delta,
  CASE WHEN d < pd THEN d ELSE d - coalesce(pd, 0) END AS bytes_consumed_delta,
  CASE WHEN e < pe THEN e ELSE e - coalesce(pe, 0) END AS error_count_delta,
  current_lag AS avg_lag
FROM (SELECT *, messages_replicated AS a, bytes_transferred AS b, messages_consumed AS c, bytes_consumed AS d,
        error_count AS e, lag(messages_replicated) OVER w AS pa, lag(bytes_transferred) OVER w AS pb,
        lag(messages_consumed) OVER w AS pc, lag(bytes_consumed) OVER w AS pd, lag(error_count) OVER w AS pe
      FROM raw_metrics WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
""")
def _(v):
    return metrics.counter_deltas(v.raw_metrics, order=ORDER)


@query("counter_deltas_against_total", """
WITH RECURSIVE numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn FROM raw_metrics),
walk AS (
  SELECT rn, job_id, event_id, ts, current_lag,
    messages_replicated AS t1, bytes_transferred AS t2, messages_consumed AS t3, bytes_consumed AS t4, error_count AS t5,
    messages_replicated AS d1, bytes_transferred AS d2, messages_consumed AS d3, bytes_consumed AS d4, error_count AS d5
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.rn, n.job_id, n.event_id, n.ts, n.current_lag,
    CASE WHEN n.messages_replicated >= t1 THEN n.messages_replicated ELSE t1 + n.messages_replicated END,
    CASE WHEN n.bytes_transferred >= t2 THEN n.bytes_transferred ELSE t2 + n.bytes_transferred END,
    CASE WHEN n.messages_consumed >= t3 THEN n.messages_consumed ELSE t3 + n.messages_consumed END,
    CASE WHEN n.bytes_consumed >= t4 THEN n.bytes_consumed ELSE t4 + n.bytes_consumed END,
    CASE WHEN n.error_count >= t5 THEN n.error_count ELSE t5 + n.error_count END,
    CASE WHEN n.messages_replicated >= t1 THEN n.messages_replicated - t1 ELSE n.messages_replicated END,
    CASE WHEN n.bytes_transferred >= t2 THEN n.bytes_transferred - t2 ELSE n.bytes_transferred END,
    CASE WHEN n.messages_consumed >= t3 THEN n.messages_consumed - t3 ELSE n.messages_consumed END,
    CASE WHEN n.bytes_consumed >= t4 THEN n.bytes_consumed - t4 ELSE n.bytes_consumed END,
    CASE WHEN n.error_count >= t5 THEN n.error_count - t5 ELSE n.error_count END
  FROM walk JOIN numbered n ON n.job_id = walk.job_id AND n.rn = walk.rn + 1)
SELECT event_id, job_id, ts, d1 AS messages_replicated_delta, d2 AS bytes_transferred_delta,
  d3 AS messages_consumed_delta, d4 AS bytes_consumed_delta, d5 AS error_count_delta, current_lag AS avg_lag FROM walk
""")
def _(v):
    return metrics.counter_deltas_against_total(v.raw_metrics, order=ORDER)


@query("current_totals", """
SELECT j.job_id, CAST(coalesce(sum(messages_replicated_delta), 0) AS BIGINT) AS messages_replicated,
  CAST(coalesce(sum(bytes_transferred_delta), 0) AS BIGINT) AS bytes_transferred,
  CAST(coalesce(sum(messages_consumed_delta), 0) AS BIGINT) AS messages_consumed,
  CAST(coalesce(sum(bytes_consumed_delta), 0) AS BIGINT) AS bytes_consumed,
  CAST(coalesce(sum(error_count_delta), 0) AS BIGINT) AS error_count,
  coalesce(arg_max(avg_lag, event_id), 0) AS current_lag, max(ts) AS last_sample_at
FROM jobs j LEFT JOIN metric_points m ON j.job_id = m.job_id GROUP BY j.job_id
""")
def _(v):
    return metrics.current_totals(v.metric_points, v.jobs, order=ORDER)


ROLLUP = """
SELECT job_id, strftime(ts, '{fmt}') AS period, CAST(sum(messages_replicated_delta) AS BIGINT) AS messages_total,
  round(CAST(sum(avg_lag) AS DOUBLE) / count(avg_lag), 6) AS avg_lag, CAST(sum(error_count_delta) AS BIGINT) AS total_errors
FROM metric_points WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 30 DAYS GROUP BY 1, 2
"""


@query("rollup_hourly", ROLLUP.format(fmt="%Y-%m-%d %H:00:00"))
def _(v):
    return metrics.rollup(v.metric_points, "hourly", as_of=as_of(), days=30)


@query("rollup_daily", ROLLUP.format(fmt="%Y-%m-%d"))
def _(v):
    return metrics.rollup(v.metric_points, "daily", as_of=as_of(), days=30)


@query("downsample_by_minute", """
SELECT job_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS minute,
  max(messages_replicated) - min(messages_replicated) AS messages_replicated_delta,
  max(bytes_transferred) - min(bytes_transferred) AS bytes_transferred_delta,
  max(messages_consumed) - min(messages_consumed) AS messages_consumed_delta,
  max(bytes_consumed) - min(bytes_consumed) AS bytes_consumed_delta,
  max(error_count) - min(error_count) AS error_count_delta,
  round(CAST(sum(current_lag) AS DOUBLE) / count(current_lag), 6) AS avg_lag
FROM raw_metrics GROUP BY 1, 2
""")
def _(v):
    return metrics.downsample_by_minute(v.raw_metrics)


@query("recent_metric_summary", f"""
SELECT job_id, CAST(sum(messages_replicated_delta) AS BIGINT) AS total_messages,
  CAST(sum(bytes_transferred_delta) AS BIGINT) AS total_bytes,
  round(CAST(sum(messages_replicated_delta) AS DOUBLE) / 259200.0, 6) AS avg_throughput, max(avg_lag) AS max_lag,
  CAST(sum(error_count_delta) AS BIGINT) AS total_errors, count(*) AS data_points, max(ts) AS latest
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn FROM metric_points
      WHERE ts >= {NOW} - INTERVAL 4320 MINUTES AND ts <= {NOW})
WHERE rn <= 100 GROUP BY job_id
""")
def _(v):
    return metrics.recent_summary(v.metric_points, as_of=as_of(), minutes=4320, order=ORDER)


for _span, _interval in (("2h", "2 HOURS"), ("24h", "24 HOURS"), ("7d", "7 DAYS"), ("30d", "30 DAYS")):
    @query(f"metric_history_{_span}", f"""
    SELECT {POINT_COLUMNS} FROM metric_points
    WHERE ts BETWEEN {NOW} - INTERVAL {_interval} AND {NOW} ORDER BY ts
    """)
    def _(v, span=_span):
        return metrics.history(v.metric_points, as_of=as_of(), span=span)


@query("newest_points_per_job", f"""
SELECT {POINT_COLUMNS}, newest_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS newest_rank FROM metric_points)
WHERE newest_rank <= 20
""")
def _(v):
    return metrics.newest_per_job(v.metric_points, 20, order=ORDER).withColumn(
        "newest_rank", F.col("newest_rank").cast("long")
    )


@query("traffic_counters", """
SELECT job_id, count(*) AS records_consumed, CAST(sum(strlen(rec_value) + strlen(rec_key)) AS BIGINT) AS bytes_consumed,
  count(*) FILTER (WHERE NOT send_failed) AS records_produced,
  CAST(coalesce(sum(strlen(rec_value) + strlen(rec_key)) FILTER (WHERE NOT send_failed), 0) AS BIGINT) AS bytes_produced,
  count(*) FILTER (WHERE send_failed) AS error_count
FROM records GROUP BY job_id
""")
def _(v):
    return metrics.traffic(v.records)


@query("job_health", """
SELECT job_id, error_count, current_lag,
  CASE WHEN error_count > 0 THEN 'errors' WHEN current_lag > 10000 THEN 'high_lag' ELSE 'healthy' END AS health
FROM (SELECT j.job_id, CAST(coalesce(sum(error_count_delta), 0) AS BIGINT) AS error_count,
        coalesce(arg_max(avg_lag, event_id), 0) AS current_lag
      FROM jobs j LEFT JOIN metric_points m ON j.job_id = m.job_id GROUP BY j.job_id)
""")
def _(v):
    return metrics.job_health(metrics.current_totals(v.metric_points, v.jobs, order=ORDER))


@query("metric_anomalies", f"""
WITH h AS (
  SELECT job_id, count(*) AS points,
    CAST(sum(m) FILTER (WHERE rn <= n // 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE rn <= n // 2), 0) AS recent_throughput,
    CAST(sum(m) FILTER (WHERE rn > n // 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE rn > n // 2), 0) AS baseline_throughput,
    CAST(sum(lag) FILTER (WHERE rn <= n // 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE rn <= n // 2), 0) AS recent_lag,
    CAST(sum(lag) FILTER (WHERE rn > n // 2) AS DOUBLE) / nullif(count(*) FILTER (WHERE rn > n // 2), 0) AS baseline_lag,
    CAST(sum(m) AS BIGINT) AS messages, CAST(sum(e) AS BIGINT) AS errors
  FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM (
          SELECT job_id, messages_replicated_delta AS m, avg_lag AS lag, error_count_delta AS e,
            row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn
          FROM metric_points WHERE ts > {NOW} - INTERVAL 7 DAYS AND ts <= {NOW}) WHERE rn <= 10)
  GROUP BY job_id)
SELECT * REPLACE (round(recent_throughput, 6) AS recent_throughput, round(baseline_throughput, 6) AS baseline_throughput,
  round(recent_lag, 6) AS recent_lag, round(baseline_lag, 6) AS baseline_lag), CASE WHEN points < 3 THEN 'none'
  WHEN recent_throughput = 0 AND baseline_throughput > 0 THEN 'zero_throughput'
  WHEN baseline_throughput > 0 AND (baseline_throughput - recent_throughput) / baseline_throughput > CAST(0.3 AS DOUBLE) THEN 'throughput_drop'
  WHEN (baseline_lag > 0 AND recent_lag > baseline_lag * 2) OR recent_lag > 1000 THEN 'lag_spike'
  WHEN CASE WHEN messages = 0 THEN errors > 0 ELSE 100.0 * errors / messages > 0.5 END THEN 'high_error_rate'
  ELSE 'none' END AS anomaly_kind FROM h
""")
def _(v):
    return detect.anomalies(v.metric_points, as_of=as_of(), span="INTERVAL 7 DAYS", order=ORDER)


@query("zero_throughput_advice", f"""
SELECT job_id, 'recommendation' AS insight_type, 'high' AS severity_level, 'system-rule' AS ai_model,
  'Zero throughput detected. Consider using ''jobs restart-force'' to recover the job.' AS recommendation
FROM (SELECT job_id, sum(m) AS m, sum(e) AS e, count(*) AS n, avg(lag) FILTER (WHERE rn <= c // 2) AS new_lag,
    avg(lag) FILTER (WHERE rn > c // 2) AS old_lag
  FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS c FROM (
    SELECT job_id, messages_replicated_delta AS m, avg_lag AS lag, error_count_delta AS e,
      row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM metric_points WHERE ts > {NOW} - INTERVAL 7 DAYS AND ts <= {NOW}) WHERE rn <= 10) GROUP BY job_id)
WHERE n >= 3 AND m = 0 AND (e > 0 OR new_lag > 1000 OR (old_lag > 0 AND new_lag > 2 * old_lag))
""")
def _(v):
    found = detect.anomalies(v.metric_points, as_of=as_of(), span="INTERVAL 7 DAYS", order=ORDER)
    return detect.zero_throughput_advice(found)


INCIDENTS = """
WITH f AS (
  SELECT *, current_lag > 200 AS critical_lag,
    error_count > 0 AND messages_replicated > 0
      AND CAST(error_count AS DOUBLE) > messages_replicated * CAST(0.1 AS DOUBLE) AS high_error_rate,
    tick > 6 AND messages_consumed = 0 AS source_stalled,
    tick > 6 AND messages_consumed > 0 AND messages_replicated = 0 AS target_stalled,
    {spike} AS error_spike
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS tick FROM raw_metrics)),
l AS (
  UNPIVOT f ON critical_lag, high_error_rate, source_stalled, target_stalled, error_spike INTO NAME incident VALUE flag),
e AS (SELECT *, coalesce(lag(flag) OVER (PARTITION BY job_id, incident ORDER BY tick), false) AS was FROM l)
SELECT job_id, ts, event_id, tick, incident, CASE WHEN flag THEN 'raised' ELSE 'resolved' END AS transition
FROM e WHERE (flag AND NOT was) OR (was AND NOT flag AND incident IN ('source_stalled', 'target_stalled'))
"""


@query("incidents", INCIDENTS.format(spike="error_count > 0"))
def _(v):
    return detect.incidents(v.raw_metrics, order=ORDER)


@query("incidents_rearmed", INCIDENTS.format(spike="error_count > 0 AND tick % 3 = 0"))
def _(v):
    return detect.incidents(v.raw_metrics, rearm_every=3, order=ORDER)


@query("milestones", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS tick FROM raw_metrics)
SELECT job_id, ts, event_id, tick, milestone, total FROM (
  SELECT *, messages_consumed AS total, CASE WHEN messages_consumed = 1 AND tick <= 2 THEN 'first_consumed'
    WHEN messages_consumed > 0 AND messages_consumed % 100 = 0 THEN 'consumed_milestone' END AS milestone FROM t
  UNION ALL
  SELECT *, messages_replicated, CASE WHEN messages_replicated = 1 AND tick <= 2 THEN 'first_produced'
    WHEN messages_replicated > 0 AND messages_replicated % 100 = 0 THEN 'produced_milestone' END FROM t)
WHERE milestone IS NOT NULL
""")
def _(v):
    return detect.milestones(v.raw_metrics, order=ORDER)


@query("failure_runs", """
SELECT job_id, max(run) AS longest_failure_run, count(*) FILTER (WHERE run > 0) AS failure_runs, max(run) > 100 AS must_stop
FROM (SELECT job_id, island, count(*) FILTER (WHERE send_failed) AS run FROM (
  SELECT *, sum(CASE WHEN send_failed THEN 0 ELSE 1 END) OVER (PARTITION BY job_id ORDER BY event_id) AS island FROM records)
  GROUP BY job_id, island) GROUP BY job_id
""")
def _(v):
    return detect.failure_runs(v.records, order=["event_id"], chunk=block_of("event_id"))


@query("metric_changes", """
SELECT job_id, ts, event_id, messages_replicated_delta, avg_lag, error_count_delta FROM (
  SELECT *, lag(messages_replicated_delta) OVER w AS p1, lag(avg_lag) OVER w AS p2, lag(error_count_delta) OVER w AS p3
  FROM metric_points WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id))
WHERE messages_replicated_delta IS DISTINCT FROM p1 OR avg_lag IS DISTINCT FROM p2 OR error_count_delta IS DISTINCT FROM p3
""")
def _(v):
    return detect.metric_changes(v.metric_points, order=ORDER)


@query("analysis_gate", """
SELECT job_id, make_timestamp((slot + 1) * 300000000) AS tick_at, m AS messages_replicated_delta, l AS avg_lag, e AS error_count_delta
FROM (SELECT *, lag((m, l, e)) OVER (PARTITION BY job_id ORDER BY slot) AS before FROM (
  SELECT job_id, epoch_us(ts) // 300000000 AS slot, arg_max(messages_replicated_delta, event_id) AS m,
    arg_max(avg_lag, event_id) AS l, arg_max(error_count_delta, event_id) AS e FROM metric_points GROUP BY 1, 2))
WHERE (m, l, e) IS DISTINCT FROM before
""")
def _(v):
    return detect.analysis_gate(v.metric_points, order=ORDER)


@query("series_statistics", f"""
SELECT job_id, points, avg_throughput, min_throughput, max_throughput, avg_lag, min_lag, max_lag, total_errors,
  CASE WHEN s2 > 1.2::DOUBLE * (s1::DOUBLE * n2 / nullif(n1, 0)) THEN 'increasing'
       WHEN s2 < 0.8::DOUBLE * (s1::DOUBLE * n2 / nullif(n1, 0)) THEN 'decreasing' ELSE 'stable' END AS trend
FROM (SELECT job_id, count(*) AS points, CAST(sum(m) // count(*) AS BIGINT) AS avg_throughput, min(m) AS min_throughput,
    max(m) AS max_throughput, CAST(sum(lag) // count(*) AS BIGINT) AS avg_lag, min(lag) AS min_lag, max(lag) AS max_lag,
    CAST(sum(e) AS BIGINT) AS total_errors, coalesce(sum(m) FILTER (WHERE rn <= n // 2), 0) AS s1,
    coalesce(sum(m) FILTER (WHERE rn > n // 2), 0) AS s2, count(*) FILTER (WHERE rn <= n // 2) AS n1,
    count(*) FILTER (WHERE rn > n // 2) AS n2
  FROM (SELECT job_id, messages_replicated_delta AS m, avg_lag AS lag, error_count_delta AS e,
      row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY job_id) AS n
    FROM metric_points WHERE ts > {NOW} - INTERVAL 15 DAYS AND ts <= {NOW}) GROUP BY job_id)
""")
def _(v):
    return detect.series_statistics(v.metric_points, as_of=as_of(), span="INTERVAL 15 DAYS", order=ORDER)


@query("metric_severity", f"""
SELECT *, CASE WHEN (CASE WHEN messages = 0 THEN errors > 0 ELSE 100.0 * errors / messages > 5 END) OR max_lag > 10000 THEN 'high'
  WHEN (CASE WHEN messages = 0 THEN errors > 0 ELSE 100.0 * errors / messages > 1 END) OR max_lag > 5000 THEN 'medium'
  ELSE 'info' END AS severity
FROM (SELECT job_id, CAST(sum(error_count_delta) AS BIGINT) AS errors, CAST(sum(messages_replicated_delta) AS BIGINT) AS messages,
    max(avg_lag) AS max_lag FROM metric_points WHERE ts > {NOW} - INTERVAL 2 DAYS AND ts <= {NOW} GROUP BY job_id)
""")
def _(v):
    return detect.severity(v.metric_points, as_of=as_of(), span="INTERVAL 2 DAYS")


@query("throttling_advice", f"""
WITH s AS (
  SELECT job_id, count(*) AS points, round(CAST(sum(m) AS DOUBLE) / count(*), 6) AS throughput,
    round(CAST(sum(l) AS DOUBLE) / count(*), 6) AS lag, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(m) AS BIGINT) AS messages
  FROM (SELECT job_id, messages_replicated_delta AS m, avg_lag AS l, error_count_delta AS e,
      row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM metric_points WHERE ts > {NOW} - INTERVAL 5 DAYS AND ts <= {NOW}) WHERE rn <= 20 GROUP BY job_id),
r AS (
  SELECT s.*, CAST(batch_size AS BIGINT) AS b, CAST(parallelism AS BIGINT) AS p,
    CASE WHEN messages = 0 THEN NULL ELSE 100.0 * errors / messages END AS rate
  FROM s JOIN jobs USING (job_id) WHERE points >= 5),
o AS (
  SELECT *, CASE WHEN least(floor(b * 1.5::DOUBLE), 10000) <= b THEN b + 500 ELSE least(floor(b * 1.5::DOUBLE), 10000) END AS ub,
    least(p + 2, 20) AS up,
    greatest(CASE WHEN greatest(floor(b * 0.7::DOUBLE), 100) >= b THEN b - 200 ELSE greatest(floor(b * 0.7::DOUBLE), 100) END, 1) AS db,
    greatest(p - 1, 1) AS dp,
    CASE WHEN throughput < 50 THEN greatest(100, b // 2) ELSE least(5000, b + 300) END AS ob FROM r),
a AS (
  SELECT *, CASE WHEN lag > 5000 AND coalesce(rate < 1.0, false) AND (ub <> b OR up <> p) THEN 'increase'
    WHEN coalesce(rate > 2.0, errors > 0) AND (db <> b OR dp <> p) THEN 'decrease'
    WHEN throughput < 100 AND lag < 1000 AND coalesce(rate < 0.5, false) AND ob <> b THEN 'optimise' END AS action FROM o)
SELECT job_id, points, throughput, lag, errors, messages, action,
  CAST(CASE action WHEN 'increase' THEN ub WHEN 'decrease' THEN db ELSE ob END AS BIGINT) AS new_batch_size,
  CAST(CASE action WHEN 'increase' THEN up WHEN 'decrease' THEN dp ELSE p END AS BIGINT) AS new_parallelism,
  CAST(CASE action WHEN 'increase' THEN 0.8 WHEN 'decrease' THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
  action <> 'optimise' AND job_id NOT IN (SELECT job_id FROM insights WHERE insight_type = 'throttling_adjustment'
    AND ts > {NOW} - INTERVAL 26 HOURS AND ts <= {NOW}) AS apply_now
FROM a WHERE action IS NOT NULL
""")
def _(v):
    return detect.throttling_advice(
        v.metric_points, v.jobs, v.insights, as_of=as_of(), span="INTERVAL 5 DAYS", cooldown="INTERVAL 26 HOURS", order=ORDER
    )
