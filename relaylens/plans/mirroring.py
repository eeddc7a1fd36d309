"""Queries over mapping rules, records and offsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaylens.operators import compare, mapping, progress
from relaylens.plans.bindings import Views, as_of
from relaylens.plans.registry import query

NOW = "TIMESTAMP '2024-01-31 00:00:00'"

# The rules of the test views applied to the topic listing, in DuckDB text.
RESOLVED = r"""
WITH r AS MATERIALIZED (SELECT *, regexp_matches(source_pattern, '[.*+?{}()\[\]^$]') AS is_re FROM rules WHERE enabled),
matches AS MATERIALIZED (
  SELECT job_id, rule_pos, source_pattern, topic, CASE WHEN target_pattern = '' THEN topic
    ELSE regexp_replace(topic, source_pattern, replace(target_pattern, '$1', '\1'), 'g') END AS target_topic
  FROM r JOIN topic_listing ON regexp_matches(topic, source_pattern) WHERE is_re),
resolved AS MATERIALIZED (
  SELECT job_id, topic, target_topic, min(rule_pos) AS rule_pos FROM (
    SELECT job_id, rule_pos, source_pattern AS topic,
      CASE WHEN target_pattern = '' THEN source_pattern ELSE target_pattern END AS target_topic FROM r WHERE NOT is_re
    UNION ALL SELECT job_id, rule_pos, topic, target_topic FROM matches) GROUP BY 1, 2, 3),
topic_map AS MATERIALIZED (SELECT job_id, topic, arg_min(target_topic, rule_pos) AS target_topic FROM resolved GROUP BY 1, 2)
"""

TARGET_PARTITIONS = "SELECT topic AS target_topic, max(partition_id) + 1 AS partitions FROM target_records GROUP BY 1"

COMPARISON = RESOLVED + """,
src AS MATERIALIZED (SELECT topic, partition_id, max(rec_offset) AS o, max(rec_offset) + 1 AS h FROM records GROUP BY 1, 2),
tgt AS MATERIALIZED (SELECT topic, partition_id, max(rec_offset) AS o, max(rec_offset) + 1 AS h FROM target_records GROUP BY 1, 2),
cmp AS MATERIALIZED (
  SELECT m.job_id, m.topic AS source_topic, m.target_topic, src.partition_id, src.o AS source_offset,
    coalesce(tgt.o, -1) AS target_offset, src.h AS source_high_water_mark, coalesce(tgt.h, 0) AS target_high_water_mark,
    src.h - coalesce(tgt.h, 0) AS gap, coalesce(tgt.h, 0) AS safe_resume_offset,
    tgt.h IS NULL OR src.h > tgt.h AS has_gap, tgt.h IS NULL AS target_missing
  FROM topic_map m JOIN src ON src.topic = m.topic
  LEFT JOIN tgt ON tgt.topic = m.target_topic AND tgt.partition_id = src.partition_id),
topics AS MATERIALIZED (
  SELECT job_id, source_topic, target_topic, count(*) AS partitions, count(*) FILTER (WHERE has_gap) AS gaps_detected,
    CAST(coalesce(sum(gap) FILTER (WHERE NOT target_missing), 0) AS BIGINT) AS total_lag,
    CAST(coalesce(sum(gap) FILTER (WHERE NOT target_missing AND gap > 0), 0) AS BIGINT) AS positive_lag,
    count(*) FILTER (WHERE target_missing) AS missing_partitions,
    coalesce(sum(gap) FILTER (WHERE NOT target_missing), 0) > 10000 AS high_lag
  FROM cmp GROUP BY 1, 2, 3),
job_cmp AS MATERIALIZED (
  SELECT m.job_id, count(partitions) AS topics_compared, CAST(coalesce(sum(gaps_detected), 0) AS BIGINT) AS gaps_detected,
    CAST(coalesce(sum(total_lag), 0) AS BIGINT) AS total_lag, CAST(coalesce(sum(positive_lag), 0) AS BIGINT) AS positive_lag,
    CAST(coalesce(sum(missing_partitions), 0) AS BIGINT) AS missing_partitions,
    count(*) FILTER (WHERE partitions IS NULL) AS critical_issues, count(*) FILTER (WHERE high_lag) AS warnings
  FROM topic_map m LEFT JOIN topics t ON t.job_id = m.job_id AND t.source_topic = m.topic AND t.target_topic = m.target_topic
  GROUP BY 1)
"""


def _resolved(v: Views):
    return mapping.resolve_mappings(v.topic_listing, v.rules)


def _topic_map(v: Views):
    return mapping.topic_map(_resolved(v))


def _target_partitions(v: Views):
    return v.target_records.groupBy(F.col("topic").alias("target_topic")).agg(
        (F.max("partition_id") + 1).alias("partitions")
    )


def _comparison(v: Views):
    return compare.compare_offsets(
        compare.high_water_marks(v.records), compare.high_water_marks(v.target_records), _topic_map(v)
    )


def _job_comparison(v: Views):
    return compare.job_comparison(_topic_map(v), compare.topic_comparison(_comparison(v)))


@query("resolve_mappings", RESOLVED + "SELECT job_id, topic, target_topic, rule_pos FROM resolved")
def _(v):
    return _resolved(v)


# Rules over the parts of a catalogue: characters that stand anywhere in a name, in classes, groups and alternatives, or nowhere for certain.
PART_RULES = (
    ("m0", 1, ".*-steel", "s-$1"), ("m0", 2, "^(.*)-(brushed|plated)-(.*)$", "$2.$3"), ("m1", 1, "ECONOMY.*[ct]o.*per", "e"), ("m1", 2, ".*", "all"),
    ("m2", 1, "x?nickel|tin$", "n"), ("m2", 2, "b[a-z]+d-.*", ""), ("m3", 1, "(small|large)-.*copper", "$1"), ("m3", 2, "q{1,2}uite", "none"),
)


@query("resolve_catalogue_mappings", "WITH names AS (SELECT DISTINCT replace(p_type, ' ', '-') AS topic FROM part UNION SELECT DISTINCT lower(replace(p_type, ' ', '-')) FROM part), r AS ("
       + " UNION ALL ".join(f"SELECT '{j}' AS job_id, {n} AS rule_pos, '{a}' AS pattern, '{b}' AS target" for j, n, a, b in PART_RULES) + r"""),
m AS (SELECT job_id, topic, rule_pos, CASE WHEN target = '' THEN topic ELSE
    regexp_replace(topic, pattern, regexp_replace(target, '\$([0-9])', '\\\1', 'g'), 'g') END AS target_topic FROM names JOIN r ON regexp_matches(topic, pattern))
SELECT job_id, topic, target_topic, CAST(min(rule_pos) AS INTEGER) AS rule_pos FROM m GROUP BY 1, 2, 3""")
def _(v):
    part = v.table("part").selectExpr("replace(p_type, ' ', '-') AS topic")
    names = part.unionByName(part.selectExpr("lower(topic) AS topic")).distinct()
    rules = v.spark.createDataFrame([(j, n, a, b, True) for j, n, a, b in PART_RULES], "job_id string, rule_pos int, source_pattern string, target_pattern string, enabled boolean")
    return mapping.resolve_mappings(names, rules)


@query("unmatched_rules", RESOLVED + """
SELECT job_id, rule_pos, source_pattern FROM r WHERE is_re AND NOT EXISTS (
  SELECT 1 FROM matches m WHERE m.job_id = r.job_id AND m.rule_pos = r.rule_pos)""")
def _(v):
    return mapping.unmatched_rules(v.topic_listing, v.rules)


@query("mapping_conflicts", RESOLVED + """
SELECT job_id, topic, target_topic, 'multiple_targets' AS conflict, n FROM (
  SELECT *, count(*) OVER (PARTITION BY job_id, topic) AS n FROM resolved) WHERE n > 1
UNION ALL SELECT job_id, topic, target_topic, 'multiple_sources', n FROM (
  SELECT *, count(*) OVER (PARTITION BY job_id, target_topic) AS n FROM resolved) WHERE n > 1
UNION ALL SELECT job_id, topic, target_topic, 'empty_target', 1 FROM resolved WHERE target_topic = ''""")
def _(v):
    return mapping.mapping_conflicts(_resolved(v))


@query("missing_source_topics", RESOLVED + """
SELECT job_id, topic, target_topic FROM resolved WHERE topic NOT IN (SELECT topic FROM topic_listing)""")
def _(v):
    return mapping.missing_source_topics(_resolved(v), v.topic_listing)


@query("newly_discovered_topics", RESOLVED + """
SELECT job_id, topic, arg_min(target_topic, rule_pos) AS target_topic FROM matches
WHERE topic = 'events-signup' AND (job_id, topic) NOT IN (
  SELECT (job_id, source_pattern) FROM r WHERE NOT is_re) GROUP BY 1, 2""")
def _(v):
    known = mapping.resolve_mappings(v.topic_listing.filter("topic <> 'events-signup'"), v.rules)
    return mapping.newly_discovered(v.topic_listing, v.rules, known)


@query("active_job_mappings", """
SELECT job_id, name, rule_pos, source_pattern, target_pattern FROM jobs JOIN rules USING (job_id)
WHERE status = 'active' AND enabled""")
def _(v):
    return mapping.active_mappings(v.jobs, v.rules)


@query("mirror_records", RESOLVED + f"""
SELECT s.job_id, m.target_topic AS topic, CASE WHEN s.partition_id < p.partitions THEN s.partition_id END AS partition_id,
  rec_key, rec_value, s.topic AS source_topic, s.partition_id AS source_partition, rec_offset AS source_offset
FROM records s JOIN topic_map m ON m.job_id = s.job_id AND m.topic = s.topic
LEFT JOIN ({TARGET_PARTITIONS}) p ON p.target_topic = m.target_topic""")
def _(v):
    return mapping.mirror(v.records, _topic_map(v), _target_partitions(v))


@query("rejected_records", RESOLVED + """
SELECT job_id, topic, event_id, partition_id, rec_offset, rec_key, rec_value, ts, send_failed FROM records s
WHERE NOT EXISTS (SELECT 1 FROM topic_map m WHERE m.job_id = s.job_id AND m.topic = s.topic)""")
def _(v):
    return mapping.rejected(v.records, _topic_map(v))


@query("message_size_tiers", """
SELECT topic, tier, count(*) AS messages, CAST(sum(bytes) AS BIGINT) AS bytes, max(bytes) AS largest,
  count(*) FILTER (WHERE bytes > 2048 OR rec_offset % 100 = 0) AS sampled
FROM (SELECT *, CASE WHEN bytes > 5120 THEN 'large' WHEN bytes > 2048 THEN 'medium' ELSE 'small' END AS tier
  FROM (SELECT topic, rec_offset, CAST(strlen(rec_key) + strlen(rec_value) AS BIGINT) AS bytes FROM doc_records) WHERE bytes > 0)
GROUP BY 1, 2""")
def _(v):
    return mapping.size_tiers(v.doc_records)


@query("offset_comparison", COMPARISON + "SELECT * FROM cmp")
def _(v):
    return _comparison(v)


@query("topic_comparison", COMPARISON + "SELECT * FROM topics")
def _(v):
    return compare.topic_comparison(_comparison(v))


@query("job_comparison", COMPARISON + "SELECT * FROM job_cmp")
def _(v):
    return _job_comparison(v)


@query("comparison_critical_issues", COMPARISON + """
SELECT m.job_id, m.topic AS source_topic, m.target_topic FROM topic_map m
WHERE NOT EXISTS (SELECT 1 FROM topics t WHERE t.job_id = m.job_id AND t.source_topic = m.topic)""")
def _(v):
    return compare.critical_issues(_topic_map(v), compare.topic_comparison(_comparison(v)))


@query("mirror_analysis", COMPARISON + """
SELECT job_id, 'gap_detection' AS analysis_type, topics_compared, gaps_detected, critical_issues AS critical_issues_count,
  warnings AS warning_issues_count, '[' || CASE WHEN gaps_detected > 0 THEN '"Found ' || gaps_detected ||
    ' replication gaps that need to be resolved before safe migration",' ELSE '' END ||
  CASE WHEN job_id IN (SELECT job_id FROM resume) THEN
    '"Consumer group offsets detected - can resume from last committed positions"' ELSE
    '"Consumer group has no committed offsets - replication will start from earliest/latest based on configuration"'
  END || ']' AS recommendations FROM job_cmp""")
def _(v):
    return compare.mirror_analysis(_job_comparison(v), v.resume)


@query("migration_verdict", COMPARISON + """
SELECT job_id, gaps_detected = 0 AND critical_issues = 0 AS migration_safe,
  CASE WHEN gaps_detected > 0 THEN 'high' WHEN warnings > 0 THEN 'medium' ELSE 'low' END AS risk_level,
  gaps_detected, critical_issues, warnings, CASE WHEN gaps_detected = 0 AND critical_issues = 0
  THEN '["Migration appears safe to proceed","Monitor replication closely after migration"]'
  ELSE '["Migration not recommended due to detected gaps or critical issues","Review offset comparison results and resolve gaps before migration"]'
  END AS recommendations FROM job_cmp""")
def _(v):
    return compare.migration_verdict(_job_comparison(v))


LAG = """SELECT {by}, CAST(sum(greatest(high_water_mark - coalesce(last_offset, -1) - 1, 0)) AS BIGINT) AS lag,
  count(*) AS partitions, count(*) FILTER (WHERE last_offset IS NULL) AS unread_partitions FROM offsets GROUP BY {by}"""


@query("consumer_lag_by_topic", LAG.format(by="topic"))
def _(v):
    return compare.consumer_lag(v.offsets, ["topic"])


@query("consumer_lag_by_partition", LAG.format(by="topic, partition_id"))
def _(v):
    return compare.consumer_lag(v.offsets, ["topic", "partition_id"])


@query("mapping_lag", RESOLVED + """
SELECT job_id, m.topic, target_topic, coalesce(lag, 0) AS lag FROM topic_map m LEFT JOIN (
  SELECT topic, CAST(sum(greatest(high_water_mark - coalesce(last_offset, -1) - 1, 0)) AS BIGINT) AS lag
  FROM offsets GROUP BY 1) o ON o.topic = m.topic""")
def _(v):
    return compare.mapping_lag(_topic_map(v), v.offsets)


@query("progress_status", COMPARISON + f"""
SELECT job_id, source_topic, target_topic, partition_id, source_offset, target_offset, source_high_water_mark,
  target_high_water_mark, target_offset AS last_replicated_offset, gap AS replication_lag, {NOW} AS last_updated,
  CASE WHEN gap = 0 THEN 'completed' WHEN gap > 10000 THEN 'error' ELSE 'active' END AS status FROM cmp""")
def _(v):
    return compare.progress_rows(_comparison(v), as_of=as_of())


@query("gap_rows", COMPARISON + f"""
SELECT job_id, source_topic, target_topic, partition_id, target_high_water_mark AS gap_start_offset,
  source_high_water_mark AS gap_end_offset, gap AS gap_size, {NOW} AS detected_at, 'offset_mismatch' AS gap_type,
  'unresolved' AS resolution_status FROM cmp WHERE has_gap AND gap > 0""")
def _(v):
    return compare.gap_rows(_comparison(v), as_of=as_of())


@query("resume_points", COMPARISON + f"""
SELECT job_id, source_topic, target_topic, partition_id, safe_resume_offset, {NOW} AS calculated_at,
  'pending' AS validation_status, safe_resume_offset > 0 AS gap_detected FROM cmp""")
def _(v):
    return compare.resume_points(_comparison(v), as_of=as_of())


@query("resume_target_lookup", RESOLVED + """
SELECT s.*, coalesce(m.target_topic, s.source_topic) AS target_topic FROM resume s
LEFT JOIN (SELECT job_id, topic, arg_min(target_topic, rule_pos) AS target_topic FROM resolved
  WHERE topic <> 'events-view' GROUP BY 1, 2) m ON m.job_id = s.job_id AND m.topic = s.source_topic""")
def _(v):
    return compare.with_target_topic(v.resume, _resolved(v).filter("topic <> 'events-view'"))


@query("offset_holes", """
SELECT topic, partition_id, before + 1 AS gap_start_offset, rec_offset AS gap_end_offset,
  rec_offset - before - 1 AS gap_size, 'missing_messages' AS gap_type
FROM (SELECT *, lag(rec_offset) OVER (PARTITION BY topic, partition_id ORDER BY rec_offset) AS before FROM target_records)
WHERE rec_offset - before > 1""")
def _(v):
    return compare.offset_holes(v.target_records)


@query("missing_at_target", """
SELECT topic, 'dr-' || substring(topic, 8) AS target_topic, partition_id, rec_offset FROM records s
WHERE NOT EXISTS (SELECT 1 FROM target_records t WHERE t.topic = 'dr-' || substring(s.topic, 8)
  AND t.partition_id = s.partition_id AND t.rec_offset = s.rec_offset)""")
def _(v):
    return compare.missing_at_target(v.records, v.target_records, _topic_map(v).filter("job_id = 'job-0'"))


@query("checkpoint_snapshot", """
SELECT topic, '{' || string_agg('"' || partition_id || '":' || (coalesce(last_offset, -1) + 1), ',' ORDER BY partition_id) || '}'
    AS source_consumer_group_offsets,
  '{' || string_agg('"' || partition_id || '":' || high_water_mark, ',' ORDER BY partition_id) || '}' AS target_high_water_marks,
  CAST(partition_id // 1000 AS BIGINT) AS page, count(*) AS partitions FROM offsets GROUP BY topic, page""")
def _(v):
    return compare.checkpoint_snapshot(v.offsets)


KEYS = "job_id, source_topic, partition_id"
LATEST_KEYED = """SELECT t.* FROM {view} t JOIN (SELECT {keys}, max({at}) AS {at} FROM {view} GROUP BY {keys}) USING ({keys}, {at})"""


@query("latest_progress_rows", LATEST_KEYED.format(view="progress", keys=KEYS, at="last_updated"))
def _(v):
    return progress.latest_rows(v.progress, progress.PARTITION_KEY, "last_updated")


@query("latest_resume_rows", LATEST_KEYED.format(view="resume", keys=KEYS, at="calculated_at"))
def _(v):
    return progress.latest_rows(v.resume, progress.PARTITION_KEY, "calculated_at")


@query("latest_gap_rows", LATEST_KEYED.format(view="gaps", keys=KEYS, at="detected_at"))
def _(v):
    return progress.latest_rows(v.gaps, progress.PARTITION_KEY, "detected_at")


@query("current_progress", LATEST_KEYED.format(view="progress", keys=KEYS, at="last_updated"))
def _(v):
    return progress.current_progress(v.progress)


@query("latest_resume_set", LATEST_KEYED.format(view="resume", keys="job_id", at="calculated_at"))
def _(v):
    return progress.latest_rows(v.resume, ["job_id"], "calculated_at")


@query("latest_analysis", "SELECT job_id, analyzed_at, CAST(gaps AS BIGINT) AS gaps FROM analyses t WHERE analyzed_at = (SELECT max(analyzed_at) FROM analyses)")
def _(v):
    return progress.newest_by_key(v.analyses, ["job_id"], ["analyzed_at"])


@query("latest_analysis_last_week", """
SELECT job_id, max(analyzed_at) AS analyzed_at, CAST(arg_max(gaps, analyzed_at) AS BIGINT) AS gaps FROM analyses
WHERE analyzed_at >= DATE '2024-01-22' AND analyzed_at < DATE '2024-01-29' GROUP BY job_id""")
def _(v):
    rows = progress.in_calendar_period(v.analyses, "analyzed_at", "last-week", as_of=as_of())
    return progress.newest_by_key(rows, ["job_id"], ["analyzed_at"])


# Read on Tuesday 30 January 2024, at noon.
for _period, _bounds in {
    "today": ">= DATE '2024-01-30'",
    "yesterday": "= DATE '2024-01-29'",
    "this-week": ">= DATE '2024-01-29'",
    "last-week": "BETWEEN DATE '2024-01-22' AND DATE '2024-01-28'",
}.items():
    @query(f"progress_{_period.replace('-', '_')}", f"SELECT * FROM progress WHERE last_updated {_bounds}")
    def _(v, period=_period):
        noon = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
        return progress.in_calendar_period(v.progress, "last_updated", period, as_of=noon)


@query("unresolved_gaps", "SELECT * FROM gaps WHERE resolution_status = 'unresolved'")
def _(v):
    return progress.unresolved_gaps(v.gaps)


@query("progress_listing", "SELECT * FROM progress")
def _(v):
    return progress.progress_listing(v.progress)


@query("topic_progress_listing", "SELECT * FROM progress WHERE source_topic = 'events-click'")
def _(v):
    return progress.progress_listing(v.progress, topic="events-click")


@query("resume_points_newest_first", "SELECT * FROM resume")
def _(v):
    return progress.newest_first(v.resume, ["calculated_at"])


@query("newest_gaps", """SELECT * FROM gaps ORDER BY detected_at DESC, source_topic DESC, partition_id DESC LIMIT 50""")
def _(v):
    return progress.newest_first(v.gaps, ["detected_at", "source_topic", "partition_id"], limit=50)


@query("newest_analyses", "SELECT job_id, analyzed_at, CAST(gaps AS BIGINT) AS gaps FROM analyses ORDER BY analyzed_at DESC LIMIT 10")
def _(v):
    return progress.newest_first(v.analyses, ["analyzed_at"], limit=10)
