import json

import pytest
from pyspark.sql import functions as F

from relaylens.operators import audit, compliance, inventory, logs
from tests.conftest import at

SCHEDULE = [
    ("daily", "2024-01-10T06:00:00", "2024-01-09T06:00:00", True), ("daily", "2024-01-10T06:00:00", "2024-01-10T01:00:00", False),
    ("daily", "2024-01-10T07:00:00", "2024-01-09T06:00:00", False), ("weekly", "2024-01-08T06:00:00", "2024-01-01T06:00:00", True),
    ("weekly", "2024-01-09T06:00:00", "2024-01-01T06:00:00", False), ("weekly", "2024-01-08T06:00:00", "2024-01-08T02:00:00", False),
    ("monthly", "2024-02-01T06:00:00", "2024-01-01T06:00:00", True), ("monthly", "2024-02-02T06:00:00", "2024-01-01T06:00:00", False),
    ("monthly", "2024-02-01T06:00:00", "2024-02-01T01:00:00", False), ("yearly", "2024-02-01T06:00:00", "2023-02-01T01:00:00", False),
    ("weekly", "2024-12-30T06:00:00", "2025-01-01T06:00:00", False),
]


@pytest.mark.parametrize("period,now,last,due", SCHEDULE)
def test_schedule(spark, period, now, last, due):
    df = spark.createDataFrame([(period, at(now), at(last))], "period string, now_ts timestamp_ntz, last_run timestamp_ntz")
    assert (compliance.due_reports(df, run_hour=6).count() == 1) is due


@pytest.mark.parametrize("denied,errors,score,status", [
    (0, 0.0, 100.0, "COMPLIANT"), (20, 0.0, 90.0, "COMPLIANT"), (21, 0.0, 89.5, "ATTENTION_REQUIRED"),
    (60, 0.0, 70.0, "ATTENTION_REQUIRED"), (0, 3.5, 65.0, "NON_COMPLIANT"), (500, 50.0, 0.0, "NON_COMPLIANT"),
])
def test_health_bands(spark, denied, errors, score, status):
    df = spark.createDataFrame([(denied, errors)], "permission_denied_events long, error_rate_percentage double")
    row = compliance.health_columns(df).first()
    assert (row.overall_health_score, row.compliance_status) == (score, status)
    advice = json.loads(row.recommendations)
    assert (advice == [compliance.NORMAL_ADVICE]) is (score >= 90 and denied <= 10 and errors <= 1)


def test_report_without_any_data_has_all_periods(spark):
    events = spark.createDataFrame([], "event_id long, ts timestamp_ntz, event_type string, initiator string, details string")
    now = F.lit("2024-03-31 12:00:00").cast("timestamp_ntz")
    got = compliance.access_audit(events, as_of=now).collect()
    assert sorted((r.period, r.total_login_attempts, r.success_rate) for r in got) == [("daily", 0, 0.0), ("monthly", 0, 0.0), ("weekly", 0, 0.0)]
    month = compliance.all_periods(events, as_of=now).filter("period = 'monthly'").first()
    assert month.start_date == at("2024-02-29T12:00:00")


def test_unknown_period_is_refused():
    with pytest.raises(ValueError):
        compliance.report_window("hourly", F.lit(None))


LINES = [
    ("[2024-01-01 00:00:01.250] INFO  [consumer.go:12] [AI:metrics:milestone] [job:j1] done 5", ("INFO", "consumer.go:12", "metrics", "milestone", "j1", "", "done 5")),
    ("[2024-01-01 00:00:01.250] WARN  [unknown] [AI:incident:start] [component:producer] slow", ("WARN", "unknown", "incident", "start", "", "producer", "slow")),
    ("[2024-01-01 00:00:01.250] ERROR [mirror.go:7] [Job j2] [x] failed", ("ERROR", "mirror.go:7", "", "", "j2", "", "[x] failed")),
    ("[2024-01-01 00:00:01.250] INFO  plain", ("INFO", "", "", "", "", "", "plain")),
    ("malformed 3", None), ("[yesterday] INFO  x", None), ("[2024-01-01 00:00:01.250]", None), ("", None),
]


@pytest.mark.parametrize("line,want", LINES)
def test_log_lines(spark, line, want):
    df = spark.createDataFrame([(line,)], "line string")
    parsed = [tuple(r)[1:] for r in logs.parse_log_lines(df).collect()]
    assert parsed == ([want] if want else [])
    assert logs.malformed_log_lines(df).count() == (0 if want else 1)


def test_log_time_has_milliseconds(spark):
    df = spark.createDataFrame([(LINES[0][0],)], "line string")
    assert logs.parse_log_lines(df).first().ts == at("2024-01-01T00:00:01.250")


@pytest.mark.parametrize("body,want", [
    ('{"api_key": "abc", "name": "n"}', '{"api_key":"***MASKED***", "name": "n"}'),
    ('{"x": "ABCDEFGHIJKLMNOPQRSTUV"}', '{"x":"***MASKED***"}'), ('{"x": "short"}', '{"x": "short"}'),
    ("y" * 501, "y" * 497 + "..."), ("y" * 500, "y" * 500),
])
def test_masked_details(spark, body, want):
    df = spark.createDataFrame([(body,)], "body string")
    assert df.select(audit.masked_details(F.col("body"))).first()[0] == want


def request(spark, method, path, body="", status=200, user="ann"):
    df = spark.createDataFrame([(1, at("2024-01-01T00:00:00"), method, path, status, user, body)], "event_id long, ts timestamp_ntz, method string, path string, status int, username string, body string")
    return audit.audit_events(df).collect()


def test_audit_events(spark):
    assert request(spark, "GET", "/api/v1/jobs") == []
    assert request(spark, "POST", "/api/v1/jobs", status=500) == []
    assert request(spark, "put", "/api/v1/jobs/7/stop")[0].details == "Stopped replication job: 7"
    made = request(spark, "POST", "/api/v1/jobs", '{"name":"n","source_cluster_name":"a","target_cluster_name":"b"}', user=None)[0]
    assert (made.details, made.initiator, made.event_type) == ("Created job 'n' from a to b", "Anonymous", "POST /api/v1/jobs")
    config = request(spark, "PUT", "/api/v1/config", '{"AI":{"Provider":"p","Model":"m"},"Server":{"Port":80}}')[0]
    assert (config.details, config.event_class) == ("Updated configuration: AI Provider: p, AI Model: m, Server Port: 80", "config_change")
    assert request(spark, "GET", "/api/v1/users", status=403)[0].event_class == "permission_denied"
    assert request(spark, "DELETE", "/api/v1/users/3")[0].details == "No additional details"


@pytest.mark.parametrize("factor,brokers,want", [(0, 3, 1), (-1, 0, 1), (5, 3, 3), (2, 3, 2), (5, 0, 5)])
def test_replication_factor(spark, factor, brokers, want):
    df = spark.createDataFrame([(factor, brokers)], "f int, b int")
    assert df.select(inventory.clamped_replication_factor(F.col("f"), F.col("b"))).first()[0] == want


def test_topic_health(spark):
    parts = spark.createDataFrame([("a", 0, "[1,2]", "[1]"), ("a", 1, "[1,2]", "[1,2]"), ("b", 0, "[1]", "[1]")], "topic_name string, partition_id int, replica_ids string, isr_ids string")
    wanted = spark.createDataFrame([("a",), ("b",), ("gone",)], "topic_name string")
    health = inventory.topic_health(wanted, parts)
    got = {r.topic_name: (r.partitions, r.replication_factor, r.under_replicated_partitions, r.is_healthy) for r in health.collect()}
    assert got == {"a": (2, 2, 1, False), "b": (1, 1, 0, True), "gone": (0, 0, 0, False)}
    assert sorted(r.details for r in inventory.health_alerts(health).collect()) == [
        "Topic a is unhealthy. Under-replicated partitions: 1", "Topic gone is unhealthy. Under-replicated partitions: 0"]


def test_inventory_pages_hold_every_partition(spark):
    snaps = spark.createDataFrame([(1, "j", "manual")], "snapshot_id int, job_id string, snapshot_type string")
    clusters = spark.createDataFrame([(1, 1, "c", "source")], "cluster_inventory_id int, snapshot_id int, cluster_name string, cluster_type string")
    topics = spark.createDataFrame([(1, 1, "t"), (2, 1, "empty")], "topic_inventory_id int, cluster_inventory_id int, topic_name string")
    parts = spark.range(2500).selectExpr("1 AS topic_inventory_id", "id AS partition_id", "1 AS leader_id")
    got = inventory.inventory_tree(snaps, clusters, topics, parts).collect()
    assert sorted((r.topic_name, r.page, r.partitions_in_page) for r in got if r.page is not None) == [("t", 0, 1000), ("t", 1, 1000), ("t", 2, 500)]
    assert [(r.page, r.partitions) for r in got if r.topic_name == "empty"] == [(None, None)]
    nested = [p["partition_id"] for r in got if r.partitions for p in json.loads(r.partitions)]
    assert sorted(nested) == list(range(2500))


def test_duplicates_and_scope(spark):
    from relaylens.operators import quality

    df = spark.createDataFrame([("a", "confluent", "lkc-1"), ("b", "confluent", "lkc-1"), ("c", "confluent", "lkc-2"), ("d", "plain", "lkc-1")], "name string, provider string, cluster_id string")
    got = quality.duplicate_keys(df, ["cluster_id"], scope=F.col("provider") == "confluent").collect()
    assert [(r.cluster_id, r.copies) for r in got] == [("lkc-1", 2)]


def test_inventory_sections_are_bounded_and_add_up(spark):
    from relaylens.operators import snapshots

    snaps = spark.createDataFrame([(1, "j", "manual", None), (2, "j", "manual", None)], "snapshot_id int, job_id string, snapshot_type string, created_at timestamp_ntz")
    clusters = spark.sql("""SELECT * FROM VALUES (1, 1, 'source'), (2, 1, 'target'), (9, 77, 'source') AS t(cluster_inventory_id, snapshot_id, cluster_type)""").selectExpr(
        "*", "'c' AS cluster_name", "'p' AS provider", "'b' AS brokers", "3 AS broker_count", "1 AS total_topics", "CAST(NULL AS INT) AS controller_id", "'' AS cluster_id")
    topics = spark.range(25).selectExpr("CAST(id AS INT) AS topic_inventory_id", "IF(id < 24, 1, 9) AS cluster_inventory_id", "concat('t', id % 7) AS topic_name", "1 AS partition_count",
        "1 AS replication_factor", "false AS is_internal", "CAST(NULL AS STRING) AS config_data")
    partitions = spark.range(250).selectExpr("CAST(id % 2 AS INT) AS topic_inventory_id", "CAST(id DIV 2 AS INT) AS partition_id", "1 AS leader_id", "'[1,2]' AS replica_ids",
        "IF(id % 10 = 0, '[1]', '[1,2]') AS isr_ids", "id AS high_water_mark")
    groups = spark.sql("SELECT 5 AS group_inventory_id, 1 AS snapshot_id, 'g' AS group_id, 'Stable' AS group_state, '' AS protocol_type, '' AS protocol, 1 AS member_count")
    offsets = spark.range(30).selectExpr("5 AS group_inventory_id", "id AS offset_inventory_id", "'t0' AS topic_name", "CAST(id AS INT) AS partition_id", "id AS current_offset",
        "id + 2 AS high_water_mark", "1L AS lag")
    connections = spark.range(12).selectExpr("id AS connection_inventory_id", "1 AS snapshot_id", "'source_consumer' AS connection_type", "'p' AS provider", "'b' AS brokers",
        "'' AS security_protocol", "'' AS sasl_mechanism", "'' AS api_key_prefix", "true AS connection_successful", "1L AS connection_time_ms", "CAST(NULL AS STRING) AS error_message")
    out = snapshots.inventory_sections(snaps, clusters, topics, partitions, groups, offsets, connections, page_size=10).cache()
    got = [tuple(r) for r in out.groupBy("snapshot_id", "section").agg(F.count("*").alias("pages"), F.sum("n_items").alias("n"), F.max("n_items").alias("most")).collect()]
    assert sorted(got) == sorted([
        (1, "snapshot", 1, 1, 1), (2, "snapshot", 1, 1, 1), (1, "clusters", 1, 2, 2), (1, "topics", 3, 24, 10), (1, "partitions", 26, 250, 10), (1, "consumer_groups", 1, 1, 1),
        (1, "consumer_offsets", 3, 30, 10), (1, "connections", 2, 12, 10),
    ])
    items = {r.parent_id: r for r in snapshots.section_items(out, "snapshot", "clusters: int, topics: int, partitions: int, offsets: int, connections: int").collect()}
    assert tuple(items[1])[3:] == (2, 24, 250, 30, 12) and tuple(items[2])[3:] == (0, 0, 0, 0, 0)
    topic = snapshots.section_items(out, "topics", "topic_inventory_id: int, partitions: int, under_replicated: int, high_water_marks: bigint").filter("partitions > 0")
    assert sorted(tuple(r)[3:] for r in topic.collect()) == [(0, 125, 25, sum(range(0, 250, 2))), (1, 125, 0, sum(range(1, 250, 2)))]
    parts = snapshots.section_items(out, "partitions", "partition_id: int, replica_ids: string, isr_ids: string, high_water_mark: bigint")
    assert parts.select("parent_id", "partition_id").distinct().count() == 250
