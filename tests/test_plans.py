"""What the plans of the registered queries must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from relaylens.plans import catalogue
from tests.conftest import SMALL

def plan(spark, name):
    return catalogue.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_plan(spark, name):
    text = plan(spark, name)
    physical = text.split("== Physical Plan ==")[1]
    assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups|MapInArrow", physical)
    assert "CartesianProduct" not in physical
    # A window without partitioning would put all rows into one task.
    assert not re.search(r"windowspecdefinition\([^,()]* (ASC|DESC)", physical)


@pytest.mark.parametrize("name,column", [
    ("metric_history_2h", "ts"), ("metric_anomalies", "ts"), ("series_statistics", "ts"), ("retained_events", "ts"),
    ("access_audit", "ts"), ("performance_summary", "ts"), ("metric_severity", "ts"),
])
def test_time_range_reaches_the_scan(spark, name, column):
    assert re.search(rf"PushedFilters: \[[^\]]*GreaterThan(OrEqual)?\({column},", plan(spark, name))


@pytest.mark.parametrize("name,unread", [
    ("rollup_daily", "send_failed"), ("access_audit", "value"), ("consumer_lag_by_topic", "props"), ("insights_by_type", "text"),
    ("message_size_tiers", "source"),
])
def test_scan_reads_only_needed_columns(spark, name, unread):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert schemas and all(unread not in [c.split(":")[0] for c in s.split(",")] for s in schemas)


def test_records_are_not_shuffled_to_be_mirrored(spark, views):
    from relaylens.operators import mapping

    routes = mapping.topic_map(mapping.resolve_mappings(views.topic_listing, views.rules))
    targets = spark.createDataFrame([("dr-click", 4)], "target_topic string, partitions int")
    records = views.events.selectExpr(
        "'job-0' AS job_id", "concat('events-', event_type) AS topic", "1 AS partition_id", "event_id AS rec_offset",
        "props AS rec_key", "props AS rec_value",
    )
    physical = mapping.mirror(records, routes, targets, small_map=True)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    # the first join is that of the records with the map; what stands below it derives the map
    assert re.search(r"\w+Join", physical).group() == "BroadcastHashJoin"


@pytest.mark.parametrize("name", ["mirror_records", "rejected_records", "missing_at_target", "effective_permissions", "mapping_conflicts", "migration_verdict"])
def test_building_a_query_starts_no_job_but_for_schemas(spark, name):
    context = spark.sparkContext
    context.setJobGroup(f"build-{name}", "")
    try:
        text = plan(spark, name)
        jobs = context.statusTracker().getJobIdsForGroup(f"build-{name}")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= len(set(re.findall(r"/(\w+)\.parquet", text)))


def test_users_are_dealt_out_before_their_permissions(spark):
    """One exchange of users; the pairs are made and told apart behind it, in as many parts as the session has."""
    physical = plan(spark, "effective_permissions").split("== Physical Plan ==")[1]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    assert re.findall(r"Exchange hashpartitioning\(user_id#\d+L?, ([^)]*)\), (\w+)", physical) == [(f"username#{re.search(r'username#(\d+)', physical)[1]}, {parts}", "REPARTITION_BY_NUM")]


def test_conflicts_match_patterns_once(spark):
    physical = plan(spark, "mapping_conflicts").split("== Physical Plan ==")[1]
    assert physical.count("NestedLoopJoin") == 0


def test_timeline_reads_its_input_once(spark, views, tmp_path):
    """Deltas over a plain table: one scan, one shuffle of the rows, and two of summaries."""
    from relaylens.operators import detect, metrics

    views.raw_metrics.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    for df in (metrics.counter_deltas(raw, order=("ts", "event_id")), detect.incidents(raw, order=("ts", "event_id"))):
        df.toArrow()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert final.count("FileScan") == 1 and len(re.findall(r"- Exchange hashpartitioning", final)) <= 4


@pytest.mark.parametrize("name", ["failure_runs", "job_log_summary"])
def test_input_is_read_once(spark, name):
    """The fixture's own timeline reads the events for its summaries and for its rows; nothing else does."""
    from relaylens.operators import detect, logs
    from relaylens.plans.bindings import Views

    views = Views(spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    if name == "failure_runs":
        df = detect.failure_runs(rows.selectExpr("event_id", "concat('job-', user_id % 8) AS job_id", "value > 100 AS send_failed"), order=("event_id",), chunk=F.expr("event_id DIV 100"))
    else:
        df = logs.job_log_summary(logs.parse_log_lines(views.log_lines), order=("ts", "event_id"))
    df.toArrow()
    assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1
