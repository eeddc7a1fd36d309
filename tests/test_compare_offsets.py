from pyspark.sql import functions as F

from relaylens.functions.timeline import block_of
from relaylens.operators import compare, maintenance, progress
from tests.conftest import at, rows

HWM = "topic string, partition_id int, last_offset long, high_water_mark long"
MAP = "job_id string, topic string, target_topic string"


def comparison(spark):
    source = spark.createDataFrame([("a", 0, 99, 100), ("a", 1, 49, 50), ("b", 0, 9, 10)], HWM)
    target = spark.createDataFrame([("x", 0, 89, 90), ("y", 0, 11, 12)], HWM)
    mapping = spark.createDataFrame([("j", "a", "x"), ("j", "b", "y"), ("j", "gone", "z")], MAP)
    return mapping, compare.compare_offsets(source, target, mapping)


def test_comparison_with_missing_partition_and_negative_gap(spark):
    _, df = comparison(spark)
    got = {(r.source_topic, r.partition_id): (r.target_offset, r.target_high_water_mark, r.gap, r.safe_resume_offset, r.has_gap) for r in df.collect()}
    assert got == {("a", 0): (89, 90, 10, 90, True), ("a", 1): (-1, 0, 50, 0, True), ("b", 0): (11, 12, -2, 12, False)}


def test_totals_and_verdict(spark):
    mapping, df = comparison(spark)
    topics = compare.topic_comparison(df)
    job = compare.job_comparison(mapping, topics)
    r = job.first()
    assert (r.topics_compared, r.gaps_detected, r.total_lag, r.positive_lag, r.missing_partitions, r.critical_issues) == (2, 2, 8, 10, 1, 1)
    verdict = compare.migration_verdict(job).first()
    assert (verdict.migration_safe, verdict.risk_level) == (False, "high")
    assert [r.source_topic for r in compare.critical_issues(mapping, topics).collect()] == ["gone"]


def test_safe_and_medium_verdicts(spark):
    jobs = spark.createDataFrame([("ok", 0, 0, 0), ("warned", 0, 0, 1), ("critical", 0, 1, 0)], "job_id string, gaps_detected long, critical_issues long, warnings long")
    got = {r.job_id: (r.migration_safe, r.risk_level) for r in compare.migration_verdict(jobs).collect()}
    assert got == {"ok": (True, "low"), "warned": (True, "medium"), "critical": (False, "low")}


def test_lag_counts_unread_partitions_and_ignores_over_reading(spark):
    schema = "topic string, partition_id int, high_water_mark long, last_offset long"
    unread = spark.createDataFrame([("orders", 0, 10, 7), ("orders", 1, 5, None)], schema)
    over = spark.createDataFrame([("orders", 0, 10, 10)], schema)
    assert compare.consumer_lag(unread, ["topic"]).first().lag == 7
    assert compare.consumer_lag(over, ["topic"]).first().lag == 0


def test_holes_and_present_offsets_fill_the_range(spark):
    present = [0, 1, 2, 6, 7, 20, 21, 40]
    df = spark.createDataFrame([("t", 0, o) for o in present + [6]], "topic string, partition_id int, rec_offset long")
    holes = compare.offset_holes(df, block=block_of("rec_offset", 8)).collect()
    covered = set(present) | {o for h in holes for o in range(h.gap_start_offset, h.gap_end_offset)}
    assert covered == set(range(41)) and sum(h.gap_size for h in holes) == 41 - len(present)


def test_progress_keeps_the_newest_row_per_partition(spark):
    schema = "job_id string, source_topic string, partition_id int, source_offset long, replication_lag long, last_updated timestamp_ntz, status string"
    old = spark.createDataFrame([("j", "t", 0, 1000, 50, at("2024-01-01T00:00:00"), "active")], schema)
    new = spark.createDataFrame([("j", "t", 0, 1100, 0, at("2024-01-01T00:05:00"), "completed")], schema)
    got = maintenance.merged(old, new, progress.PARTITION_KEY, ["last_updated"]).collect()
    assert [(r.source_offset, r.replication_lag, r.status) for r in got] == [(1100, 0, "completed")]


def test_newest_analysis_first(spark):
    df = spark.createDataFrame([("j", "gap_detection", at("2024-01-01T00:00:00")), ("j", "resume_validation", at("2024-01-01T01:00:00"))], "job_id string, analysis_type string, analyzed_at timestamp_ntz")
    assert [r.analysis_type for r in progress.newest_first(df, ["analyzed_at"]).collect()] == ["resume_validation", "gap_detection"]
    assert progress.newest_by_key(df, ["job_id"], ["analyzed_at"]).first().analysis_type == "resume_validation"


def test_latest_rows_keep_ties(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z")], "k string, at int, v string")
    assert rows(progress.latest_rows(df, ["k"], "at")) == [("a", 2, "y"), ("a", 2, "z")]


def test_retention(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame([(at("2024-01-21T00:00:00"),), (at("2024-01-29T00:00:00"),)], "ts timestamp_ntz")
    assert maintenance.pruned(df, "ts", as_of=now, days=7).count() == 1
    df = spark.createDataFrame([(at("2023-12-22T00:00:00"),), (at("2024-01-11T00:00:00"),)], "ts timestamp_ntz")
    assert maintenance.pruned(df, "ts", as_of=now, days=45).count() == 1


def test_offset_maps_survive_json(spark):
    from relaylens.functions.json_columns import long_map, offset_map, sorted_map_json

    text = '{"another-topic":{"0":2500},"test-topic":{"0":1000,"1":950}}'
    df = spark.createDataFrame([('{"another-topic":2500,"test-topic":1000}', text)], "a string, b string")
    back = df.select(sorted_map_json(long_map("a")), F.to_json(offset_map("b"))).first()
    assert tuple(back) == ('{"another-topic":2500,"test-topic":1000}', text)


def test_a_much_replayed_record_does_not_matter(spark):
    copies = spark.range(5000).selectExpr("'t' AS topic", "0 AS partition_id", "4L AS rec_offset")
    others = spark.createDataFrame([("t", 0, 1), ("t", 0, 9)], "topic string, partition_id int, rec_offset long")
    got = compare.offset_holes(copies.unionByName(others)).select("gap_start_offset", "gap_end_offset")
    assert rows(got) == [(2, 4), (5, 9)]
