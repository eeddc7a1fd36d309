"""Streams over files equal their batch twins, in several micro-batches and after a restart."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from relaylens.operators import detect, inventory, logs, metrics, progress
from relaylens.sources import files, kafka, payloads
from relaylens.streaming import logs as log_streams
from relaylens.streaming import metrics as metric_streams
from relaylens.streaming import mirror
from tests.conftest import at, rows

ONCE = {"availableNow": True}
ORDER = ("ts", "event_id")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """Each partition of keyed state is a Python worker per micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def parts(df, path, n, by="event_id"):
    """Write ``df`` as n consecutive files; returns a stream reading one file per micro-batch."""
    total = df.count()
    low = df.agg(F.min(by)).first()[0]
    step = -(-total // n)
    for i in range(n):
        piece = df.filter((F.col(by) >= low + i * step) & (F.col(by) < low + (i + 1) * step))
        piece.coalesce(1).write.mode("append").parquet(str(path))
    return stream(df.sparkSession, df.schema, path)


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def timed(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def run(query):
    query.awaitTermination(180)
    assert query.exception() is None


def collected(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(**ONCE).start()
    run(query)
    return df.sparkSession.table(name)


def written(spark, path):
    return spark.read.option("basePath", str(path)).parquet(str(path)).drop("batch")


def kafka_rows(views):
    return views.records.select(
        F.col("rec_key").cast("binary").alias("key"), F.col("rec_value").cast("binary").alias("value"),
        F.array(F.struct(F.lit("h").alias("key"), F.lit("x").cast("binary").alias("value"))).alias("headers"),
        "topic", F.col("partition_id").alias("partition"), F.col("rec_offset").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit(0).alias("timestampType"), "event_id",
    )


def test_mirror_stream(spark, views, tmp_path):
    base = kafka_rows(views)
    source = parts(base, tmp_path / "in", 3)
    rules = views.rules.filter("job_id IN ('job-0', 'job-1')")
    counts = views.target_records.groupBy(F.col("topic").alias("target_topic")).agg((F.max("partition_id") + 1).alias("partitions"))

    def start():
        return mirror.start_mirror(
            kafka.as_records(source), lambda: rules.filter("job_id = 'job-1'"), lambda: counts, str(tmp_path / "cp"),
            mirror.parquet_writer(str(tmp_path / "out")), mirror.parquet_writer(str(tmp_path / "rejected")), trigger=ONCE,
        )

    run(start())
    run(start())  # nothing new: a restart writes nothing twice
    got, rejected = written(spark, tmp_path / "out"), written(spark, tmp_path / "rejected")
    want, want_rejected = mirror.mirror_batch(kafka.as_records(base), rules.filter("job_id = 'job-1'"), counts)
    assert got.count() + rejected.count() == base.count()
    cols = ["topic", "partition_id", "rec_key", "rec_value", "source_topic", "source_partition", "source_offset"]
    assert rows(got.select(cols)) == rows(want.select(cols))
    assert rejected.count() == want_rejected.count() > 0
    out = kafka.as_kafka_rows(got)
    assert out.columns == ["topic", "partition", "key", "value", "headers"]
    assert {r.topic for r in out.select("topic").distinct().collect()} == {"clicks", "x-purchase", "x-signup"}


def test_replays_are_dropped(spark, views, tmp_path):
    base = kafka_rows(views)
    source = parts(base, tmp_path / "in", 2)
    base.filter("event_id >= 900").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    once = collected(mirror.without_replays(kafka.as_records(source), delay="3 days"), "replays")
    assert once.count() == base.count() == once.select("topic", "partition_id", "rec_offset").distinct().count()


def test_traffic_windows(spark, views, tmp_path):
    base = kafka_rows(views)
    windows = collected(mirror.traffic_windows(kafka.as_records(parts(base, tmp_path / "in", 2)), every="1 day", delay="1 hour"), "traffic")
    closed = windows.agg(F.max("window_start")).first()[0]
    want = base.withColumn("day", F.date_trunc("day", "timestamp")).filter(F.col("day") <= F.lit(closed)).groupBy("day", "topic").agg(
        F.count(F.lit(1)), F.sum(F.octet_length("key") + F.octet_length("value")).cast("long"))
    assert rows(windows) == rows(want) and windows.count() > 50


def test_rollup_windows_equal_the_daily_rollup(spark, views, tmp_path):
    source = timed(parts(views.metric_points, tmp_path / "in", 3))
    got = collected(metric_streams.rollup_windows(source, every="1 day", delay="1 hour"), "rollups")
    closed = got.agg(F.date_format(F.max("window_start"), "yyyy-MM-dd")).first()[0]
    want = metrics.rollup(views.metric_points, "daily", as_of=F.lit("2024-01-31").cast("timestamp_ntz"), days=400).filter(F.col("period") <= closed)
    assert rows(got.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))) == rows(want)


def ended(started):
    """Runs an ordered stream to the end of its input and hands on what it holds."""
    run(started.query)
    started.finish()


def cut(df, path, n, order):
    """``df`` in n files by place, read one by one in the given order of files."""
    ranked = df.withColumn("__file", F.ntile(n).over(Window.orderBy("event_id")) - 1)
    for number in order(list(range(n))):
        ranked.filter(F.col("__file") == number).drop("__file").coalesce(1).write.mode("append").parquet(str(path))
    return stream(df.sparkSession, df.schema, path)


def shuffled(numbers):
    return random.Random(4).sample(numbers, len(numbers))


CUTS = [(1, list), (3, list), (5, shuffled)]
MONTH = 40 * 86_400  # seconds, longer than the tables are


@pytest.mark.parametrize("n,order", CUTS)
def test_delta_stream(spark, views, tmp_path, n, order):
    raw = views.raw_metrics
    source = cut(raw, tmp_path / "in", n, order)
    out = mirror.parquet_writer(str(tmp_path / "out"))
    ended(metric_streams.start_deltas(source, str(tmp_path / "cp"), out, order=ORDER, delay_seconds=MONTH, trigger=ONCE))
    want = metrics.counter_deltas(raw, order=ORDER)
    assert rows(written(spark, tmp_path / "out").select(want.columns)) == rows(want)
    assert not (tmp_path / "cp" / "order" / "late").exists()


def test_delta_stream_goes_on_after_a_restart(spark, views, tmp_path):
    raw = views.raw_metrics
    source = parts(raw, tmp_path / "in", 3)
    out = mirror.parquet_writer(str(tmp_path / "out"))
    run(metric_streams.start_deltas(source, str(tmp_path / "cp"), out, order=ORDER, trigger=ONCE).query)
    # More files and a restart: held rows and carried samples come from the checkpoint folder.
    extra = raw.filter("event_id >= 900").withColumn("event_id", F.col("event_id") + 100).withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS"))
    extra.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ended(metric_streams.start_deltas(source, str(tmp_path / "cp"), out, order=ORDER, trigger=ONCE))
    want = metrics.counter_deltas(raw.unionByName(extra), order=ORDER)
    late = written(spark, tmp_path / "cp" / "order" / "late").count() if (tmp_path / "cp" / "order" / "late").exists() else 0
    assert late == 0 and rows(written(spark, tmp_path / "out").select(want.columns)) == rows(want)


def test_late_samples_are_kept_apart(spark, tmp_path):
    schema = "job_id string, ts timestamp_ntz, event_id long, messages_replicated long, bytes_transferred long, messages_consumed long, bytes_consumed long, current_lag long, error_count long"

    def sample(minute, value, number):
        return ("j", at(f"2024-01-01 00:{minute:02d}:00") if minute is not None else None, number, value, 0, 0, 0, 0, 0)

    for piece in ([sample(10, 100, 1)], [sample(5, 50, 2), sample(None, 7, 3)], [sample(12, 110, 4)]):
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = stream(spark, spark.createDataFrame([], schema).schema, tmp_path / "in")
    ended(metric_streams.start_deltas(source, str(tmp_path / "cp"), mirror.parquet_writer(str(tmp_path / "out")), order=ORDER, delay_seconds=60, trigger=ONCE))
    assert rows(written(spark, tmp_path / "out").select("event_id", "messages_replicated_delta")) == [(1, 100), (4, 10)]
    assert rows(written(spark, tmp_path / "cp" / "order" / "late").select("event_id")) == [(2,), (3,)]


@pytest.mark.parametrize("rearm,n,order", [(None, 4, list), (3, 1, list), (3, 4, shuffled)])
def test_incident_stream(spark, views, tmp_path, rearm, n, order):
    raw = views.raw_metrics
    ended(metric_streams.start_incidents(
        cut(raw, tmp_path / "in", n, order), str(tmp_path / "cp"), mirror.parquet_writer(str(tmp_path / "out")),
        rearm_every=rearm, order=ORDER, delay_seconds=MONTH, trigger=ONCE,
    ))
    want = detect.incidents(raw, rearm_every=rearm, order=ORDER)
    assert rows(written(spark, tmp_path / "out").select(want.columns)) == rows(want)


def test_payload_stream(spark, views, tmp_path):
    deliver = payloads.fan_out("splunk", payloads.text_writer(str(tmp_path / "out")))
    source = cut(views.raw_metrics, tmp_path / "in", 3, shuffled)
    ended(metric_streams.start_payloads(source, str(tmp_path / "cp"), deliver, order=ORDER, delay_seconds=MONTH, trigger=ONCE))
    got = spark.read.text(str(tmp_path / "out")).drop("batch")
    assert rows(got) == rows(payloads.shaped(detect.flagged_samples(views.raw_metrics, order=ORDER), "splunk"))


def test_latest_state_stream(spark, views, tmp_path):
    numbered = views.progress.withColumn("event_id", F.datediff("last_updated", F.lit("2024-01-01")))
    days = [numbered.filter(F.col("event_id").between(a, b)) for a, b in ((0, 9), (10, 19), (20, 31))]
    for piece in days:
        piece.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query, current = metric_streams.start_latest(
        stream(spark, numbered.schema, tmp_path / "in"), str(tmp_path / "cp"), mirror.parquet_writer(str(tmp_path / "history")),
        keys=progress.PARTITION_KEY, order=["last_updated"], trigger=ONCE,
    )
    run(query)
    assert written(spark, tmp_path / "history").count() == numbered.count()
    assert rows(current(2)) == rows(progress.newest_by_key(numbered, progress.PARTITION_KEY, ["last_updated"]))


@pytest.mark.parametrize("n,order,delay", [(1, list, 600), (3, list, 600), (8, list, 600), (6, shuffled, MONTH)])
def test_gate_stream(spark, views, tmp_path, n, order, delay):
    points = views.metric_points.withColumn("avg_lag", F.col("avg_lag") % 2).withColumn("messages_replicated_delta", F.lit(1).cast("long"))
    source = cut(points.orderBy(*ORDER).withColumn("event_id", F.row_number().over(Window.orderBy(*ORDER)).cast("long")), tmp_path / "in", n, order)
    ended(metric_streams.start_analysis_gate(
        source, str(tmp_path / "cp"), mirror.parquet_writer(str(tmp_path / "out")), every_seconds=86_400, order=ORDER, delay_seconds=delay, trigger=ONCE))
    want = detect.analysis_gate(points, every_seconds=86_400, order=ORDER)
    assert rows(written(spark, tmp_path / "out").select(want.columns)) == rows(want) and want.count() > 20


def test_log_stream(spark, views, tmp_path):
    for i in range(3):
        piece = views.log_lines.filter((F.col("event_id") >= 334 * i) & (F.col("event_id") < 334 * (i + 1))).select("line")
        piece.coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    got = collected(log_streams.pattern_windows(files.read_log_lines(spark, str(tmp_path / "in"), streaming=True)), "patterns", "update")
    want = logs.pattern_counts(logs.parse_log_lines(views.log_lines))
    assert got.agg(F.sum("lines")).first()[0] == want.agg(F.sum("lines")).first()[0]
    assert rows(got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))) == rows(want)


def test_health_alert_stream(spark, tmp_path):
    info = "name string, partition_info array<struct<id:int,leader:int,replicas:array<int>,isr:array<int>>>"
    base = spark.createDataFrame([
        ("a", [(0, 1, [1, 2], [1]), (1, 1, [1, 2], [1, 2])]), ("b", [(0, 1, [1], [1])]), ("gone", []), ("lost", None)], info)
    base.write.parquet(str(tmp_path / "in"))
    got = collected(log_streams.health_alerts(stream(spark, base.schema, tmp_path / "in")), "alerts")
    wanted = base.select(F.col("name").alias("topic_name"))
    flat = base.select(F.col("name").alias("topic_name"), F.explode("partition_info").alias("p")).select(
        "topic_name", F.col("p.id").alias("partition_id"), F.to_json("p.replicas").alias("replica_ids"), F.to_json("p.isr").alias("isr_ids"))
    assert rows(got) == rows(inventory.health_alerts(inventory.topic_health(wanted, flat)))


def test_observed_traffic(spark, views, tmp_path):
    seen = mirror.observed(kafka.as_records(parts(kafka_rows(views), tmp_path / "in", 2)))
    query = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start()
    run(query)
    assert sum(p.observedMetrics["traffic"].records for p in query.recentProgress if p.observedMetrics) == views.records.count()
