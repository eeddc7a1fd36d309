import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from relaylens.operators import compliance
from relaylens.plans.bindings import Views
from relaylens.schemas import TABLES, schema
from relaylens.sources import files, kafka, payloads
from tests.conftest import at


def test_all_tables_have_columns(spark):
    assert all(len(schema(t)) >= 1 for t in TABLES)


@pytest.mark.parametrize("cluster,mechanism,protocol", [
    (kafka.Cluster("b", "confluent", api_key="k", api_secret="s"), "PLAIN", "SASL_SSL"),
    (kafka.Cluster("b", "azure", connection_string="c"), "PLAIN", "SASL_SSL"),
    (kafka.Cluster("b", "redpanda", username="u", password="p"), "SCRAM-SHA-256", "SASL_SSL"),
    (kafka.Cluster("b", "plain", protocol="sasl_ssl", sasl_mechanism="scram-sha-512", username="u", password="p"), "SCRAM-SHA-512", "SASL_SSL"),
    (kafka.Cluster("b", "plain", sasl_mechanism="GSSAPI", kerberos_service="kafka"), "GSSAPI", "SASL_PLAINTEXT"),
    (kafka.Cluster("b"), None, "PLAINTEXT"), (kafka.Cluster("b", protocol="SSL"), None, "SSL"),
])
def test_security_options(cluster, mechanism, protocol):
    options = kafka.security_options(cluster)
    assert options["kafka.security.protocol"] == protocol and options.get("kafka.sasl.mechanism") == mechanism


@pytest.mark.parametrize("cluster", [
    kafka.Cluster("b", "confluent"), kafka.Cluster("b", "azure"), kafka.Cluster("b", sasl_mechanism="PLAIN"),
    kafka.Cluster("b", sasl_mechanism="GSSAPI"), kafka.Cluster("b", sasl_mechanism="OAUTH", username="u", password="p"),
])
def test_incomplete_security_is_refused(cluster):
    with pytest.raises(ValueError):
        kafka.security_options(cluster)


def test_source_and_sink_options():
    cluster = kafka.Cluster("a:1,, b:2")
    assert kafka.source_options(cluster, topics=["x", "y"], max_offsets=5)["subscribe"] == "x,y"
    assert kafka.source_options(cluster, pattern="x.*")["subscribePattern"] == "x.*"
    sink = kafka.sink_options(cluster, compression="zstd")
    assert (sink["kafka.bootstrap.servers"], sink["kafka.compression.type"]) == ("a:1,b:2", "zstd")
    with pytest.raises(ValueError):
        kafka.sink_options(cluster, compression="rar")
    with pytest.raises(ValueError):
        kafka.source_options(cluster)


def samples(spark):
    df = spark.createDataFrame([("j", at("2024-01-01T00:00:01"), 1, 2, 3, 4, 5, 6)],
        "job_id string, ts timestamp_ntz, messages_replicated long, bytes_transferred long, messages_consumed long, bytes_consumed long, current_lag long, error_count long")
    return df.select("*", *[F.lit(f == "error_spike").alias(f) for f in payloads.FLAGS])


def test_payload_bodies(spark):
    df = samples(spark)
    body = json.loads(payloads.shaped(df, "loki").first().value)
    ns, line = body["streams"][0]["values"][0]
    assert body["streams"][0]["stream"] == {"job_id": "j"} and ns == "1704067201000000000"
    assert line.startswith("messages_replicated=1 bytes_transferred=2") and line.endswith("error_spike=true")
    envelope = json.loads(payloads.shaped(df, "splunk", index="ops").first().value)
    assert envelope["event"]["current_lag"] == 5 and envelope["index"] == "ops" and envelope["sourcetype"] == "_json"
    lines = [r.value for r in payloads.shaped(df, "prometheus", prefix="p").collect()]
    assert len(lines) == 11 and 'p_incident_error_spike{job_id="j"} 1.0' in lines
    with pytest.raises(ValueError):
        payloads.shaped(df, "fax")


def test_dated_table_prunes_whole_days_and_rewrites_the_edge(spark):
    table = files.DatedTable(spark, "points_to_prune")
    hours = spark.range(24 * 5).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts")
    table.append(hours)
    table.append(hours.filter("id = 119"))
    assert len(table.days()) == 5
    table.prune(as_of=dt.datetime(2024, 1, 5, 12), days=2)
    assert table.days() == [dt.date(2024, 1, 3), dt.date(2024, 1, 4), dt.date(2024, 1, 5)]
    kept = sorted(r.id for r in table.read().collect())
    assert kept == sorted([*range(60, 120), 119])


def test_dated_table_reads_only_the_days_asked_for(spark):
    table = files.DatedTable(spark, "points_to_read")
    hours = spark.range(24 * 5).selectExpr("id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts")
    table.append(hours)
    part = table.read(dt.datetime(2024, 1, 2, 6), dt.datetime(2024, 1, 3, 6))
    assert sorted(r.id for r in part.collect()) == list(range(30, 55))
    plan = part._jdf.queryExecution().toString()
    assert "event_date" in plan.split("PartitionFilters: [")[-1].split("]")[0]


def test_dated_table_prunes_around_rows_without_a_time(spark, tmp_path):
    table = files.DatedTable(spark, "points_without_time")
    table.append(spark.sql("SELECT 1L AS id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts UNION ALL SELECT 2L, NULL UNION ALL SELECT 3L, TIMESTAMP_NTZ'2024-01-09 13:00:00'"
                           " UNION ALL SELECT 4L, TIMESTAMP_NTZ'2024-01-09 03:00:00'"))
    table.prune(as_of=dt.datetime(2024, 1, 10, 12), days=1, stage=str(tmp_path / "stage"))
    assert sorted(r.id for r in table.read().collect()) == [2, 3]
    assert table.days() == [dt.date(2024, 1, 9)] and not list((tmp_path / "stage").glob("staged-*"))


def test_labels_are_escaped(spark):
    df = samples(spark).withColumn("job_id", F.lit('a"b\\c\nd'))
    assert 'job_id="a\\"b\\\\c\\nd"' in payloads.shaped(df, "prometheus").first().value


def test_report_file(spark, tmp_path, views):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    reports = compliance.compliance_reports(views.ops_events, views.metric_points, views.insights, views.jobs, as_of=now)
    files.write_report(compliance.report_rows(reports, views.ops_events, "weekly", as_of=now), str(tmp_path / "r"))
    parts = sorted((tmp_path / "r").glob("part-*.csv"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert lines[0].startswith("Compliance Report") and lines[1].startswith("Period,weekly")
    trail = [line.split(",")[0] for line in lines[12:]]
    assert trail == sorted(trail, reverse=True) and len(trail) > 3


def test_log_folder(spark, tmp_path):
    (tmp_path / "a.log").write_text("[2024-01-01 00:00:01.250] INFO  x\n")
    (tmp_path / "b.log").write_text("y\n")
    assert files.read_log_lines(spark, str(tmp_path)).count() == 2


def test_operators_prune_dated_tables(spark):
    """History, rollups, compliance windows and retention read only the folders of their days."""
    from pyspark.sql import functions as F

    from relaylens.operators import compliance, maintenance, metrics

    table = files.DatedTable(spark, "points_to_query")
    rows = spark.range(24 * 60).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS ts", "'j' AS job_id", "1L AS messages_replicated_delta", "2L AS avg_lag",
        "0L AS error_count_delta", "'config_change' AS event_type", "'u' AS initiator", "'d' AS details",
    )
    table.append(rows.unionByName(rows.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))))
    now = F.lit("2024-02-20 00:00:00").cast("timestamp_ntz")
    plain = table.read().drop("event_date").withColumn("event_id", F.col("event_id"))
    runs = {
        "history": lambda t: metrics.history(t, as_of=now, span="24h").select("event_id"),
        "rollup": lambda t: metrics.rollup(t, "daily", as_of=now, days=3),
        "trail": lambda t: compliance.audit_trail_pages(t, as_of=now),
        "kept": lambda t: maintenance.kept_rows(t, "ts", as_of=now, days=7).select("event_id"),
    }
    for name, run in runs.items():
        pruned = run(table.read())
        assert sorted(map(tuple, pruned.collect()), key=repr) == sorted(map(tuple, run(plain).collect()), key=repr), name
        scans = pruned._jdf.queryExecution().toString().split("PartitionFilters: [")[1:]
        assert scans and all("event_date" in s.split("]")[0] for s in scans), name
    # days of another column do not count
    other = table.read().withColumn("at", F.col("ts"))
    assert "event_date" not in maintenance.kept_rows(other, "at", as_of=now, days=7).select("event_id")._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
