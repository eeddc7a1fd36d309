"""Views of the test tables in the shape of the mirroring tables (see FIXTURES.md, part 2).

Only this module knows the test tables. Offsets and cumulative counters are derived along
``event_id`` in blocks, so that no view needs one task per topic or job.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.functions.timeline import along, block_of

AS_OF = "2024-01-31 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


class Views:
    """Lazily built DataFrames over one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def records(self) -> DataFrame:
        base = self.events.selectExpr(
            "event_id",
            "concat('job-', user_id % 8) AS job_id",
            "concat('events-', event_type) AS topic",
            "CAST(user_id % 4 AS INT) AS partition_id",
            "CAST(user_id AS STRING) AS rec_key",
            "props AS rec_value",
            "ts",
            "value >= 150 AS send_failed",
        )
        numbered = along(
            base, ["topic", "partition_id"], ["event_id"], block_of("event_id"), running={"n": F.lit(1)}
        )
        return numbered.select(
            "event_id", "job_id", "topic", "partition_id", (F.col("n") - 1).cast("long").alias("rec_offset"),
            "rec_key", "rec_value", "ts", "send_failed",
        )

    @cached_property
    def target_records(self) -> DataFrame:
        return self.records.filter(
            "NOT (topic = 'events-view' AND partition_id = 3) AND rec_offset % 101 <> 50 "
            "AND NOT (topic = 'events-click' AND partition_id = 1 AND ts >= TIMESTAMP_NTZ'2024-01-25 00:00:00')"
        ).selectExpr(
            "concat('dr-', substring(topic, 8)) AS topic", "partition_id", "rec_offset", "rec_key", "rec_value", "ts"
        )

    @cached_property
    def doc_records(self) -> DataFrame:
        return self.table("documents").selectExpr(
            "concat('docs-', lang) AS topic", "CAST(doc_id % 3 AS INT) AS partition_id", "doc_id AS rec_offset",
            "CAST(doc_id AS STRING) AS rec_key", "text AS rec_value",
        )

    @cached_property
    def topic_listing(self) -> DataFrame:
        return self.events.selectExpr("concat('events-', event_type) AS topic").distinct()

    @cached_property
    def rules(self) -> DataFrame:
        return self.spark.createDataFrame(
            [
                ("job-0", 1, "events-(.*)", "dr-$1", True), ("job-1", 1, "events-click", "clicks", True),
                ("job-1", 2, "events-(p.*|s.*)", "x-$1", True), ("job-2", 1, "events-.*", "all", True),
                ("job-3", 1, "events-view", "", True), ("job-3", 2, "nothing-(.*)", "y-$1", True),
                ("job-4", 1, "events-error", "err", False), ("job-5", 1, "events-missing", "m", True),
            ],
            "job_id string, rule_pos int, source_pattern string, target_pattern string, enabled boolean",
        )

    @cached_property
    def metric_points(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id",
            "concat('job-', user_id % 8) AS job_id",
            "ts",
            "IF(user_id % 8 >= 6, 0L, CAST(floor(value) AS BIGINT) + 1) AS messages_replicated_delta",
            "IF(user_id % 8 >= 6, 0L, CAST(round(value * 100) AS BIGINT)) AS bytes_transferred_delta",
            "IF(user_id % 8 = 6, 0L, CAST(floor(value) AS BIGINT) + 2) AS messages_consumed_delta",
            "IF(user_id % 8 = 6, 0L, CAST(round(value * 110) AS BIGINT)) AS bytes_consumed_delta",
            "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) * IF(user_id % 8 = 5, 120, 25) AS avg_lag",
            "IF(event_type = 'error', 1L, 0L) AS error_count_delta",
        )

    @cached_property
    def raw_metrics(self) -> DataFrame:
        counters = {
            "messages_replicated": "messages_replicated_delta",
            "bytes_transferred": "bytes_transferred_delta",
            "messages_consumed": "messages_consumed_delta",
            "bytes_consumed": "bytes_consumed_delta",
            "error_count": "error_count_delta",
        }
        points = self.metric_points.withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz"))
        summed = along(
            points, ["job_id", "week"], ["event_id"], block_of("event_id"),
            running={name: F.col(delta) for name, delta in counters.items()},
        )
        return summed.select(
            "event_id", "job_id", "ts", "messages_replicated", "bytes_transferred", "messages_consumed",
            "bytes_consumed", F.col("avg_lag").alias("current_lag"), "error_count",
        )

    @cached_property
    def offsets(self) -> DataFrame:
        read = "ts < TIMESTAMP_NTZ'2024-01-28 00:00:00' AND NOT (topic = 'events-view' AND partition_id = 3)"
        return self.records.groupBy("topic", "partition_id").agg(
            (F.max("rec_offset") + 1).alias("high_water_mark"),
            F.max(F.expr(f"CASE WHEN {read} THEN rec_offset END")).alias("last_offset"),
        )

    @cached_property
    def progress(self) -> DataFrame:
        daily = self.records.groupBy("topic", "partition_id", F.to_date("ts").alias("last_updated")).agg(
            (F.max("rec_offset") + 1).alias("source_high_water_mark")
        )
        return daily.selectExpr(
            "'job-0' AS job_id", "topic AS source_topic", "concat('dr-', substring(topic, 8)) AS target_topic",
            "partition_id", "last_updated", "source_high_water_mark",
            "greatest(source_high_water_mark - partition_id * 7, 0L) AS target_high_water_mark",
        )

    @cached_property
    def gaps(self) -> DataFrame:
        return self.progress.filter("source_high_water_mark > target_high_water_mark").selectExpr(
            "job_id", "source_topic", "target_topic", "partition_id", "target_high_water_mark AS gap_start_offset",
            "source_high_water_mark AS gap_end_offset",
            "source_high_water_mark - target_high_water_mark AS gap_size", "last_updated AS detected_at",
            "IF(source_high_water_mark % 2 = 0, 'resolved', 'unresolved') AS resolution_status",
        )

    @cached_property
    def resume(self) -> DataFrame:
        return self.progress.filter("target_high_water_mark % 5 <> 0").selectExpr(
            "job_id", "source_topic", "partition_id", "target_high_water_mark AS safe_resume_offset",
            "last_updated AS calculated_at", "'pending' AS validation_status",
        )

    @cached_property
    def analyses(self) -> DataFrame:
        return self.progress.groupBy("job_id", F.col("last_updated").alias("analyzed_at")).agg(
            F.count_if(F.col("source_high_water_mark") > F.col("target_high_water_mark")).alias("gaps")
        )

    @cached_property
    def ops_events(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id", "ts",
            "CASE event_type WHEN 'view' THEN 'auth_login' WHEN 'error' THEN 'auth_failed' "
            "WHEN 'click' THEN 'permission_denied' WHEN 'purchase' THEN 'config_change' ELSE 'job_created' END "
            "AS event_type",
            "IF(user_id % 10 = 0, 'system', concat('user-', user_id)) AS initiator",
            "props AS details",
        )

    @cached_property
    def audit_requests(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id", "ts",
            "CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'DELETE' END AS method",
            "CASE event_type WHEN 'view' THEN '/api/v1/jobs' WHEN 'click' THEN '/api/v1/clusters' "
            "WHEN 'purchase' THEN '/api/v1/config' WHEN 'signup' THEN '/api/v1/users' "
            "ELSE concat('/api/v1/jobs/', user_id, '/start') END AS path",
            "IF(user_id % 7 = 0, 403, 200) AS status",
            "IF(user_id % 11 = 0, NULL, concat('user-', user_id)) AS username",
            """concat('{"name": "n', event_id, '", "api_key": "k', user_id, '", "note": "',
                      md5(CAST(event_id AS STRING)), '"}') AS body""",
        )

    @cached_property
    def insights(self) -> DataFrame:
        return self.table("documents").join(self.table("labels"), "doc_id", "left").selectExpr(
            "doc_id AS id", "concat('job-', doc_id % 8) AS job_id",
            "CASE doc_id % 5 WHEN 0 THEN 'anomaly' WHEN 1 THEN 'optimization' WHEN 2 THEN 'recommendation' "
            "WHEN 3 THEN 'log_analysis' ELSE 'throttling_adjustment' END AS insight_type",
            "CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END "
            "AS severity_level",
            "IF(doc_id % 6 = 0, 0L, n_chars) AS response_time_ms", "CAST(quality AS DOUBLE) AS accuracy_score",
            "CASE doc_id % 7 WHEN 0 THEN 'very Helpful' WHEN 1 THEN 'not accurate' WHEN 2 THEN 'noise' END "
            "AS user_feedback",
            "IF(doc_id % 3 = 0, 'resolved', 'new') AS resolution_status",
            "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, CAST(doc_id % 720 AS INT)) AS ts",
        )

    @cached_property
    def log_lines(self) -> DataFrame:
        return self.events.selectExpr(
            "event_id",
            """CASE WHEN event_id % 50 = 49 THEN concat('malformed ', event_id) ELSE concat(
                 '[', rpad(CAST(ts AS STRING), 23, '0'), '] ',
                 CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARN ' ELSE 'INFO ' END,
                 ' [consumer.go:', event_id % 500, '] ',
                 CASE event_id % 3
                   WHEN 0 THEN concat('[AI:metrics:milestone] [job:job-', user_id % 8, '] ')
                   WHEN 1 THEN concat('[AI:incident:start] [job:job-', user_id % 8, '] [component:producer] ')
                   ELSE '' END,
                 'value=', user_id) END AS line""",
        )

    @cached_property
    def topic_inv(self) -> DataFrame:
        part = self.table("part")
        name = "concat(IF(p_partkey % 25 = 0, '__t', 't'), p_partkey) AS topic_name"
        source = part.selectExpr(
            "'source' AS cluster_type", name, "p_size AS partition_count",
            "CAST(p_partkey % 5 AS INT) AS replication_factor",
            "CASE p_partkey % 7 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zstd' WHEN 2 THEN 'producer' "
            "WHEN 3 THEN 'uncompressed' END AS compression_raw",
        )
        target = part.filter("p_partkey % 40 <> 0").selectExpr(
            "'target' AS cluster_type", name, "p_size + IF(p_partkey % 10 = 0, 1, 0) AS partition_count",
            "CAST(least(p_partkey % 5, 3) AS INT) AS replication_factor",
            "CASE p_partkey % 6 WHEN 0 THEN 'gzip' WHEN 1 THEN 'zstd' END AS compression_raw",
        )
        return source.unionByName(target)

    @cached_property
    def partitions_inv(self) -> DataFrame:
        base = self.table("orders").selectExpr("o_orderkey", "concat('t', o_custkey % 50) AS topic_name")
        numbered = along(base, ["topic_name"], ["o_orderkey"], block_of("o_orderkey"), running={"n": F.lit(1)})
        return numbered.selectExpr(
            "topic_name", "CAST(n - 1 AS INT) AS partition_id", "CAST(1 + o_orderkey % 3 AS INT) AS leader_id",
            "'[1,2,3]' AS replica_ids",
            "CASE o_orderkey % 997 WHEN 0 THEN '[1]' WHEN 5 THEN '[1,2]' ELSE '[1,2,3]' END AS isr_ids",
        )

    @cached_property
    def clusters(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "concat('cluster-', s_suppkey) AS name",
            "CASE s_suppkey % 4 WHEN 0 THEN 'confluent' WHEN 1 THEN 'redpanda' WHEN 2 THEN 'azure' ELSE 'plain' END "
            "AS provider",
            "concat('lkc-', s_suppkey % 37) AS cluster_id",
            "CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' ELSE 'archived' END AS status",
            "TIMESTAMP_NTZ'2024-01-31 00:00:00' - make_dt_interval(CAST(s_suppkey % 10 AS INT)) AS updated_at",
        )

    @cached_property
    def connections(self) -> DataFrame:
        return self.clusters.selectExpr("name", "provider", "IF(provider = 'plain', 'abc', md5(name)) AS api_key")

    @cached_property
    def jobs(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "concat('job-', n_nationkey) AS job_id", "n_name AS name",
            "concat('cluster-', n_nationkey % 9 + 1) AS source_cluster_name",
            "concat('cluster-', (n_nationkey + 4) % 9 + 1) AS target_cluster_name",
            "CASE n_nationkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' ELSE 'failed' END AS status",
            "100 * (n_nationkey % 20 + 1) AS batch_size", "n_nationkey % 20 + 1 AS parallelism",
        )

    @cached_property
    def rbac_user_roles(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS user_id", "c_name AS username", "CAST(c_custkey % 5 AS INT) AS role_id"
        )

    @cached_property
    def rbac_role_permissions(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "n_regionkey AS role_id", "n_nationkey AS permission_id", "n_name AS permission"
        )

    @cached_property
    def calendar(self) -> DataFrame:
        return self.events.select(
            F.explode(F.array(F.lit("daily"), F.lit("weekly"), F.lit("monthly"))).alias("period"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("now_ts"),
        ).distinct()
