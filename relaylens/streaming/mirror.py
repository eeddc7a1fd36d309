"""Record streams: mirroring, duplicate suppression, traffic windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from relaylens.operators import mapping

BatchWriter = Callable[[DataFrame, int], None]


def parquet_writer(path: str) -> BatchWriter:
    """Writes each micro-batch to its own folder, so that a repeated batch replaces itself."""
    return lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def reading_once(run: BatchWriter) -> BatchWriter:
    """``run`` on a cached micro-batch, as it uses the rows more than once and the source is read each time."""

    def cached(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            run(rows, batch_id)
        finally:
            rows.unpersist()

    return cached


def mirror_batch(
    records: DataFrame, rules: DataFrame, target_partitions: DataFrame, *, preserve_partitions: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Mirrored and rejected records of a micro-batch, for every job whose rules name their topic."""
    routes = mapping.topic_map(mapping.resolve_mappings(records.select("topic"), rules))
    return _split(records, routes, target_partitions, preserve_partitions)


def _split(records: DataFrame, routes: DataFrame, target_partitions: DataFrame, preserve_partitions: bool) -> tuple[DataFrame, DataFrame]:
    mirrored = mapping.mirror(records, routes, target_partitions, preserve_partitions=preserve_partitions)
    return mirrored, mapping.rejected(records, routes)


def start_mirror(
    records: DataFrame,
    rules: Callable[[], DataFrame],
    target_partitions: Callable[[], DataFrame],
    checkpoint: str,
    write_mirrored: BatchWriter,
    write_rejected: BatchWriter,
    *,
    preserve_partitions: bool = True,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Mirror a stream of records (``kafka.as_records``). The rules are read anew for every micro-batch.

    The checkpoint is the resume position; a batch that is repeated after a failure is written again, so
    delivery to Kafka is at least once and to :func:`parquet_writer` exactly once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        # the map is derived once for both outputs and kept for this micro-batch only
        routes = mapping.topic_map(mapping.resolve_mappings(batch.select("topic"), rules())).persist()
        try:
            mirrored, rejects = _split(batch, routes, target_partitions(), preserve_partitions)
            write_mirrored(mirrored, batch_id)
            write_rejected(rejects, batch_id)
        finally:
            routes.unpersist()

    return (
        records.writeStream.foreachBatch(reading_once(run)).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )


def without_replays(records: DataFrame, *, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Records of an at-least-once stream once per (topic, partition, offset)."""
    return records.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["topic", "partition_id", "rec_offset"])


def observed(records: DataFrame, name: str = "traffic") -> DataFrame:
    """The same records; each micro-batch's progress report carries their number and bytes under ``name``."""
    return records.observe(name, F.count(F.lit(1)).alias("records"), F.sum(_size()).cast("long").alias("bytes"))


def _size() -> Column:
    return F.coalesce(F.octet_length("rec_key"), F.lit(0)) + F.coalesce(F.octet_length("rec_value"), F.lit(0))


def traffic_windows(records: DataFrame, *, every: str = "10 seconds", delay: str = "1 minute", ts: str = "ts") -> DataFrame:
    """Records and bytes per topic and tumbling window; rows later than ``delay`` are left out."""
    return (
        records.withWatermark(ts, delay).groupBy(F.window(ts, every), "topic")
        .agg(F.count(F.lit(1)).alias("records"), F.sum(_size()).cast("long").alias("bytes"))
        .select(F.col("window.start").alias("window_start"), "topic", "records", "bytes")
    )
