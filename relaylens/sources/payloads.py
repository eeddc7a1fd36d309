"""Metric samples in the formats of monitoring systems, and their delivery to a writer.

The functions shape rows; sending them is the job of the writer given to :func:`fan_out`. All of them
take samples with the incident flags (``detect.flagged_samples``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUES = ("messages_replicated", "bytes_transferred", "messages_consumed", "bytes_consumed", "current_lag", "error_count")
FLAGS = ("source_stalled", "target_stalled", "critical_lag", "high_error_rate", "error_spike")


def gauges(samples: DataFrame, *, key: tuple[str, ...] = ("job_id", "ts"), prefix: str = "relaylens") -> DataFrame:
    """Long form: one row per sample and gauge; flags become 0 or 1."""
    pairs = [
        *[F.struct(F.lit(f"{prefix}_{v}").alias("metric"), F.col(v).cast("double").alias("value")) for v in VALUES],
        *[F.struct(F.lit(f"{prefix}_incident_{f}").alias("metric"), F.col(f).cast("double").alias("value")) for f in FLAGS],
    ]
    return samples.select(*key, F.explode(F.array(*pairs)).alias("g")).select(*key, "g.metric", "g.value")


def exposition_lines(gauge_rows: DataFrame) -> DataFrame:
    """Gauges in the text exposition format; label values are escaped."""
    label = F.replace(F.replace(F.replace("job_id", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return gauge_rows.select(F.format_string('%s{job_id="%s"} %s', "metric", label, F.col("value").cast("string")).alias("value"))


def log_stream_lines(samples: DataFrame, *, key: tuple[str, ...] = ("job_id", "ts"), ts: str = "ts") -> DataFrame:
    """A nanosecond timestamp and a ``name=value`` line per sample, as log stores take them."""
    line = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in (*VALUES, *FLAGS)])
    ns = (F.unix_micros(F.col(ts).cast("timestamp")) * 1000).cast("string")
    return samples.select(*key, ns.alias("ts_ns"), line.alias("line"))


def log_stream_bodies(lines: DataFrame) -> DataFrame:
    """Request bodies: a stream labelled with the job and holding one line."""
    stream = F.struct(F.struct("job_id").alias("stream"), F.array(F.array("ts_ns", "line")).alias("values"))
    return lines.select(F.to_json(F.struct(F.array(stream).alias("streams"))).alias("value"))


def event_envelopes(
    samples: DataFrame, *, key: tuple[str, ...] = ("job_id", "ts"), source: str = "relaylens", index: str = "main"
) -> DataFrame:
    """Samples as JSON events with source, source type and index beside them."""
    event = F.to_json(F.struct("job_id", *VALUES, *FLAGS))
    return samples.select(
        *key, event.alias("event"), F.lit(source).alias("source"), F.lit("_json").alias("sourcetype"), F.lit(index).alias("index")
    )


def event_bodies(envelopes: DataFrame) -> DataFrame:
    """Envelopes as request bodies; the event goes in as it is, not quoted once more."""
    head = F.to_json(F.struct("source", "sourcetype", "index"))
    return envelopes.select(F.concat(F.lit('{"event":'), "event", F.lit(","), F.substring(head, 2, 1 << 30)).alias("value"))


def shaped(samples: DataFrame, sink: str, **options: str) -> DataFrame:
    """One ``value`` text per payload, for ``prometheus``, ``loki`` or ``splunk``."""
    shapes: dict[str, Callable[[], DataFrame]] = {
        "prometheus": lambda: exposition_lines(gauges(samples, **options)),
        "loki": lambda: log_stream_bodies(log_stream_lines(samples)),
        "splunk": lambda: event_bodies(event_envelopes(samples, **options)),
    }
    if sink not in shapes:
        raise ValueError(f"unknown metric sink: {sink}")
    return shapes[sink]()


def text_writer(path: str) -> Callable[[DataFrame, int], None]:
    """The default writer: payloads as text files, a folder per batch, so that a repeated batch replaces itself."""
    return lambda payloads, batch_id: payloads.write.mode("overwrite").text(f"{path}/batch={batch_id}")


def fan_out(sink: str, writer: Callable[[DataFrame, int], None], **options: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that shapes the samples of a batch and hands them to ``writer``."""
    return lambda samples, batch_id: writer(shaped(samples, sink, **options), batch_id)
