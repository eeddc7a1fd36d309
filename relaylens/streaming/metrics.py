"""Metric streams: rollups, deltas, incidents, the analysis gate, latest state, payload delivery."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from relaylens.functions.timeline import hour_of
from relaylens.operators import detect, metrics
from relaylens.streaming import chunks
from relaylens.streaming.mirror import BatchWriter, reading_once

WATCHED = ("messages_replicated_delta", "avg_lag", "error_count_delta")


def rollup_windows(points: DataFrame, *, every: str = "1 hour", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Messages, average lag and errors per job and tumbling window of a stream of metric points."""
    return (
        points.withWatermark(ts, delay).groupBy("job_id", F.window(ts, every))
        .agg(
            F.sum("messages_replicated_delta").alias("messages_total"),
            F.round(F.sum("avg_lag") / F.count("avg_lag"), 6).alias("avg_lag"),
            F.sum("error_count_delta").alias("total_errors"),
        )
        .select("job_id", F.col("window.start").alias("window_start"), "messages_total", "avg_lag", "total_errors")
    )


HOUR = 3600


def _after_last(ts: str):
    """Chunks in which each job's last row comes before everything that is held."""
    return F.when(F.col("in_batch") == 0, F.lit(-(1 << 62))).otherwise(hour_of(ts))


def _with_last(held: DataFrame, last: DataFrame) -> DataFrame:
    return held.withColumn("in_batch", F.lit(1)).unionByName(last.withColumn("in_batch", F.lit(0)), allowMissingColumns=True)


def start_deltas(
    samples: DataFrame, checkpoint: str, write: BatchWriter, *, order: Sequence[str] = ("ts",), ts: str = "ts",
    delay_seconds: float = 600, write_late: BatchWriter | None = None, trigger: dict | None = None,
) -> chunks.ChunkedQuery:
    """Cumulative samples to metric points, hour by hour as the watermark passes.

    A sample that comes within ``delay_seconds`` of the newest takes its place in the order; a later one, or one without a time, goes to ``write_late``.
    """
    hours = chunks.Chunks(samples, ts=ts, order=order, values=list(metrics.COUNTERS), width_seconds=HOUR, delay_seconds=delay_seconds)

    def run(batch: DataFrame, batch_id: int) -> None:
        write(metrics.deltas_of(hours.stepped(batch).drop("tick"), samples.columns), batch_id)

    def rest(held: DataFrame, last: DataFrame, batch_id: int) -> None:
        points = metrics.counter_deltas(_with_last(held, last.drop("n")), order=("in_batch", *order), chunk=_after_last(ts))
        write(points.filter("in_batch = 1").drop("in_batch"), batch_id)

    return hours.start(run, rest, checkpoint, trigger, write_late)


def _start_ticks(
    samples: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], order: Sequence[str], ts: str, delay_seconds: float,
    write_late: BatchWriter | None, trigger: dict | None,
) -> chunks.ChunkedQuery:
    """``write`` gets samples numbered per job, with the previous sample's values, as :func:`relaylens.operators.detect.ticks` gives them."""
    hours = chunks.Chunks(samples, ts=ts, order=order, values=detect.TICK_VALUES, width_seconds=HOUR, delay_seconds=delay_seconds)

    def rest(held: DataFrame, last: DataFrame, batch_id: int) -> None:
        rows = _with_last(held, last)
        numbered = detect.ticks(rows, order=("in_batch", *order), ts=ts, chunk=_after_last(ts), weight=F.coalesce("n", F.lit(1)))
        write(numbered.filter("in_batch = 1").drop("in_batch", "n"), batch_id)

    return hours.start(lambda batch, batch_id: write(hours.stepped(batch), batch_id), rest, checkpoint, trigger, write_late)


def start_incidents(
    samples: DataFrame, checkpoint: str, write: BatchWriter, *, rearm_every: int | None = None,
    order: Sequence[str] = ("ts",), ts: str = "ts", delay_seconds: float = 600, write_late: BatchWriter | None = None,
    trigger: dict | None = None,
) -> chunks.ChunkedQuery:
    """Edges of the incident flags, ticks in order of time, hour by hour as the watermark passes."""
    def edges(numbered: DataFrame, batch_id: int) -> None:
        write(detect.incident_edges(numbered, order=order, ts=ts, rearm_every=rearm_every), batch_id)

    return _start_ticks(samples, checkpoint, edges, order, ts, delay_seconds, write_late, trigger)


def start_payloads(
    samples: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None], *, order: Sequence[str] = ("ts",),
    ts: str = "ts", delay_seconds: float = 600, write_late: BatchWriter | None = None, trigger: dict | None = None,
) -> chunks.ChunkedQuery:
    """Samples with their incident flags to ``deliver`` (see ``payloads.fan_out``), in order of time."""
    def flagged(numbered: DataFrame, batch_id: int) -> None:
        deliver(detect.with_flags(numbered.select(*samples.columns, "tick")), batch_id)

    return _start_ticks(samples, checkpoint, flagged, order, ts, delay_seconds, write_late, trigger)


def start_analysis_gate(
    points: DataFrame, checkpoint: str, write: BatchWriter, *, every_seconds: int = 300, order: Sequence[str] = ("ts",),
    ts: str = "ts", delay_seconds: float = 600, write_late: BatchWriter | None = None, trigger: dict | None = None,
) -> chunks.ChunkedQuery:
    """Ticks at which a job is due for a new analysis, as :func:`relaylens.operators.detect.analysis_gate` finds them.

    A tick's newest point is all that is kept of it; a timer decides on it once the watermark has passed the tick, so a backlog read in one
    micro-batch fires as often as the same points read one by one.
    """
    lean = points.select(*dict.fromkeys(["job_id", ts, *order, *WATCHED]))
    ticks = chunks.Chunks(lean, ts=ts, order=order, values=WATCHED, width_seconds=every_seconds, delay_seconds=delay_seconds, newest=True)

    def run(batch: DataFrame, batch_id: int) -> None:
        stepped = ticks.stepped(batch)
        same = F.col("tick") > 1
        for w in WATCHED:
            same = same & F.col(w).eqNullSafe(F.col(f"prev_{w}"))
        write(stepped.filter(~same).select("job_id", detect.tick_end(ts, every_seconds).alias("tick_at"), *WATCHED), batch_id)

    def rest(held: DataFrame, last: DataFrame, batch_id: int) -> None:
        last = last.drop("n")
        due = detect.analysis_gate(held.unionByName(last), every_seconds=every_seconds, order=order, ts=ts)
        decided = last.select("job_id", detect.tick_end(ts, every_seconds).alias("tick_at"))
        write(due.join(decided, ["job_id", "tick_at"], "left_anti").select(due.columns), batch_id)

    return ticks.start(run, rest, checkpoint, trigger, write_late)


def start_latest(
    rows: DataFrame, checkpoint: str, write_history: BatchWriter, *, keys: Sequence[str], order: Sequence[str], trigger: dict | None = None,
) -> tuple[StreamingQuery, Callable[[int], DataFrame]]:
    """Append every row to the history and keep the newest row per key in the query's state.

    Returns the query and a function giving the current rows as of a batch, which reads that state.
    """
    names, fields = rows.columns, rows.schema.fields
    numbered = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    schema = T.StructType([T.StructField(f"c{k}", f.dataType) for k, f in enumerate(fields)])
    by = [F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keys)]
    newest = chunks.NewestRow(schema, len(by), [names.index(c) for c in order])
    kept = rows.select(*by, *numbered).groupBy(*[f"k{k}" for k in range(len(by))]).transformWithState(newest, schema, "Append", "None")
    place = f"{checkpoint}/offsets"
    back = [F.col(f"c{k}").alias(c) for k, c in enumerate(names)]

    def current(batch_id: int) -> DataFrame:
        found = chunks.state(rows.sparkSession, place, "newest", batch_id)
        if found is None:
            return rows.sparkSession.createDataFrame([], rows.schema)
        return found.select("value.*").select(*back)

    query = chunks.started(kept, reading_once(lambda batch, batch_id: write_history(batch.select(*back), batch_id)), place, trigger)
    return query, current
