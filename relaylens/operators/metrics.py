"""Metric samples and points: deltas of cumulative counters, totals, rollups, recent windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions import steps
from relaylens.functions.dated import on_days
from relaylens.functions.timeline import SPAN, along, hour_of

# Cumulative counters of a sample, and the delta column each becomes in a metric point.
COUNTERS = {
    "messages_replicated": "messages_replicated_delta",
    "bytes_transferred": "bytes_transferred_delta",
    "messages_consumed": "messages_consumed_delta",
    "bytes_consumed": "bytes_consumed_delta",
    "error_count": "error_count_delta",
}

# History ranges offered to users; anything else means two hours.
HISTORY_RANGES = {"2h": "INTERVAL 2 HOURS", "24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}


def within(ts: str, as_of: Column, span: str) -> Column:
    """Rows of the half-open past ``(as_of - span, as_of]``."""
    return (F.col(ts) > as_of - F.expr(span)) & (F.col(ts) <= as_of)


def counter_deltas(
    samples: DataFrame, *, order: Sequence[str] = ("ts",), ts: str = "ts", chunk: Column | None = None
) -> DataFrame:
    """Cumulative samples to metric points, reset-aware: a falling counter restarts from its raw value."""
    stepped = along(
        samples, ["job_id"], order, hour_of(ts) if chunk is None else chunk,
        previous={f"prev_{c}": F.col(c) for c in COUNTERS},
    )
    return deltas_of(stepped, samples.columns)


def deltas_of(stepped: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Metric points of samples that have the previous sample's counters as ``prev_*``; ``columns`` are those of the samples."""

    def delta(counter: str) -> Column:
        now, before = F.col(counter), F.col(f"prev_{counter}")
        return F.when(now < before, now).otherwise(now - F.coalesce(before, F.lit(0)))

    kept = [c for c in columns if c not in (*COUNTERS, "current_lag")]
    return stepped.select(
        *kept, *[delta(c).alias(d) for c, d in COUNTERS.items()], F.col("current_lag").alias("avg_lag")
    )


# --- Deltas against the running sum of earlier deltas -------------------------------------------
#
# In compatibility mode a sample is compared with the sum of all deltas stored so far, which depends on all earlier rows. Stretches
# of samples become functions of the incoming sum (see functions/steps.py), which compose in a tree: blocks of rows, chunks, spans
# of chunks, jobs. Down the tree go the sums before each of them, so no task holds the rows or the chunks of a whole job.

BLOCK = 256  # rows


def counter_deltas_against_total(
    samples: DataFrame, *, order: Sequence[str] = ("ts",), ts: str = "ts", chunk: Column | None = None
) -> DataFrame:
    """Like :func:`counter_deltas`, but each delta is taken against the sum of the earlier deltas.

    Rows without a job or a time are kept: those without a job are a series of their own, those without a time come first.
    A missing counter gives a null delta and leaves its total as it is. Rows that tie in ``order`` are put in order by their counters.
    """
    names = list(COUNTERS)
    kept = [c for c in samples.columns if c not in (*COUNTERS, "current_lag")]
    at = F.coalesce(hour_of(ts) if chunk is None else chunk, F.lit(-(1 << 63))).cast("long")
    # a missing counter counts as 0, which leaves the total as it is
    counts = F.struct(*[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    lean = samples.select(
        F.struct("job_id").alias("key"), at.alias("chunk"), F.struct(*order).alias("at"), counts.alias("x"),
        F.struct(*kept, "current_lag", *[F.col(n).isNull().alias(f"missing_{n}") for n in names]).alias("row"),
    ).repartition("key", "chunk")
    numbered = lean.withColumn("place", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("at", "x")))
    blocks = numbered.groupBy("key", "chunk", F.expr(f"(place - 1) DIV {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "x", "row"))).alias("rows"))

    def each(make: Callable[[str], Column]) -> Column:
        return F.struct(*[make(n).alias(n) for n in names])

    def functions_of(parts: str, part: str) -> Callable[[str], Column]:
        return lambda n: steps.of_functions(F.transform(F.col(parts), lambda p: p[part][n]))

    def listed(rows: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
        """The parts of each of ``keys`` in order."""
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(number, "f"))).alias("parts"))

    def handed_down(parts: DataFrame, total: Callable[[str], Column], number: str) -> DataFrame:
        """The parts as rows, each with the totals before it as ``total``."""
        before = F.struct(*[steps.starts(F.transform("parts", lambda p: p["f"][n]), total(n)).alias(n) for n in names])
        rows = parts.withColumn("before", before).select("*", F.posexplode("parts").alias("k", "part"))
        totals = each(lambda n: F.col(f"before.{n}")[F.col("k")])
        return rows.select("key", *[c for c in ("span", "chunk") if c in parts.columns], F.col(f"part.{number}").alias(number), totals.alias("total"))

    in_blocks = blocks.withColumn("f", each(lambda n: steps.of_samples(F.transform("rows", lambda r: r["x"][n]))))
    chunks = listed(in_blocks.drop("rows"), ("key", "chunk"), "block").select(
        "key", "chunk", each(functions_of("parts", "f")).alias("f"), F.coalesce(F.expr(f"chunk DIV {SPAN}"), F.lit(0)).alias("span")
    ).repartition("key", "span")
    spans = listed(chunks, ("key", "span"), "chunk").select("key", "span", each(functions_of("parts", "f")).alias("f"))
    span_totals = handed_down(listed(spans, ("key",), "span"), lambda n: F.lit(0).cast("long"), "span")
    chunk_totals = handed_down(
        listed(chunks, ("key", "span"), "chunk").join(span_totals, ["key", "span"]), lambda n: F.col(f"total.{n}"), "chunk"
    ).select("key", "chunk", "total")
    block_totals = handed_down(
        listed(in_blocks.drop("rows"), ("key", "chunk"), "block").join(chunk_totals, ["key", "chunk"]), lambda n: F.col(f"total.{n}"), "block"
    )
    found = blocks.join(block_totals, ["key", "chunk", "block"]).select("rows", F.struct(*[
        steps.deltas(F.transform("rows", lambda r: r["x"][n]), F.col(f"total.{n}")).alias(d) for n, d in COUNTERS.items()
    ]).alias("d")).select("d", F.posexplode("rows").alias("k", "r"))
    return found.select(
        *[F.col("r.row").getField(c).alias(c) for c in kept],
        *[F.when(~F.col(f"r.row.missing_{n}"), F.col(f"d.{d}")[F.col("k")]).alias(d) for n, d in COUNTERS.items()],
        F.col("r.row.current_lag").alias("avg_lag"),
    )


def downsample_by_minute(samples: DataFrame, *, ts: str = "ts") -> DataFrame:
    """Cumulative counters to one point per job and minute: MAX - MIN inside the minute, average lag."""
    return samples.groupBy("job_id", F.date_trunc("minute", ts).cast("timestamp_ntz").alias("minute")).agg(
        *[(F.max(c) - F.min(c)).alias(d) for c, d in COUNTERS.items()],
        F.round(F.sum("current_lag") / F.count("current_lag"), 6).alias("avg_lag"),
    )


def current_totals(points: DataFrame, jobs: DataFrame, *, order: Sequence[str] = ("ts",), ts: str = "ts") -> DataFrame:
    """Totals per job with the newest lag and time; jobs without points count as zero."""
    position = F.struct(*order) if len(order) > 1 else F.col(order[0])
    totals = points.groupBy("job_id").agg(
        *[F.sum(d).alias(c) for c, d in COUNTERS.items()],
        F.max_by("avg_lag", position).alias("newest_lag"),
        F.max(ts).alias("last_sample_at"),
    )
    return (
        jobs.select("job_id")
        .join(totals, "job_id", "left")
        .select(
            "job_id",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS],
            F.coalesce("newest_lag", F.lit(0)).alias("current_lag"),
            "last_sample_at",
        )
    )


def rollup(points: DataFrame, granularity: str, *, as_of: Column, days: int = 30, ts: str = "ts") -> DataFrame:
    """Hourly or daily sums of messages and errors and the average lag; unknown granularities mean daily."""
    label = "yyyy-MM-dd HH:00:00" if granularity == "hourly" else "yyyy-MM-dd"
    unit = "hour" if granularity == "hourly" else "day"
    since = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = on_days(points, ts, since).filter(F.col(ts) >= since)
    return (
        recent.groupBy("job_id", F.date_trunc(unit, ts).alias("start"))
        .agg(
            F.sum("messages_replicated_delta").alias("messages_total"),
            F.round(F.sum("avg_lag") / F.count("avg_lag"), 6).alias("avg_lag"),
            F.sum("error_count_delta").alias("total_errors"),
        )
        .select("job_id", F.date_format("start", label).alias("period"), "messages_total", "avg_lag", "total_errors")
    )


def history(points: DataFrame, *, as_of: Column, span: str = "2h", job_id: str | None = None, ts: str = "ts") -> DataFrame:
    """Points of the last 2h, 24h, 7d or 30d, both ends included, oldest first."""
    start = as_of - F.expr(HISTORY_RANGES.get(span, HISTORY_RANGES["2h"]))
    rows = on_days(points, ts, start, as_of).filter(F.col(ts).between(start, as_of))
    if job_id is not None:
        rows = rows.filter(F.col("job_id") == job_id)
    return rows.orderBy(ts)


def newest_per_job(points: DataFrame, n: int, *, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The newest ``n`` points of each job, with ``newest_rank`` 1 for the newest."""
    by_job = Window.partitionBy("job_id").orderBy(*[F.col(c).desc() for c in order])
    return points.withColumn("newest_rank", F.row_number().over(by_job)).filter(F.col("newest_rank") <= n)


def recent_summary(
    points: DataFrame, *, as_of: Column, minutes: int = 30, limit: int = 100, order: Sequence[str] = ("ts",), ts: str = "ts"
) -> DataFrame:
    """Per job over its newest ``limit`` points of the last ``minutes``: sums, highest lag, messages per second."""
    recent = points.filter((F.col(ts) >= as_of - F.expr(f"INTERVAL {int(minutes)} MINUTES")) & (F.col(ts) <= as_of))
    return newest_per_job(recent, limit, order=order).groupBy("job_id").agg(
        F.sum("messages_replicated_delta").alias("total_messages"),
        F.sum("bytes_transferred_delta").alias("total_bytes"),
        F.round(F.sum("messages_replicated_delta") / F.lit(float(minutes * 60)), 6).alias("avg_throughput"),
        F.max("avg_lag").alias("max_lag"),
        F.sum("error_count_delta").alias("total_errors"),
        F.count(F.lit(1)).alias("data_points"),
        F.max(ts).alias("latest"),
    )


def traffic(records: DataFrame) -> DataFrame:
    """Records and bytes consumed, produced and failed per job; failed sends count as consumed only."""
    size = F.octet_length("rec_value") + F.coalesce(F.octet_length("rec_key"), F.lit(0))
    sent = ~F.col("send_failed")
    return records.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("records_consumed"),
        F.sum(size).cast("long").alias("bytes_consumed"),
        F.count_if(sent).alias("records_produced"),
        F.coalesce(F.sum(F.when(sent, size)), F.lit(0)).cast("long").alias("bytes_produced"),
        F.count_if(F.col("send_failed")).alias("error_count"),
    )


def job_health(totals: DataFrame, *, lag_limit: int = 10_000) -> DataFrame:
    """Health label of each job from its current totals."""
    label = (
        F.when(F.col("error_count") > 0, "errors").when(F.col("current_lag") > lag_limit, "high_lag").otherwise("healthy")
    )
    return totals.select("job_id", "error_count", "current_lag", label.alias("health"))
