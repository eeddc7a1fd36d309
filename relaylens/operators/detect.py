"""Detection over metric series: anomalies, incidents, milestones, failure runs, throttling advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.functions.ratios import error_rate_over, error_rate_under
from relaylens.functions.timeline import along, hour_of
from relaylens.operators.metrics import newest_per_job, within

# Fixed value: advice for a job without throughput.
ZERO_THROUGHPUT_ADVICE = "Zero throughput detected. Consider using 'jobs restart-force' to recover the job."

STALL_KINDS = ("source_stalled", "target_stalled")
TICK_VALUES = ("current_lag", "messages_consumed", "messages_replicated", "error_count")


def anomalies(
    points: DataFrame,
    *,
    as_of: Column,
    span: str = "INTERVAL 10 MINUTES",
    newest: int = 10,
    min_points: int = 3,
    drop_share: float = 0.30,
    lag_factor: float = 2.0,
    lag_limit: float = 1000.0,
    error_percent: float = 0.5,
    order: Sequence[str] = ("ts",),
    ts: str = "ts",
) -> DataFrame:
    """Compare the newer half of each job's newest points with the older half; first rule that holds wins."""
    recent = newest_per_job(points.filter(within(ts, as_of, span)), newest, order=order)
    sized = recent.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("job_id")))
    is_new = F.col("newest_rank") <= F.floor(F.col("n") / 2)
    messages, lag = F.col("messages_replicated_delta"), F.col("avg_lag")

    def mean(value: Column, member: Column) -> Column:
        return F.try_divide(F.sum(F.when(member, value)).cast("double"), F.count_if(member))

    halves = sized.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("points"),
        mean(messages, is_new).alias("recent_throughput"),
        mean(messages, ~is_new).alias("baseline_throughput"),
        mean(lag, is_new).alias("recent_lag"),
        mean(lag, ~is_new).alias("baseline_lag"),
        F.sum(messages).alias("messages"),
        F.sum("error_count_delta").alias("errors"),
    )
    recent_t, base_t = F.col("recent_throughput"), F.col("baseline_throughput")
    recent_l, base_l = F.col("recent_lag"), F.col("baseline_lag")
    kind = (
        F.when(F.col("points") < min_points, "none")
        .when((recent_t == 0) & (base_t > 0), "zero_throughput")
        .when((base_t > 0) & (F.try_divide(base_t - recent_t, base_t) > drop_share), "throughput_drop")
        .when(((base_l > 0) & (recent_l > base_l * lag_factor)) | (recent_l > lag_limit), "lag_spike")
        .when(error_rate_over(F.col("errors"), F.col("messages"), error_percent), "high_error_rate")
        .otherwise("none")
    )
    means = ("recent_throughput", "baseline_throughput", "recent_lag", "baseline_lag")
    return halves.withColumn("anomaly_kind", kind).withColumns({m: F.round(m, 6) for m in means})


def zero_throughput_advice(found: DataFrame) -> DataFrame:
    """An insight for each job of :func:`anomalies` that shows an anomaly and moved no message at all."""
    return found.filter((F.col("anomaly_kind") != "none") & (F.col("messages") == 0)).select(
        "job_id", F.lit("recommendation").alias("insight_type"), F.lit("high").alias("severity_level"),
        F.lit("system-rule").alias("ai_model"), F.lit(ZERO_THROUGHPUT_ADVICE).alias("recommendation"),
    )


def incident_flags(
    tick: Column, lag: Column, consumed: Column, produced: Column, errors: Column, *, rearm_every: int | None = None
) -> dict[str, Column]:
    """The five incident conditions of one sample. ``rearm_every`` reports error spikes every n-th tick."""
    spike = errors > 0
    return {
        "critical_lag": lag > 200,
        "high_error_rate": (errors > 0) & (produced > 0) & (errors.cast("double") > produced * F.lit(0.1)),
        "source_stalled": (tick > 6) & (consumed == 0),
        "target_stalled": (tick > 6) & (consumed > 0) & (produced == 0),
        "error_spike": spike if rearm_every is None else spike & (tick % rearm_every == 0),
    }


def ticks(
    samples: DataFrame,
    *,
    order: Sequence[str] = ("ts",),
    ts: str = "ts",
    chunk: Column | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """Samples numbered per job (``tick``), with the previous sample's values as ``prev_*``.

    ``weight`` is how far a sample moves the tick; by default 1.
    """
    return along(
        samples, ["job_id"], order, hour_of(ts) if chunk is None else chunk,
        running={"tick": F.lit(1) if weight is None else weight}, previous={f"prev_{v}": F.col(v) for v in TICK_VALUES},
    )


def with_flags(numbered: DataFrame) -> DataFrame:
    """Numbered samples with the five incident flags as columns."""
    flags = incident_flags(
        F.col("tick"), F.col("current_lag"), F.col("messages_consumed"), F.col("messages_replicated"), F.col("error_count")
    )
    return numbered.select(*numbered.columns, *[flag.alias(name) for name, flag in flags.items()])


def flagged_samples(
    samples: DataFrame, *, order: Sequence[str] = ("ts",), ts: str = "ts", chunk: Column | None = None
) -> DataFrame:
    """Samples with their tick and incident flags."""
    return with_flags(ticks(samples, order=order, ts=ts, chunk=chunk).select(*samples.columns, "tick"))


def incident_edges(
    numbered: DataFrame, *, order: Sequence[str] = ("ts",), ts: str = "ts", rearm_every: int | None = None
) -> DataFrame:
    """Edges of the incident flags of numbered samples: ``raised`` at a start, ``resolved`` at the end of a stall."""
    now = incident_flags(
        F.col("tick"), F.col("current_lag"), F.col("messages_consumed"), F.col("messages_replicated"),
        F.col("error_count"), rearm_every=rearm_every,
    )
    before = incident_flags(
        F.col("tick") - 1, F.col("prev_current_lag"), F.col("prev_messages_consumed"),
        F.col("prev_messages_replicated"), F.col("prev_error_count"), rearm_every=rearm_every,
    )

    def edge(kind: str) -> Column:
        was = F.coalesce(before[kind], F.lit(False))
        change = F.when(now[kind] & ~was, "raised")
        if kind in STALL_KINDS:
            change = change.when(~now[kind] & was, "resolved")
        return F.struct(F.lit(kind).alias("incident"), change.alias("transition"))

    edges = F.filter(F.array(*[edge(k) for k in now]), lambda e: e["transition"].isNotNull())
    kept = list(dict.fromkeys(["job_id", *order, ts]))
    return numbered.select(*kept, "tick", F.explode(edges).alias("e")).select(*kept, "tick", "e.incident", "e.transition")


def incidents(
    samples: DataFrame,
    *,
    rearm_every: int | None = None,
    order: Sequence[str] = ("ts",),
    ts: str = "ts",
    chunk: Column | None = None,
) -> DataFrame:
    """Incident edges of every job's samples."""
    return incident_edges(ticks(samples, order=order, ts=ts, chunk=chunk), order=order, ts=ts, rearm_every=rearm_every)


def milestones(samples: DataFrame, *, order: Sequence[str] = ("ts",), ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    """First record within two ticks, and totals that are a multiple of 100, for both directions."""
    numbered = ticks(samples, order=order, ts=ts, chunk=chunk)

    def milestone(direction: str, total: Column) -> Column:
        kind = F.when((total == 1) & (F.col("tick") <= 2), f"first_{direction}").when(
            (total > 0) & (total % 100 == 0), f"{direction}_milestone"
        )
        return F.struct(kind.alias("milestone"), total.alias("total"))

    reached = F.filter(
        F.array(milestone("consumed", F.col("messages_consumed")), milestone("produced", F.col("messages_replicated"))),
        lambda m: m["milestone"].isNotNull(),
    )
    kept = list(dict.fromkeys(["job_id", *order]))
    return numbered.select(*kept, "tick", F.explode(reached).alias("m")).select(*kept, "tick", "m.milestone", "m.total")


def failure_runs(records: DataFrame, *, order: Sequence[str], chunk: Column, limit: int = 100) -> DataFrame:
    """Longest run of consecutive failed sends per job; a job with a run above ``limit`` has to stop."""
    marked = along(
        records.select("job_id", *order, "send_failed"), ["job_id"], order, chunk,
        running={"successes": F.when(F.col("send_failed"), 0).otherwise(1)},
    )
    # successes only separate the runs; all of a job are one more group, without a number, which keeps jobs without a failure
    island = F.when(F.col("send_failed"), F.col("successes"))
    runs = marked.groupBy("job_id", island.alias("island")).agg(F.count(F.lit(1)).alias("run"))
    failed = F.col("island").isNotNull()
    longest = F.coalesce(F.max(F.when(failed, F.col("run"))), F.lit(0)).cast("long")
    return runs.groupBy("job_id").agg(
        longest.alias("longest_failure_run"), F.count_if(failed).alias("failure_runs"), (longest > limit).alias("must_stop")
    )


def metric_changes(points: DataFrame, *, order: Sequence[str] = ("ts",), ts: str = "ts", chunk: Column | None = None) -> DataFrame:
    """Points whose messages, lag or errors differ from the point before: candidates for a new analysis."""
    watched = ("messages_replicated_delta", "avg_lag", "error_count_delta")
    stepped = along(
        points.select(*dict.fromkeys(["job_id", *order, ts, *watched])), ["job_id"], order,
        hour_of(ts) if chunk is None else chunk, previous={f"prev_{w}": F.col(w) for w in watched},
    )
    same = F.lit(True)
    for w in watched:
        same = same & F.col(w).eqNullSafe(F.col(f"prev_{w}"))
    return stepped.filter(~same).drop(*[f"prev_{w}" for w in watched])


def tick_end(ts: str, every_seconds: int) -> Column:
    """The end of the tick of ``every_seconds`` that a time falls into."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(every_seconds * 1_000_000)).cast("long")
    return F.timestamp_seconds((slot + 1) * every_seconds).cast("timestamp_ntz")


def analysis_gate(points: DataFrame, *, every_seconds: int = 300, order: Sequence[str] = ("ts",), ts: str = "ts") -> DataFrame:
    """Ticks at which a job is due for a new analysis: its newest point differs from that of the tick before.

    Ticks are as far apart as two analyses must be, so the last analysed point and that of the tick before
    are the same whenever nothing changed. Only the newest point of a tick takes part, one row per job and tick.
    """
    watched = ("messages_replicated_delta", "avg_lag", "error_count_delta")
    seconds = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(every_seconds * 1_000_000)).cast("long")
    newest = F.max_by(F.struct(*watched), F.struct(*order) if len(order) > 1 else F.col(order[0]))
    per_tick = points.groupBy("job_id", seconds.alias("slot")).agg(newest.alias("v"))
    by_job = Window.partitionBy("job_id").orderBy("slot")
    stepped = per_tick.withColumn("before", F.lag("v").over(by_job))
    return stepped.filter(~F.col("v").eqNullSafe(F.col("before"))).select(
        "job_id", F.timestamp_seconds((F.col("slot") + 1) * every_seconds).cast("timestamp_ntz").alias("tick_at"), "v.*"
    )


def series_statistics(
    points: DataFrame,
    *,
    as_of: Column,
    span: str = "INTERVAL 10 MINUTES",
    order: Sequence[str] = ("ts",),
    ts: str = "ts",
    chunk: Column | None = None,
) -> DataFrame:
    """Integer averages, ranges, errors, and the trend of the second half against the first (20 % either way)."""
    recent = points.filter(within(ts, as_of, span))
    numbered = along(
        recent, ["job_id"], order, hour_of(ts) if chunk is None else chunk,
        running={"position": F.lit(1)}, whole={"n": F.lit(1)},
    )
    messages, in_first = F.col("messages_replicated_delta"), F.col("position") <= F.floor(F.col("n") / 2)
    stats = numbered.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.expr("sum(messages_replicated_delta) div count(1)").alias("avg_throughput"),
        F.min(messages).alias("min_throughput"),
        F.max(messages).alias("max_throughput"),
        F.expr("sum(avg_lag) div count(1)").alias("avg_lag"),
        F.min("avg_lag").alias("min_lag"),
        F.max("avg_lag").alias("max_lag"),
        F.sum("error_count_delta").alias("total_errors"),
        F.sum(F.when(in_first, messages).otherwise(0)).alias("first_sum"),
        F.sum(F.when(~in_first, messages).otherwise(0)).alias("second_sum"),
        F.count_if(in_first).alias("first_n"),
        F.count_if(~in_first).alias("second_n"),
    )
    expected = F.try_divide(F.col("first_sum").cast("double") * F.col("second_n"), F.col("first_n"))
    trend = (
        F.when(F.col("second_sum") > expected * 1.2, "increasing")
        .when(F.col("second_sum") < expected * 0.8, "decreasing")
        .otherwise("stable")
    )
    return stats.withColumn("trend", trend).drop("first_sum", "second_sum", "first_n", "second_n")


def severity(points: DataFrame, *, as_of: Column, span: str = "INTERVAL 10 MINUTES", ts: str = "ts") -> DataFrame:
    """high / medium / info per job from its error rate and highest lag."""
    totals = points.filter(within(ts, as_of, span)).groupBy("job_id").agg(
        F.sum("error_count_delta").alias("errors"),
        F.sum("messages_replicated_delta").alias("messages"),
        F.max("avg_lag").alias("max_lag"),
    )
    errors, messages, lag = F.col("errors"), F.col("messages"), F.col("max_lag")
    level = (
        F.when(error_rate_over(errors, messages, 5.0) | (lag > 10_000), "high")
        .when(error_rate_over(errors, messages, 1.0) | (lag > 5_000), "medium")
        .otherwise("info")
    )
    return totals.withColumn("severity", level)


def throttling_advice(
    points: DataFrame,
    jobs: DataFrame,
    adjustments: DataFrame,
    *,
    as_of: Column,
    span: str = "INTERVAL 15 MINUTES",
    newest: int = 20,
    min_points: int = 5,
    cooldown: str = "INTERVAL 10 MINUTES",
    min_confidence: float = 0.7,
    order: Sequence[str] = ("ts",),
    ts: str = "ts",
) -> DataFrame:
    """New batch size and parallelism per job, and whether to apply them now.

    ``adjustments`` holds insights; a ``throttling_adjustment`` inside the cool-down blocks applying.
    """
    window = newest_per_job(points.filter(within(ts, as_of, span)), newest, order=order).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("points"),
        F.round(F.sum("messages_replicated_delta") / F.count(F.lit(1)), 6).alias("throughput"),
        F.round(F.sum("avg_lag") / F.count(F.lit(1)), 6).alias("lag"),
        F.sum("error_count_delta").alias("errors"),
        F.sum("messages_replicated_delta").alias("messages"),
    )
    state = window.filter(F.col("points") >= min_points).join(jobs.select("job_id", "batch_size", "parallelism"), "job_id")
    batch, workers = F.col("batch_size").cast("long"), F.col("parallelism").cast("long")
    errors, messages = F.col("errors"), F.col("messages")

    grown = F.least(F.floor(batch.cast("double") * 1.5), F.lit(10_000))
    up_batch = F.when(grown <= batch, batch + 500).otherwise(grown)
    up_workers = F.least(workers + 2, F.lit(20))
    shrunk = F.greatest(F.floor(batch.cast("double") * 0.7), F.lit(100))
    down_batch = F.greatest(F.when(shrunk >= batch, batch - 200).otherwise(shrunk), F.lit(1))
    down_workers = F.greatest(workers - 1, F.lit(1))
    tuned = F.when(F.col("throughput") < 50, F.greatest(F.floor(batch / 2), F.lit(100))).otherwise(
        F.least(batch + 300, F.lit(5_000))
    )

    increase = (F.col("lag") > 5_000) & error_rate_under(errors, messages, 1.0) & (
        (up_batch != batch) | (up_workers != workers)
    )
    decrease = error_rate_over(errors, messages, 2.0) & ((down_batch != batch) | (down_workers != workers))
    optimise = (
        (F.col("throughput") < 100) & (F.col("lag") < 1_000) & error_rate_under(errors, messages, 0.5) & (tuned != batch)
    )
    action = F.when(increase, "increase").when(decrease, "decrease").when(optimise, "optimise")

    def by_action(up: Column, down: Column, tune: Column) -> Column:
        return F.when(F.col("action") == "increase", up).when(F.col("action") == "decrease", down).otherwise(tune)

    recent = (
        adjustments.filter((F.col("insight_type") == "throttling_adjustment") & within("ts", as_of, cooldown))
        .select("job_id").distinct().withColumn("cooling", F.lit(True))
    )
    advised = state.withColumn("action", action).filter(F.col("action").isNotNull())
    return advised.join(recent, "job_id", "left").select(
        "job_id", "points", "throughput", "lag", "errors", "messages", "action",
        by_action(up_batch, down_batch, tuned).cast("long").alias("new_batch_size"),
        by_action(up_workers, down_workers, workers).cast("long").alias("new_parallelism"),
        by_action(F.lit(0.8), F.lit(0.9), F.lit(0.6)).alias("confidence"),
        (F.col("cooling").isNull() & (by_action(F.lit(0.8), F.lit(0.9), F.lit(0.6)) >= min_confidence)).alias("apply_now"),
    )
