import datetime as dt

import pytest
from pyspark.sql import functions as F

from relaylens.operators import detect, metrics
from tests.conftest import at

SAMPLE = (
    "job_id string, ts timestamp_ntz, messages_replicated long, bytes_transferred long, messages_consumed long, "
    "bytes_consumed long, current_lag long, error_count long"
)
POINT = (
    "job_id string, ts timestamp_ntz, messages_replicated_delta long, bytes_transferred_delta long, "
    "messages_consumed_delta long, bytes_consumed_delta long, avg_lag long, error_count_delta long"
)
T0 = at("2024-01-31T10:00:00")


def now():
    return F.lit("2024-01-31 10:08:00").cast("timestamp_ntz")


def series(spark, values, job="j"):
    return spark.createDataFrame(
        [(job, T0 + dt.timedelta(seconds=10 * i), v, v * 10, v, v * 10, 5, 0) for i, v in enumerate(values)], SAMPLE
    )


def points(spark, rows, job="j"):
    """Rows (messages, lag, errors), oldest first, ten seconds apart."""
    return spark.createDataFrame(
        [(job, T0 + dt.timedelta(seconds=10 * i), m, m, m, m, lag, e) for i, (m, lag, e) in enumerate(rows)], POINT
    )


def test_second_sample_becomes_its_difference(spark):
    df = spark.createDataFrame(
        [("j", T0, 100, 1000, 120, 1400, 10, 0), ("j", T0 + dt.timedelta(seconds=10), 123, 4560, 150, 2000, 12, 1)], SAMPLE
    )
    for deltas in (metrics.counter_deltas(df), metrics.counter_deltas_against_total(df)):
        second = deltas.orderBy("ts").collect()[1]
        assert (
            second.messages_replicated_delta, second.bytes_transferred_delta, second.messages_consumed_delta,
            second.bytes_consumed_delta, second.error_count_delta, second.avg_lag,
        ) == (23, 3560, 30, 600, 1, 12)


def test_reset_restarts_from_the_raw_value(spark):
    df = series(spark, [100, 150, 10, 20, 200])
    assert [r[0] for r in metrics.counter_deltas(df).orderBy("ts").select("messages_replicated_delta").collect()] == [
        100, 50, 10, 10, 180,
    ]


@pytest.mark.parametrize("chunk", [1, 2, 1000])
def test_compatible_deltas_compare_with_the_running_sum(spark, chunk):
    values = [100, 150, 10, 20, 200, 5, 5, 400, 1, 900, 3, 3, 3]
    total, want = 0, []
    for x in values:
        want.append(x - total if x >= total else x)
        total += want[-1]
    assert want[:5] == [100, 50, 10, 20, 20]
    df = series(spark, values)
    per_chunk = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.lit(10 * chunk)).cast("long")
    got = metrics.counter_deltas_against_total(df, chunk=per_chunk).orderBy("ts").select("messages_replicated_delta").collect()
    assert [r[0] for r in got] == want


def test_deltas_add_up(spark, views):
    raw, order = views.raw_metrics, ("ts", "event_id")
    deltas = metrics.counter_deltas(raw, order=order)
    assert deltas.count() == raw.count()
    assert deltas.agg(F.sum("messages_replicated_delta")).first()[0] == views.metric_points.agg(
        F.sum("messages_replicated_delta")
    ).first()[0]


def test_totals_of_a_job_without_points_are_zero(spark):
    jobs = spark.createDataFrame([("j",), ("idle",)], "job_id string")
    got = {r.job_id: r for r in metrics.current_totals(points(spark, [(5, 7, 1), (6, 8, 0)]), jobs).collect()}
    assert (got["j"].messages_replicated, got["j"].current_lag, got["j"].error_count) == (11, 8, 1)
    assert (got["idle"].messages_replicated, got["idle"].current_lag, got["idle"].last_sample_at) == (0, 0, None)


def test_rollup_labels_and_unknown_granularity(spark):
    df = points(spark, [(1, 10, 0), (2, 20, 1)])
    hourly, other = (metrics.rollup(df, g, as_of=now(), days=1).collect() for g in ("hourly", "fortnightly"))
    assert [(r.period, r.messages_total, r.avg_lag, r.total_errors) for r in hourly] == [("2024-01-31 10:00:00", 3, 15.0, 1)]
    assert [r.period for r in other] == ["2024-01-31"]


def test_rollup_keeps_all_messages(views):
    daily = metrics.rollup(views.metric_points, "daily", as_of=now(), days=400)
    total = "messages_replicated_delta"
    assert daily.agg(F.sum("messages_total")).first()[0] == views.metric_points.agg(F.sum(total)).first()[0]


ANOMALIES = [
    ([(100, 10, 0)] * 2, "none"),
    ([(100, 10, 0)] * 6, "none"),
    ([(100, 10, 0)] * 3 + [(0, 10, 0)] * 3, "zero_throughput"),
    ([(100, 10, 0)] * 3 + [(60, 10, 0)] * 3, "throughput_drop"),
    ([(100, 10, 0)] * 3 + [(100, 21, 0)] * 3, "lag_spike"),
    ([(100, 2000, 0)] * 6, "lag_spike"),
    ([(100, 10, 1)] * 6, "high_error_rate"),
    ([(0, 10, 1)] * 6, "high_error_rate"),
    ([(100, 10, 0)] * 3 + [(60, 5000, 9)] * 3, "throughput_drop"),
    ([(1, 1, 0)] * 20 + [(100, 10, 0)] * 10, "none"),
]


@pytest.mark.parametrize("rows,kind", ANOMALIES)
def test_anomaly_rules(spark, rows, kind):
    assert detect.anomalies(points(spark, rows), as_of=now()).first().anomaly_kind == kind


def test_incident_edges(spark):
    df = spark.createDataFrame(
        [("j", T0 + dt.timedelta(seconds=10 * i), p, 0, c, 0, lag, e) for i, (c, p, lag, e) in enumerate(
            [(0, 0, 0, 0)] * 8 + [(5, 0, 300, 0), (5, 0, 300, 0), (9, 9, 0, 0), (9, 9, 300, 2)])], SAMPLE,
    )
    got = [(r.tick, r.incident, r.transition) for r in detect.incidents(df).orderBy("tick", "incident").collect()]
    assert got == [
        (7, "source_stalled", "raised"), (9, "critical_lag", "raised"), (9, "source_stalled", "resolved"),
        (9, "target_stalled", "raised"), (11, "target_stalled", "resolved"), (12, "critical_lag", "raised"),
        (12, "error_spike", "raised"), (12, "high_error_rate", "raised"),
    ]


def test_rearmed_error_spike_fires_every_third_tick(spark):
    df = spark.createDataFrame([("j", T0 + dt.timedelta(seconds=10 * i), 100, 0, 100, 0, 0, 1) for i in range(9)], SAMPLE)
    spikes = detect.incidents(df, rearm_every=3).filter("incident = 'error_spike'")
    assert sorted(r.tick for r in spikes.collect()) == [3, 6, 9]


def test_milestones(spark):
    df = series(spark, [1, 99, 100, 150, 200])
    got = {(r.tick, r.milestone) for r in detect.milestones(df).collect()}
    assert got == {(t, m) for t, m in [
        (1, "first_consumed"), (1, "first_produced"), (3, "consumed_milestone"), (3, "produced_milestone"),
        (5, "consumed_milestone"), (5, "produced_milestone")]}


def test_failure_runs_cross_chunks(spark):
    df = spark.createDataFrame([("j", i, 10 <= i < 115) for i in range(200)], "job_id string, n long, send_failed boolean")
    from relaylens.functions.timeline import block_of

    row = detect.failure_runs(df, order=["n"], chunk=block_of("n", 16)).first()
    assert (row.longest_failure_run, row.failure_runs, row.must_stop) == (105, 1, True)


THROTTLING = [
    ([(200, 6000, 0)] * 5, 1000, 4, ("increase", 1500, 6, 0.8, True)),
    ([(200, 6000, 0)] * 5, 10000, 20, ("increase", 10500, 20, 0.8, True)),
    ([(200, 10, 9)] * 5, 1000, 4, ("decrease", 700, 3, 0.9, True)),
    ([(200, 10, 9)] * 5, 100, 1, ("decrease", 1, 1, 0.9, True)),
    ([(20, 10, 0)] * 5, 1000, 4, ("optimise", 500, 4, 0.6, False)),
    ([(80, 10, 0)] * 5, 1000, 4, ("optimise", 1300, 4, 0.6, False)),
    ([(200, 10, 0)] * 5, 1000, 4, None),
    ([(200, 6000, 0)] * 4, 1000, 4, None),
]


@pytest.mark.parametrize("rows,batch,workers,want", THROTTLING)
def test_throttling(spark, rows, batch, workers, want):
    jobs = spark.createDataFrame([("j", batch, workers)], "job_id string, batch_size int, parallelism int")
    none = spark.createDataFrame([], "job_id string, insight_type string, ts timestamp_ntz")
    got = detect.throttling_advice(points(spark, rows), jobs, none, as_of=now()).collect()
    assert [(r.action, r.new_batch_size, r.new_parallelism, r.confidence, r.apply_now) for r in got] == ([want] if want else [])


def test_throttling_waits_after_an_adjustment(spark):
    jobs = spark.createDataFrame([("j", 1000, 4)], "job_id string, batch_size int, parallelism int")
    done = spark.createDataFrame([("j", "throttling_adjustment", at("2024-01-31T10:03:00"))], "job_id string, insight_type string, ts timestamp_ntz")
    assert not detect.throttling_advice(points(spark, [(200, 6000, 0)] * 5), jobs, done, as_of=now()).first().apply_now


def test_statistics_of_a_single_point_are_stable(spark):
    row = detect.series_statistics(points(spark, [(7, 3, 1)]), as_of=now()).first()
    assert (row.points, row.avg_throughput, row.trend) == (1, 7, "stable")


@pytest.mark.parametrize("rows,trend", [([(1, 0, 0), (2, 0, 0), (9, 0, 0)], "increasing"), ([(9, 0, 0), (1, 0, 0)], "decreasing")])
def test_trend(spark, rows, trend):
    assert detect.series_statistics(points(spark, rows), as_of=now()).first().trend == trend


@pytest.mark.parametrize("rows,level", [([(100, 0, 6)], "high"), ([(100, 10001, 0)], "high"), ([(100, 0, 2)], "medium"),
                                        ([(100, 5001, 0)], "medium"), ([(0, 0, 0)], "info"), ([(0, 0, 1)], "high")])
def test_severity(spark, rows, level):
    assert detect.severity(points(spark, rows), as_of=now()).first().severity == level


def test_worker_functions_need_no_package_on_executors(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from relaylens.streaming import chunks

    (tmp_path / "f.pkl").write_bytes(cloudpickle.dumps((chunks.Closing, chunks.Carrying, chunks.NewestRow)))
    code = "import pickle, sys; print(*[c.__name__ for c in pickle.load(open('f.pkl', 'rb'))], 'relaylens' in sys.modules)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"})
    assert out.stdout.split() == ["Closing", "Carrying", "NewestRow", "False"], out.stderr


def test_deltas_against_the_total_keep_all_rows(spark):
    schema = "job_id string, ts timestamp_ntz, messages_replicated long, bytes_transferred long, messages_consumed long, bytes_consumed long, current_lag long, error_count long"
    rows_in = [("a", at("2024-01-01T00:00:00"), 5, 1, 1, 1, 0, 0), ("a", at("2024-01-01T05:00:00"), None, 2, 2, 2, 0, 0),
               ("a", at("2024-01-02T00:00:00"), 7, 3, 3, 3, None, 0), (None, at("2024-01-01T00:00:00"), 4, 0, 0, 0, 1, 0), ("a", None, 2, 0, 0, 0, 0, 0)]
    got = metrics.counter_deltas_against_total(spark.createDataFrame(rows_in, schema))
    found = {(r.job_id, r.ts): r.messages_replicated_delta for r in got.collect()}
    assert found == {("a", None): 2, ("a", rows_in[0][1]): 3, ("a", rows_in[1][1]): None, ("a", rows_in[2][1]): 2, (None, rows_in[3][1]): 4}


def test_step_functions_compose_in_any_grouping(spark):
    """Folded sample by sample, or in parts of any length put together in any order of grouping: the same totals and deltas."""
    import random

    from relaylens.functions import steps

    rng = random.Random(9)
    rows, want = [], []
    for number in range(40):
        xs = [rng.choice([0, 1, 5, rng.randrange(50), rng.randrange(5000)]) for _ in range(rng.randrange(1, 60))]
        cuts = sorted(rng.randrange(len(xs) + 1) for _ in range(4))
        parts = [xs[a:b] for a, b in zip([0, *cuts], [*cuts, len(xs)])]
        start, total, added, seen = rng.randrange(300), 0, [], []
        total = start
        for part in parts:
            seen.append(total)
            for x in part:
                added.append(x - total if x >= total else x)
                total += added[-1]
        rows.append((number, xs, parts, start))
        want.append((number, total, total, total, seen, added))
    df = spark.createDataFrame(rows, "id int, xs array<bigint>, parts array<array<bigint>>, start bigint")
    left = F.aggregate("parts", steps.nothing(), lambda a, p: steps.composed(a, steps.of_samples(p)))
    right = F.aggregate(F.reverse("parts"), steps.nothing(), lambda a, p: steps.composed(steps.of_samples(p), a))
    got = df.select(
        "id", steps.applied(steps.of_samples(F.col("xs")), F.col("start")), steps.applied(left, F.col("start")), steps.applied(right, F.col("start")),
        steps.starts(F.transform("parts", steps.of_samples), F.col("start")), steps.deltas(F.col("xs"), F.col("start")),
    )
    assert sorted(tuple(r) for r in got.collect()) == want


def test_dense_chunk_is_folded_in_blocks(spark):
    """Many blocks in one chunk, and many chunks: as the plain loop."""
    import random

    rng = random.Random(2)
    values = [rng.choice([rng.randrange(100), rng.randrange(10 ** 7) if rng.random() < 0.02 else 3]) for _ in range(3000)]
    total, want = 0, []
    for x in values:
        want.append(x - total if x >= total else x)
        total += want[-1]
    df = spark.createDataFrame([("j", k, v, 0, 0, 0, 5, 0) for k, v in enumerate(values)], SAMPLE.replace("ts timestamp_ntz", "ts long"))
    for width in (1, 700, 10_000):
        got = metrics.counter_deltas_against_total(df, chunk=F.expr(f"ts DIV {width}")).orderBy("ts").collect()
        assert [r.messages_replicated_delta for r in got] == want
