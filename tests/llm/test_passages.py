"""Substring dedup, periodic runs and centroid clustering on edge cases, against plain Python."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from relaylens.llm import lloyd, periodic, queries, substrings, textkit
from tests.conftest import SMALL
from tests.llm import brute


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def removal_by_hand(rows, width=35):
    return sorted(((i, *out) for (i, _), out in zip(rows, brute.removed([t for _, t in rows], width))), key=repr)


def passages(rng, count):
    """Texts that share passages of 20 to 90 words, whole texts and templates with a varied word."""
    shared = [[f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 90))] for _ in range(8)]
    template = [f"t{k}" for k in range(120)]
    texts = []
    for k in range(count):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += [f"x{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(40))] + (rng.choice(shared) if rng.random() < 0.6 else [])
        if k % 5 == 0:
            words = [*template[:60], f"only{k}", *template[60:]]
        texts.append(" ".join(words) if k % 7 else "  ".join(words) + "\n")
    return [*texts, texts[1], texts[1], " ".join(shared[0] * 3), None, "", "one"]


REMOVED = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_memory_of_a_batch_and_a_subtree():
    """What numpy holds at most: bytes for each word of a batch, and beside the codes for each suffix of a subtree."""
    rng = np.random.default_rng(1)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 100_000, 500)) for _ in range(2200)])
    batches = [pa.RecordBatch.from_arrays([texts.slice(k, 550)], names=["text"]) for k in range(0, len(texts), 550)]
    n = 1 << 18
    rows = [{"batch": bytes([k]), "n": n, "places": substrings._packed(np.arange(n)), "codes": rng.integers(0, 1 << 62, n).tobytes()} for k in range(4)]
    kinds = {"batch": pa.binary(), "n": pa.int32(), "places": pa.binary(), "codes": pa.binary(), "prints": pa.binary(), "bounds": pa.binary()}
    group = pa.Table.from_pylist(rows, pa.schema(kinds))
    del rows
    tracemalloc.start()
    try:
        assert sum(len(s.once) for s in substrings._batches(iter(batches), substrings.Plan())) == 2200 * 466
        assert tracemalloc.get_traced_memory()[1] < 90 * 2200 * 500
        tracemalloc.reset_peak()
        held = tracemalloc.get_traced_memory()[0]
        assert substrings._subtree(group).num_rows == 0
        assert tracemalloc.get_traced_memory()[1] - held < 30 * 4 * n
    finally:
        tracemalloc.stop()


def test_removal_on_edge_rows(edge, edge_rows):
    assert rows_of(substrings.removal_table(edge), *REMOVED) == removal_by_hand([(r[0], r[1]) for r in edge_rows])


def test_removal_of_repeated_rows_and_empty_table(repeated, empty):
    expected = removal_by_hand([(r.doc_id, r.text) for r in repeated.collect()])
    assert rows_of(substrings.removal_table(repeated), *REMOVED) == expected
    assert substrings.removal_table(empty).count() == 0


@pytest.mark.parametrize("plan", [
    substrings.Plan(), substrings.Plan(group=200, batch=300), substrings.Plan(width=8, prefixes=(2, 4), group=100, batch=400), substrings.Plan(width=1), substrings.Plan(width=12),
])
def test_removal_by_any_plan(spark, plan):
    """Small subtrees and batches, prefixes that are extended once and to the whole passage."""
    rows = list(enumerate(passages(random.Random(3), 60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(substrings.removal_table(docs, plan), *REMOVED) == removal_by_hand(rows, plan.width)


def test_frequent_prefixes_are_extended(spark):
    """A third of all texts begin alike: their suffixes do not meet in one subtree."""
    start = " ".join(f"s{k}" for k in range(30))
    rows = [(f"{start} v{k} " + " ".join(f"{k}y{j}" for j in range(40)),) for k in range(300)]
    plan = substrings.Plan(group=400, batch=10 ** 6)
    texts = spark.createDataFrame(rows, "text string")
    hot, total = substrings.frequent_prefixes(texts, plan)
    assert len(hot[0]) > 0 and len(hot[1]) > 0 and total == 300 * 37
    sent = substrings._sent(texts, plan, hot, 28).filter("codes IS NOT NULL").groupBy("group").agg(F.sum("n").alias("n"))
    assert max(r.n for r in sent.collect()) < 2 * total / 28


def test_passages_in_words_and_texts(spark):
    words = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join(["a", *words, "b"])), (2, " ".join([*words, "c", *words[:35], "d"])), (3, " ".join(words[:34])), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in substrings.repeats(docs).collect()}
    assert spans == {1: [(1, 41)], 2: [(0, 40), (41, 76)], 3: [], None: []}
    assert {r.doc_id: r.text for r in substrings.without_repeats(docs).collect()} == {1: "a b", 2: "c d", 3: rows[2][1], None: ""}


def test_removal_over_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows_of(queries.op11_substring_dedup(spark, SMALL), *REMOVED) == removal_by_hand(rows)


def test_one_very_long_text_with_repeats(spark):
    block = " ".join(f"b{k}" for k in range(50_000))
    out = substrings.removal_table(spark.createDataFrame([(1, f"{block} gap {block}"), (2, "b7 " * 100_000)], "doc_id long, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed) for r in out.collect()} == {1: (100_001, 100_000), 2: (100_000, 100_000)}


RUNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_on_edge_rows(edge, edge_rows):
    short = [(r[0], r[1]) for r in edge_rows if len(r[1] or "") < 50_000]
    got = [r for r in rows_of(periodic.run_table(edge), *RUNS) if r[0] in {i for i, _ in short}]
    assert got == sorted(((i, *brute.periodic(i, t)) for i, t in short), key=repr)


def test_runs_of_repeated_rows_and_empty_table(repeated, empty):
    expected = sorted(((r.doc_id, *brute.periodic(r.doc_id, r.text)) for r in repeated.collect()), key=repr)
    assert rows_of(periodic.run_table(repeated), *RUNS) == expected
    assert periodic.run_table(empty).count() == 0


def test_runs_over_short_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    short = {i for i, t in rows if len(t or "") < 5000}
    got = [r for r in rows_of(queries.op12_periodic_runs(spark, SMALL), *RUNS) if r[0] in short]
    assert got == sorted(((i, *brute.periodic(i, t)) for i, t in rows if i in short), key=repr)
    assert any(r[1] for r in got) and len(got) > 100


def random_words(rng):
    out = []
    while rng.random() < 0.75 and len(out) < 500:
        if rng.random() < 0.3:
            out += [rng.randrange(3) for _ in range(rng.randrange(40))]
        else:
            block = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 12, 15, 16, 17, 24, 31, 32, 33, 40, 64, 65]))]
            out += [block[i % len(block)] for i in range(rng.randrange(len(block), 6 * len(block)))]
    return out


def test_runs_of_random_words():
    rng = random.Random(1)
    found = 0
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randrange(1, 6))]
        first = np.cumsum([0, *map(len, texts)])
        got = periodic.find_runs(textkit.mix(np.array(sum(texts, []), np.uint64) + np.uint64(7)), first)
        assert [[tuple(r) for r in runs.tolist()] for runs in got] == [brute.runs(t) for t in texts]
        found += sum(map(len, got))
    assert found > 300


def test_runs_of_very_long_texts(spark):
    """A period of a hundred thousand words, and a hundred thousand runs, in a text each."""
    long = " ".join(f"p{k % 100_000}" for k in range(450_000))
    many = " ".join(f"v{k // 6}" for k in range(600_000))
    got = {r.doc_id: r for r in periodic.periodic_runs(spark.createDataFrame([(1, long), (2, many), (None, "a " * 9)], "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 450_000, 100_000)]
    assert len(got[2].runs) == 100_000 and got[2].n_words == 600_000 and [tuple(r) for r in got[None].runs] == [(0, 9, 1)]


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so very very very very  very very\nend"), (2, "a b a b a b"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in periodic.collapsed(docs).collect()} == {1: "so very end", 2: "a b a b a b", 3: ""}
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=3)


VECTORS = "vec_id long, embedding array<float>, cluster int, block int, v string"


def vectors(rng, n, centres=5, components=64):
    heart = rng.normal(size=(centres, components))
    return [(k, [float(np.float32(x)) for x in heart[k % centres] + rng.normal(size=components) * 0.2]) for k in range(n)]


def clustered(df, plan=lloyd.Plan()):
    out, centroids = lloyd.cluster(df, plan)
    return rows_of(out, "vec_id", "cluster", "distance"), centroids.tolist()


def by_hand(rows, **plan):
    labels, centroids = brute.lloyd(rows, **plan)
    return sorted(labels, key=repr), centroids


def test_clusters_on_edge_rows(spark):
    rows = vectors(np.random.default_rng(1), 150)
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None, *[0.5] * 63]), (905, [float("nan"), *[0.5] * 63]), (906, [float("-inf"), *[0.5] * 63])]
    rows += [*odd, rows[3], rows[3], (3, rows[9][1]), (None, rows[5][1]), (None, [0.0] * 64), (None, [0.0] * 64), (907, [-0.0005] * 64)]
    df = spark.createDataFrame([(*r, 3, 1, "clash") for r in rows], VECTORS).repartition(4)
    assert clustered(df) == by_hand(rows)


@pytest.mark.parametrize("plan", [lloyd.Plan(clusters=3, rounds=2, components=5, shard=2, block=7), lloyd.Plan(clusters=20, rounds=4, components=5, shard=5, block=1, salt="3:")])
def test_clusters_by_any_plan(spark, plan):
    rows = vectors(np.random.default_rng(2), 60, components=5)
    got = clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), plan)
    assert got == by_hand(rows, clusters=plan.clusters, rounds=plan.rounds, components=5)


def test_fewer_vectors_than_clusters(spark):
    rows = vectors(np.random.default_rng(3), 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert clustered(df) == by_hand(rows)
    none = lloyd.cluster_table(df.filter("vec_id < 0"))
    assert none.count() == 0 and dict(none.dtypes)["distance"] == "bigint"


def test_equal_vectors_leave_empty_clusters(spark):
    rows = [(k, [0.25] * 64) for k in range(30)]
    assert clustered(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == by_hand(rows)
    out = lloyd.cluster_table(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r.cluster, r.distance, r.cluster_inertia, r.inertia) for r in out} == {(0, 0, 0, 0)}


def test_blocks_stay_where_they_are(spark):
    """The vectors are read by bucket; only labels are shuffled to them."""
    rows = vectors(np.random.default_rng(4), 200)
    integers = lloyd.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lloyd.Plan())
    from relaylens.llm.common import Scratch

    scratch = Scratch(spark, "test")
    blocks = lloyd.Blocks(integers, lloyd.Plan(block=16), "vec_id", scratch, 200)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labels = spark.createDataFrame([(0, bytearray(4))], "block long, labels binary")
        every = labels.select("block", "labels", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shard"))
        joined = blocks.rows().select("block", "shard", "data").join(every, ["block", "shard"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        blocks.drop()
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
