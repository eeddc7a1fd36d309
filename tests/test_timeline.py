"""Chunked running and previous values equal the plain window, also for a key with most of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from relaylens.functions.timeline import along, block_of


def skewed(spark, n=4000):
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id").alias("pos"), (F.hash("id") % 50).cast("long").alias("x"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") * 3).alias("y"),
    )


def test_along_equals_plain_window(spark):
    df = skewed(spark)
    got = along(
        df, ["k"], ["pos"], block_of("pos", 64), running={"total": F.col("x"), "n": F.lit(1)},
        previous={"before": F.col("y")}, whole={"size": F.lit(1)},
    )
    w = Window.partitionBy("k").orderBy("pos")
    want = df.select(
        "*", F.sum("x").over(w).alias("total"), F.sum(F.lit(1)).over(w).alias("n"), F.lag("y").over(w).alias("before"),
        F.count(F.lit(1)).over(Window.partitionBy("k")).alias("size"),
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(got.columns).collect()), key=repr)


def test_no_task_gets_a_whole_hot_key(spark):
    df = skewed(spark, 20000)
    # small partitions would be merged again
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spread = along(df, ["k"], ["pos"], block_of("pos", 64), running={"n": F.lit(1)}).filter("k = 'hot'")
        sizes = [r["count"] for r in spread.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("count"), F.sum("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < 0.5 * sum(sizes)


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7)], "k string, pos long, x long")
    got = along(df, ["k"], ["pos"], block_of("pos", 1), running={"t": F.col("x")}, previous={"b": F.col("x")})
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(None, 1, 5, 5, None), (None, 2, 6, 11, 5), ("a", 1, 7, 7, None)], key=repr
    )


def test_fitted_chunk_splits_a_dense_minute(spark):
    from relaylens.functions.timeline import fitted_chunk, minute_of

    df = spark.range(3000).selectExpr("'k' AS k", "id AS x", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 50.0) AS ts")
    chunk = fitted_chunk(df, ["k"], "ts", max_rows=100)
    assert df.select(minute_of("ts")).distinct().count() == 1
    assert max(r["count"] for r in df.groupBy(chunk).count().collect()) <= 101
    got = along(df, ["k"], ["ts"], chunk, running={"n": F.lit(1)}, previous={"b": F.col("x")}).collect()
    assert all(r.n == r.x + 1 and r.b == (r.x - 1 if r.x else None) for r in got) and len(got) == 3000


def test_ties_do_not_depend_on_the_layout(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 1, 3), ("a", 1, 9), ("a", 70, 4), ("a", 70, 8), ("a", None, 2)], "k string, pos long, x long")
    want = None
    for parts in (1, 2, 5):
        got = along(df.repartition(parts), ["k"], ["pos"], block_of("pos", 64), running={"t": F.col("x")}, previous={"b": F.col("x")})
        now = sorted(map(tuple, got.collect()), key=repr)
        want = want or now
        assert now == want
    w = Window.partitionBy("k").orderBy("pos", "x")
    plain = df.select("*", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("t"), F.lag("x").over(w).alias("b"))
    assert want == sorted(map(tuple, plain.collect()), key=repr)


def test_chunks_of_a_key_are_spread(spark):
    """One row per chunk: the chunks of a key are carried on in spans, with the same result."""
    from relaylens.functions.timeline import SPAN

    df = spark.range(5000).selectExpr("'k' AS k", "id AS pos", "id AS x")
    got = along(df, ["k"], ["pos"], F.col("pos"), running={"n": F.lit(1)}, previous={"b": F.col("x")}, whole={"all": F.lit(1)})
    assert all(r.n == r.pos + 1 and r.b == (r.pos - 1 if r.pos else None) and r.all == 5000 for r in got.collect())
    assert SPAN < 5000 and "__span" in got._jdf.queryExecution().toString()
