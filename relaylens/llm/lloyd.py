"""Centroid clustering: Lloyd's rounds over column blocks of the vectors, in exact integers."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.llm.common import Scratch, map_arrow

#: Components reach up to here, so that a squared distance over 64 of them fits a 64-bit integer.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Plan:
    """``components`` per vector in shards of ``shard`` columns; blocks of ``block`` vectors; buckets of about ``bucket_bytes``."""

    clusters: int = 8
    rounds: int = 10
    components: int = 64
    scale: int = 1024
    shard: int = 16
    block: int = 4096
    bucket_bytes: int = 64 << 20
    salt: str = "3:"

    def __post_init__(self):
        if self.components * (2 * LARGEST) ** 2 >= 1 << 63:
            raise ValueError("squared distances over so many components do not fit")

    @property
    def shards(self) -> int:
        return -(-self.components // self.shard)


def integer_vectors(vectors: DataFrame, plan: Plan, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, v): the usable vectors, each component x as floor(scale * x)."""
    cast = vectors.select(F.col(key), F.col(column).cast("array<double>").alias("x"))
    usable = F.expr(f"size(x) = {plan.components} AND forall(x, c -> c IS NOT NULL AND abs(c) <= {LARGEST // plan.scale - 1}D)")
    scaled = F.expr(f"transform(x, c -> CAST(floor({plan.scale}D * c) AS INT))")
    return cast.filter(F.coalesce(usable, F.lit(False))).select(key, scaled.alias("v"))


def first_centroids(integers: DataFrame, plan: Plan, key: str = "vec_id") -> np.ndarray:
    """The vectors whose salted key has the smallest hash, in that order; ties go to the smaller components. ``clusters`` rows at most."""
    text = F.concat(F.lit(plan.salt), F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = integers.select(F.sha2(text, 256).alias("h"), "v").orderBy("h", "v").limit(plan.clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, plan.components)


class Blocks:
    """The vectors in column blocks: rows (block, shard, ids, data) in a table bucketed by (block, shard).

    Each task of a round reads whole buckets; what is joined to them (a few bytes per vector) is dealt into the same
    buckets, so the vectors themselves never move after this table is written. ``ids`` stand with shard 0.
    """

    def __init__(self, integers: DataFrame, plan: Plan, key: str, scratch: Scratch, count: int):
        spark = integers.sparkSession
        self.spark, self.plan, self.name = spark, plan, f"relaylens_blocks_{uuid.uuid4().hex}"
        buckets = max(spark.sparkContext.defaultParallelism, -(-count * plan.components * 4 // plan.bucket_bytes))
        blocks = self._packed(integers, key).repartition(buckets, "block", "shard")
        blocks.write.bucketBy(buckets, "block", "shard").option("path", scratch.place("blocks")).option("compression", "zstd").saveAsTable(self.name)

    def _packed(self, integers: DataFrame, key: str) -> DataFrame:
        plan, kind = self.plan, integers.schema[key].dataType
        ids_type = pa.list_(_arrow_type(integers, key))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 33

            def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
                ids = pa.concat_arrays([b.column(0) for b in held])
                matrix = np.concatenate([b.column(1).flatten().to_numpy() for b in held]).astype(np.int32).reshape(-1, plan.components)
                cuts = range(0, plan.components, plan.shard)
                listed = pa.array([ids.to_pylist(), *[None] * (plan.shards - 1)], ids_type)
                data = pa.array([np.ascontiguousarray(matrix[:, c:c + plan.shard]).tobytes() for c in cuts], pa.binary())
                return pa.RecordBatch.from_arrays(
                    [pa.array([number] * plan.shards, pa.int64()), pa.array(range(plan.shards), pa.int32()), listed, data], names=["block", "shard", "ids", "data"]
                )

            held, n = [], 0
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    part = batch.slice(at, plan.block - n)
                    held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                    if n == plan.block:
                        yield rows(held)
                        held, n, number = [], 0, number + 1
            if n:
                yield rows(held)

        fields = [T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())]
        return map_arrow(integers.select(key, "v"), run, T.StructType(fields))

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def assigned(blocks: DataFrame, centroids: np.ndarray, plan: Plan) -> DataFrame:
    """(block, labels, distances): the nearest centroid of every vector, the smaller number where two are as near.

    Tasks over column blocks compute squared distances to their slice of the centroids; these are added up by block, the
    rows of a block being one per shard.
    """
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data").to_pylist()):
                part = centroids[:, shard * plan.shard:(shard + 1) * plan.shard]
                values = np.frombuffer(data, np.int32).reshape(-1, part.shape[1]).astype(np.int64)
                sums = np.empty((k, len(values)), np.int64)
                for j in range(k):
                    off = values - part[j]
                    sums[j] = np.einsum("ij,ij->i", off, off)
                # half the bytes to shuffle where the sums are small, as they mostly are
                small = not sums.size or sums.max() < 1 << 32
                out.append((b"\4" if small else b"\10") + (sums.astype(np.uint32) if small else sums).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary())], names=["block", "sums"])

    def added(group: pa.Table) -> pa.Table:
        total: np.ndarray | int = 0
        for data in group.column("sums").to_pylist():
            total = total + np.frombuffer(data, np.uint32 if data[0] == 4 else np.int64, offset=1).astype(np.int64).reshape(k, -1)
        labels = total.argmin(axis=0)
        return pa.table({
            "block": group.column("block").slice(0, 1), "labels": pa.array([labels.astype(np.int32).tobytes()], pa.binary()),
            "distances": pa.array([total[labels, np.arange(len(labels))].tobytes()], pa.binary()),
        })

    parts = map_arrow(blocks.select("block", "shard", "data"), partial, "block long, sums binary")
    return parts.groupBy("block").applyInArrow(added, "block long, labels binary, distances binary")


def moved(blocks: DataFrame, labels: DataFrame, centroids: np.ndarray, plan: Plan) -> np.ndarray:
    """The centroids as the floored means of their vectors; those without vectors stay.

    Each shard sums its own columns by cluster; what reaches the driver is one number per cluster and component.
    """
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, plan.components), np.int64)
        counts = np.zeros((k, plan.shards), np.int64)
        for batch in batches:
            for shard, data, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "data", "labels"))):
                label = np.frombuffer(raw, np.int32)
                values = np.frombuffer(data, np.int32).reshape(len(label), -1)
                for j in np.unique(label):
                    total[j, shard * plan.shard:(shard + 1) * plan.shard] += values[label == j].sum(axis=0, dtype=np.int64)
                counts[:, shard] += np.bincount(label, minlength=k)
        cluster, column = np.nonzero(np.repeat(counts, plan.shard, axis=1)[:, :plan.components])
        yield pa.RecordBatch.from_arrays(
            [pa.array(cluster), pa.array(column), pa.array(total[cluster, column]), pa.array(counts[cluster, column // plan.shard])], names=["cluster", "column", "total", "n"]
        )

    every = labels.select("block", "labels", F.explode(F.sequence(F.lit(0), F.lit(plan.shards - 1))).alias("shard"))
    joined = blocks.select("block", "shard", "data").join(every, ["block", "shard"])
    parts = map_arrow(joined.select("shard", "data", "labels"), sums, "cluster long, column long, total long, n long")
    rows = parts.groupBy("cluster", "column").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.column] = int(r.total) // r.n
    return out


def _unpacked(rows: DataFrame, key: str, kind: T.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, distances = (b"".join(batch.column(c).to_pylist()) for c in ("labels", "distances"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("ids").flatten(), pa.array(np.frombuffer(labels, np.int32)), pa.array(np.frombuffer(distances, np.int64))], names=[key, "cluster", "distance"]
            )

    fields = [T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    return map_arrow(rows.select("ids", "labels", "distances"), run, T.StructType(fields))


def cluster(vectors: DataFrame, plan: Plan = Plan(), *, key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(key, cluster, distance) of every usable vector, and the centroids after ``plan.rounds`` rounds.

    Usable are vectors with ``plan.components`` components, none null or non-finite, whose scaled components stay within
    ``LARGEST``; others give no row. Rows that repeat, and rows without a key, are vectors of their own (a null key
    hashes like an empty one). Fewer usable vectors than clusters make fewer clusters; none make no rows. Other columns are
    ignored. All sums are of integers, so the result does not depend on the order of rows or tasks.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lloyd")
    integers = integer_vectors(vectors, plan, key, column)
    kind = integers.schema[key].dataType
    centroids = first_centroids(integers, plan, key)
    if not len(centroids):
        fields = [T.StructField(key, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
        return spark.createDataFrame([], T.StructType(fields)), centroids
    blocks = Blocks(integers, plan, key, scratch, integers.count())
    try:
        for turn in range(plan.rounds):
            labels = scratch.keep(assigned(blocks.rows(), centroids, plan).select("block", "labels"), f"labels{turn}")
            after = moved(blocks.rows(), labels, centroids, plan)
            scratch.drop(f"labels{turn}")
            if np.array_equal(after, centroids):
                break  # later rounds would change nothing
            centroids = after
        last = assigned(blocks.rows(), centroids, plan)
        ids = blocks.rows().filter("shard = 0").select("block", "ids")
        out = scratch.keep(_unpacked(last.join(ids, "block"), key, kind), "clusters")
    finally:
        blocks.drop()
    scratch.drop("blocks")
    return out, centroids


def cluster_table(vectors: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable vector; edge cases as in :func:`cluster`."""
    rows, centroids = cluster(vectors, plan)
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    inertia = {r.cluster: int(r.s) for r in sums}
    total = sum(inertia.values())
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(j, inertia.get(j, 0), total, digest) for j, digest in enumerate(digests)]
    # a row per cluster: bounded by the plan
    small = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
