"""Token-id files: static range asymmetric numeral coding in independent blocks, with checkpoints and checksums."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.llm import rans, textkit
from relaylens.llm.common import Scratch, map_arrow, ship
from relaylens.llm.tokens import default_vocabulary, encoder

END = 2
#: Blocks that are coded at a time in a task.
TOGETHER = 16
#: Parts whose counts of ids are summed up at a time.
FAN_IN = 64

_PIECE = pa.struct([("doc_id", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_())])
_PIECES = "array<struct<doc_id:long,at:long,n:int,piece:int,whole:boolean>>"
_STAGED = f"part int, block int, at long, ids binary, docs {_PIECES}, counts binary"
_BLOCKS = f"part int, block int, first_token long, n_tokens int, docs {_PIECES}, states binary, words binary, words_crc long, ids_crc long"


def staged_ids(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """The ids of all documents in ascending order of doc_id, in blocks; each task adds a row with its counts of ids.

    A block holds whole documents up to ``rans.BLOCK`` ids or a piece of a longer document. Tasks take ranges of doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, at = TaskContext.get().partitionId(), 0, 0
        tokens = encoder(vocabulary)
        counts = np.zeros(len(tokens.bytes_of), np.int64)
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        filled = 0

        def block(ids: np.ndarray, docs: list[dict], begin: int, counted: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([begin], pa.int64()),
                pa.array([ids.astype("<u4").tobytes()], pa.binary()), pa.array([docs], pa.list_(_PIECE)),
                pa.array([None if counted is None else counted.astype("<i8").tobytes()], pa.binary()),
            ], names=["part", "block", "at", "ids", "docs", "counts"])

        for batch in textkit.slices(batches, "text"):
            ids, first = tokens.encode(batch.column("text"))
            counts += np.bincount(ids, minlength=len(counts))
            counts[end] += batch.num_rows
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[first[k]:first[k + 1]], np.uint32(end))
                if filled and filled + len(own) > rans.BLOCK:
                    yield block(np.concatenate(held), pieces, at - filled)
                    number, held, pieces, filled = number + 1, [], [], 0
                begin, whole = at, len(own) <= rans.BLOCK
                for piece, low in enumerate(range(0, len(own), rans.BLOCK)):
                    part_ids = own[low:low + rans.BLOCK]
                    held.append(part_ids)
                    pieces.append({"doc_id": doc_id, "at": begin, "n": len(part_ids), "piece": piece, "whole": whole})
                    filled, at = filled + len(part_ids), at + len(part_ids)
                    if filled >= rans.BLOCK:
                        yield block(np.concatenate(held), pieces, at - filled)
                        number, held, pieces, filled = number + 1, [], [], 0
        if filled:
            yield block(np.concatenate(held), pieces, at - filled)
            number += 1
        if at:
            yield block(np.zeros(0, np.uint32), [], at, counts)

    return map_arrow(ordered, run, _STAGED)


def _summed(counts: pa.ChunkedArray) -> np.ndarray:
    return sum((np.frombuffer(c, "<i8") for c in counts.to_pylist()), np.zeros(1, np.int64))


def id_counts(staged: DataFrame, parts: int) -> np.ndarray:
    """How often each id stands in all documents: the parts' counts summed up ``FAN_IN`` at a time, so the driver gets no more than that of them."""

    def one(group: pa.Table) -> pa.Table:
        return pa.table({"part": group.column("part").slice(0, 1), "counts": pa.array([_summed(group.column("counts")).tobytes()], pa.binary())})

    rows = staged.filter("counts IS NOT NULL").select("part", "counts")
    while parts > FAN_IN:
        rows = rows.groupBy(F.expr(f"part DIV {FAN_IN}").alias("group")).applyInArrow(one, "part int, counts binary").withColumn("part", F.expr(f"CAST(part DIV {FAN_IN} AS INT)"))
        parts = -(-parts // FAN_IN)
    return _summed(rows.select("counts").toArrow().column("counts"))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[dict]]:
    held: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            held.extend(batch.slice(k, 1).to_pylist())
            if len(held) == size:
                yield held
                held = []
    if held:
        yield held


def write(docs: DataFrame, path: str, *, vocabulary: str | None = None, end: int = END) -> None:
    """Writes the token ids of ``docs`` to the folder ``path``, in three Parquet tables that any Spark reader can open.

    ``blocks``: a row per block of at most ``rans.BLOCK`` ids, which can be decoded alone: part, block, first_token (the
    block's place among all ids), n_tokens, docs (the documents in it: doc_id, place in the part, ids in this block, number of
    the piece, whether the document is whole), states and words (the coder's lanes at the block's start, its stream),
    words_crc and ids_crc (CRC-32 of the stream, and of the ids as little-endian unsigned 32-bit integers).
    ``frequencies``: (id, frequency), the table all blocks share. ``parts``: (part, first_token, n_tokens).

    Documents are encoded once; their ids wait in a written table while their counts over all documents are summed up. The
    driver receives a count per id of the vocabulary and a row per part. Null text is empty, so only the end id is written;
    null ids come first; rows that repeat a doc_id lie in the order of their texts; other columns are ignored.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    scratch = Scratch(spark, "tokens")
    staged = scratch.keep(staged_ids(docs, vocabulary, end), "staged")
    sizes = staged.filter("counts IS NOT NULL").select("part", "at").toPandas().sort_values("part")
    counts = id_counts(staged, int(sizes["part"].max()) + 1 if len(sizes) else 0)
    used = np.flatnonzero(counts)
    table = rans.frequencies(used, counts[used], int(used.max()) + 1 if len(used) else 1)
    base = np.cumsum(sizes["at"].to_numpy()) - sizes["at"].to_numpy()
    first_of = spark.sparkContext.broadcast(dict(zip(sizes["part"].tolist(), base.tolist())))
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(shared.value)
        for rows in _blocks(batches, TOGETHER):
            ids = [np.frombuffer(r["ids"], "<u4") for r in rows]
            coded = coder.encode(ids)
            words = [w.astype("<u4").tobytes() for _, w in coded]
            yield pa.RecordBatch.from_arrays([
                pa.array([r["part"] for r in rows], pa.int32()), pa.array([r["block"] for r in rows], pa.int32()),
                pa.array([first_of.value[r["part"]] + r["at"] for r in rows], pa.int64()), pa.array([len(x) for x in ids], pa.int32()),
                pa.array([r["docs"] for r in rows], pa.list_(_PIECE)), pa.array([s.astype("<u8").tobytes() for s, _ in coded], pa.binary()),
                pa.array(words, pa.binary()), pa.array([zlib.crc32(w) for w in words], pa.int64()),
                pa.array([zlib.crc32(r["ids"]) for r in rows], pa.int64()),
            ], names=["part", "block", "first_token", "n_tokens", "docs", "states", "words", "words_crc", "ids_crc"])

    blocks = map_arrow(staged.filter("counts IS NULL").select("part", "block", "at", "ids", "docs"), run, _BLOCKS)
    blocks.write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop("staged")
    used = np.flatnonzero(table)
    frequencies = pd.DataFrame({"id": used.astype("int32"), "frequency": table[used]})
    spark.createDataFrame(frequencies, "id int, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    parts = pd.DataFrame({"part": sizes["part"].to_numpy("int32"), "first_token": base, "n_tokens": sizes["at"].to_numpy()})
    spark.createDataFrame(parts, "part int, first_token long, n_tokens long").coalesce(1).write.parquet(f"{path}/parts")


def _coder_of(spark: SparkSession, path: str):
    stored = spark.read.schema("id int, frequency long").parquet(f"{path}/frequencies").toPandas()
    table = np.zeros(int(stored["id"].max()) + 1 if len(stored) else 1, np.int64)
    table[stored["id"].to_numpy()] = stored["frequency"].to_numpy()
    return spark.sparkContext.broadcast(table)


def _decoded(rows: list[dict], coder: rans.Coder) -> list[np.ndarray]:
    for r in rows:
        if zlib.crc32(r["words"]) != r["words_crc"]:
            raise ValueError(f"block {r['block']} of part {r['part']} is damaged")
    ids = coder.decode([(r["n_tokens"], np.frombuffer(r["states"], "<u8"), np.frombuffer(r["words"], "<u4")) for r in rows])
    for r, own in zip(rows, ids):
        if zlib.crc32(own.astype("<u4").tobytes()) != r["ids_crc"]:
            raise ValueError(f"block {r['block']} of part {r['part']} decodes to other ids")
    return ids


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, piece, ids): the ids read back; documents of more than ``rans.BLOCK`` ids come in pieces."""
    shared = _coder_of(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(shared.value)
        for rows in _blocks(batches, TOGETHER):
            for r, own in zip(rows, _decoded(rows, coder)):
                ends = np.cumsum([0] + [d["n"] for d in r["docs"]])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([d["doc_id"] for d in r["docs"]], pa.int64()), "start": pa.array(r["first_token"] + ends[:-1], pa.int64()),
                    "piece": pa.array([d["piece"] for d in r["docs"]], pa.int32()),
                    "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own.astype(np.int32))),
                })

    return map_arrow(_stored(spark, path), run, "doc_id long, start long, piece int, ids array<int>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its decoded ids. Blocks are decoded in parallel."""
    shared = _coder_of(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rans.Coder(shared.value)
        for rows in _blocks(batches, TOGETHER):
            for r, own in zip(rows, _decoded(rows, coder)):
                ends = np.cumsum([0] + [d["n"] for d in r["docs"]])
                raw = own.astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([d["doc_id"] for d in r["docs"]], pa.int64()),
                    "start": pa.array([r["first_token"] + int(a) for a in ends[:-1]], pa.int64()),
                    "n": pa.array([d["n"] for d in r["docs"]], pa.int64()), "piece": pa.array([d["piece"] for d in r["docs"]], pa.int32()),
                    "whole": pa.array([d["whole"] for d in r["docs"]], pa.bool_()),
                    "part": pa.array([r["part"]] * len(r["docs"]), pa.int32()), "at": pa.array([d["at"] for d in r["docs"]], pa.int64()),
                    "crc": pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64()),
                })

    ship(spark)

    def pieces(blocks: DataFrame) -> DataFrame:
        return map_arrow(blocks, run, "doc_id long, start long, n long, piece int, whole boolean, part int, at long, crc long")

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: rans.crc_joined([(4 * x["n"], x["crc"]) for x in p]))

    stored = _stored(spark, path)
    whole = pieces(stored).filter("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # the few blocks with pieces of longer documents are decoded for these once more
    split = stored.filter(F.exists("docs", lambda d: ~d["whole"]))
    long = pieces(split).filter("NOT whole").groupBy("part", "at").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("piece", "n", "crc"))).alias("p"),
    )
    return whole.unionByName(long.select("doc_id", "start", "n_tokens", joined("p").alias("ids_crc32")))


def token_table(docs: DataFrame) -> DataFrame:
    """Writes the files to the shared folder and returns what :func:`read_digests` finds in them."""
    scratch = Scratch(docs.sparkSession, "token-files")
    write(docs, scratch.place("files"))
    return read_digests(docs.sparkSession, scratch.place("files"))
