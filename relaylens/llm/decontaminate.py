"""Benchmark decontamination: an FM-index over the words of every shard of documents, searched for benchmark phrases."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.llm import textkit
from relaylens.llm.common import fresh, map_arrow, text_of
from relaylens.llm.fm_index import FMIndex

WIDTH = 10
#: Bytes of benchmark text that are sent to the tasks at a time; a larger benchmark is searched for in several blocks.
BLOCK_BYTES = 16 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPAN),
])


class Phrases:
    """The distinct windows of a block of benchmark items, as symbols of the block's own vocabulary (from 1 on)."""

    def __init__(self, items: pd.DataFrame, width: int = WIDTH):
        texts = textkit.texts_of(pa.array(items["text"], pa.string(), from_pandas=True)).lowered()
        starts, ends, first = texts.words(textkit.ALNUM)
        hashes = texts.hashes(starts, ends)
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        windows: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for k, item in enumerate(items["item_id"]):
            own = symbols[first[k]:first[k + 1]].tolist()
            for at in range(max(1, len(own) - width + 1)) if own else ():
                windows[tuple(own[at:at + width])].add(item)
        self.items = list(windows.values())
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), width), np.int64)
        for k, w in enumerate(windows):
            self.words[k, :len(w)] = w

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 for words that no phrase holds."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def find(column: pa.Array, phrases: Phrases, earlier: pa.Array | None = None) -> pa.StructArray:
    """What occurs in each text: words, words hit, items, and the removal spans in code points, merged."""
    texts = textkit.texts_of(column).lowered()
    starts, ends, first = texts.words(textkit.ALNUM)
    owner = textkit.owners(first)
    symbols = phrases.symbols_of(texts.hashes(starts, ends))
    # documents are kept apart by a separator after each
    apart = np.arange(len(starts)) + owner
    sequence = np.zeros(len(starts) + len(texts), np.int64)
    sequence[apart] = symbols
    place = np.zeros(len(sequence), np.int64)
    place[apart] = np.arange(len(starts))
    index = FMIndex(sequence)
    low, high = index.search(phrases.words, phrases.lengths)
    counts = np.maximum(high - low, 0)
    at = place[index.locate(_ranges(low, counts))]
    which = np.repeat(np.arange(len(counts)), counts)

    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + phrases.lengths[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    items: list[set[str]] = [set() for _ in range(len(texts))]
    for document, phrase in set(zip(owner[at].tolist(), which.tolist())):
        items[document] |= phrases.items[phrase]
    if earlier is not None:
        for k, row in enumerate(earlier.to_pylist()):
            items[k] |= set(row["items"])
            for span in row["spans"]:
                inside = slice(first[k], first[k + 1])
                begin = texts.offsets[k]
                characters = _characters(texts.data, begin, starts[inside])
                hit[inside] |= (characters >= span["start"]) & (characters < span["end"])
    spans = [[] for _ in range(len(texts))]
    for document in np.unique(owner[hit]):
        inside = slice(first[document], first[document + 1])
        own, begin = hit[inside], texts.offsets[document]
        edges = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
        heads, tails = starts[inside][edges[:-1] == 1], ends[inside][np.flatnonzero(edges == -1) - 1]
        spans[document] = [
            {"start": int(a), "end": int(b)}
            for a, b in zip(_characters(texts.data, begin, heads), _characters(texts.data, begin, tails))
        ]
    rows = [
        {"n_words": int(w), "n_hit": int(h), "items": sorted(i), "spans": s}
        for w, h, i, s in zip(np.diff(first), textkit.sums_between(hit, first), items, spans)
    ]
    return pa.array(rows, pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]))


def _characters(data: np.ndarray, begin: int, at: np.ndarray) -> np.ndarray:
    """Code points between byte ``begin`` and the bytes ``at``."""
    if not len(at):
        return at
    lead = np.concatenate([[0], np.cumsum((data[begin:at.max()] & 0xC0) != 0x80)])
    return lead[at - begin]


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """The benchmark's items in blocks of about ``block_bytes``, dealt by a hash of the item."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), text_of().alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    count = max(1, -(-total // block_bytes))
    for block in range(count):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).orderBy("item_id", "text").toPandas()


def with_found(docs: DataFrame, benchmark: DataFrame, name: str, *, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with struct column ``name``: n_words, n_hit, items (sorted as strings), spans (start, end in code points).

    Words are runs of ASCII letters, digits and characters outside ASCII, A-Z lower-cased. Every window of ``width``
    consecutive words of an item (the whole item, where it has fewer) is searched for in an FM-index over the words of each
    shard of about 2 MB of text: suffix array by prefix doubling, wavelet ranks for the backward search, sampled
    suffix positions to locate the hits. Documents are scanned and never shuffled. Tasks get the benchmark in blocks
    of bounded size; each further block is a further search over the same rows.
    """
    lean = docs.withColumn("text", F.col("text").cast("string"))
    found = lean
    schema = T.StructType([*lean.schema.fields, T.StructField(name, FOUND)])
    for number, block in enumerate(blocks(benchmark, block_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block, width))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in textkit.slices(batches, "text"):
                columns = batch.columns[:-1] if number else batch.columns
                result = find(batch.column("text"), phrases, batch.columns[-1] if number else None)
                yield pa.RecordBatch.from_arrays([*columns, result], names=schema.names)

        found = map_arrow(found, run, schema)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every document.

    Null text has no words; a null item_id counts as the empty string; repeated rows are searched alike; without
    benchmark items nothing is hit; other columns are ignored.
    """
    found = with_found(docs.select("doc_id", "text"), benchmark, "found", **options)
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"), "found.spans",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark phrase occurs, all columns as they are."""
    name = fresh(docs.columns, "found")
    clean = with_found(docs, benchmark, name, **options).filter(F.col(name).getField("n_hit") == 0)
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_spans(text: str, spans: list) -> str:
    """``text`` without the given spans of code points (merged and in order, as this module returns them)."""
    out, at = [], 0
    for span in spans or ():
        out.append(text[at:span["start"]])
        at = span["end"]
    return "".join([*out, text[at:]])
