"""Substring dedup: suffixes of words in prefix-partitioned subtrees, whose deep inner nodes are the repeated passages."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.llm import textkit
from relaylens.llm.common import Scratch, map_arrow

#: Bytes of text whose words are hashed at a time; the hashes take sixty times as many.
PIECE_BYTES = (1 << 18) - 1
_STEP, _LAST, _ROUTE = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Plan:
    """``width`` words make a passage; suffixes are dealt out by their first ``prefixes[0]`` words, or by more where those are frequent.

    A subtree takes about ``group`` suffixes, a prefix is extended from a quarter of that on; ``batch`` words are read at a time.
    """

    width: int = 35
    prefixes: tuple[int, ...] = (12, 24)
    group: int = 1 << 21
    batch: int = 1 << 20

    @property
    def depths(self) -> tuple[int, ...]:
        return (*(p for p in self.prefixes if p < self.width), self.width)


def range_codes(words: np.ndarray, widths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each of the ascending ``widths``, the code of that many words from every place on.

    Codes of 1, 2, 4, ... words are made of two of half the length, any other of two that overlap. Places with too few
    words behind them get codes of no meaning.
    """
    def joined(codes: np.ndarray, factor: np.uint64, by: int) -> np.ndarray:
        out = codes * factor
        out[:max(len(codes) - by, 0)] += codes[by:]
        return textkit.mix(out)

    power, codes = 1, words
    for width in widths:
        while 2 * power <= width:
            codes = joined(codes, _STEP, power)
            power *= 2
        yield joined(codes, _LAST, width - power)


@dataclass
class Suffixes:
    """Suffixes of a batch of texts that have a whole passage before them, by place.

    ``prints`` identify the texts (two 64-bit hashes each), ``bounds`` are the places where each text's suffixes begin.
    ``codes`` has, for each depth, the code of as many words. ``once`` are the places that are the first of their passage here,
    ``again`` flags those whose passage stands more than once in the batch.
    """

    prints: np.ndarray
    bounds: np.ndarray
    codes: list[np.ndarray]
    once: np.ndarray
    again: np.ndarray


def _suffixes(words: np.ndarray, counts: np.ndarray, prints: np.ndarray, plan: Plan) -> Suffixes:
    first = np.concatenate([[0], np.cumsum(counts)])
    whole = np.maximum(counts - plan.width + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(whole)])
    at = np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], whole)
    codes = [c[at] for c in range_codes(words, plan.depths)]
    del at
    order = np.argsort(codes[-1], kind="stable")
    ranked = codes[-1][order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    del ranked
    again = np.zeros(len(order), bool)
    again[order[~new]] = True
    again[order[np.flatnonzero(~new) - 1]] = True
    return Suffixes(prints, bounds, codes, np.sort(order[new]), again)


def text_prints(texts: textkit.Texts) -> np.ndarray:
    """Two 64-bit hashes of each whole text, as an array of two columns."""
    a, b = texts.offsets[:-1], texts.offsets[1:]
    return np.stack([texts.hashes(a, b), texts.hashes(a, b, second=True)], axis=1).view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[Suffixes]:
    held, n = [], 0

    def taken() -> Suffixes:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        return _suffixes(*columns, plan)

    for batch in textkit.slices(batches, "text", PIECE_BYTES):
        texts = textkit.texts_of(batch.column("text"))
        starts, ends, first = texts.words(textkit.NOT_SPACE)
        held.append((texts.hashes(starts, ends), np.diff(first), text_prints(texts)))
        n += len(starts)
        del texts, starts, ends
        if n >= plan.batch:
            yield taken()
            n = 0
    if held:
        yield taken()


def frequent_prefixes(texts: DataFrame, plan: Plan) -> tuple[list[np.ndarray], int]:
    """For each depth but the last, the sorted codes of the prefixes with too many suffixes for one subtree, and the number of all suffixes.

    A batch counts the prefixes under which it has two different passages or more, so a count falls short by the number of
    batches at most. At most one prefix per quarter of a group of suffixes reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _batches(batches, plan):
            rows = [(np.full(1, -1), np.zeros(1, np.int64), np.array([len(s.once)]))]
            for depth, codes in enumerate(s.codes[:-1]):
                prefixes, n = np.unique(codes[s.once], return_counts=True)
                rows.append((np.full(int((n > 1).sum()), depth), prefixes[n > 1].view(np.int64), n[n > 1]))
            del s
            depth, code, n = map(np.concatenate, zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(depth.astype(np.int32)), pa.array(code), pa.array(n.astype(np.int64))], names=["depth", "code", "n"])

    counted = map_arrow(texts, run, "depth int, code long, n long").groupBy("depth", "code").agg(F.sum("n").alias("n"))
    rows = counted.filter((F.col("depth") < 0) | (F.col("n") > plan.group // 4)).collect()
    hot = [np.sort(np.array([r.code for r in rows if r.depth == d], np.int64).view(np.uint64)) for d in range(len(plan.depths) - 1)]
    return hot, sum(r.n for r in rows if r.depth < 0)


def _routes(s: Suffixes, hot: list[np.ndarray], groups: int) -> np.ndarray:
    """The subtree of each suffix in ``once``: by its shortest prefix that is not too frequent."""
    code = s.codes[0][s.once]
    for depth, frequent in enumerate(hot):
        longer = np.isin(s.codes[depth][s.once], frequent)
        if depth:
            longer &= longer_before
        code = np.where(longer, s.codes[depth + 1][s.once], code)
        longer_before = longer
    return ((textkit.mix(code ^ _ROUTE) >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _packed(places: np.ndarray) -> bytes:
    """Ascending places as compressed differences."""
    return pa.compress(np.diff(places, prepend=0).astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _places(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint32).astype(np.int64))


_SENT = "group int, batch binary, n int, places binary, codes binary, prints binary, bounds binary"


def _sent(texts: DataFrame, plan: Plan, hot: list[np.ndarray], groups: int) -> DataFrame:
    """Every batch's suffixes by subtree, and a row of the batch's own with its texts and what repeats inside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _batches(batches, plan):
            if not len(s.once):
                continue
            # equal batches share a name: what holds of one's places holds of the other's
            name = hashlib.blake2b(s.prints.tobytes(), digest_size=16).digest()
            route = _routes(s, hot, groups)
            order = np.argsort(route, kind="stable")
            used, begin = np.unique(route[order], return_index=True)
            rows = []
            for g, places in zip(used.tolist(), np.split(s.once[order], begin[1:])):
                rows.append((g, name, len(places), _packed(places), s.codes[-1][places].tobytes(), None, None))
            known = np.flatnonzero(s.again)
            rows.append((name[0] % groups, name, len(known), _packed(known), None, s.prints.tobytes(), s.bounds.astype(np.int64).tobytes()))
            del s, route, order, places
            kinds = [pa.int32(), pa.binary(), pa.int32(), *[pa.binary()] * 4]
            columns = list(zip(*rows))
            del rows
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["group", "batch", "n", "places", "codes", "prints", "bounds"])
            del columns

    return map_arrow(texts, run, _SENT)


def deep_nodes(codes: np.ndarray) -> np.ndarray:
    """Flags of the suffixes of a subtree that lie under an inner node as deep as a passage.

    In the order of the suffixes such a node is a stretch of neighbours that agree in a whole passage.
    """
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    del ranked
    out = np.zeros(len(codes), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


_FOUND = pa.schema([("batch", pa.binary()), ("n", pa.int32()), ("places", pa.binary()), ("prints", pa.binary()), ("bounds", pa.binary())])


def _values(column: pa.ChunkedArray) -> np.ndarray:
    """The 64-bit integers in all values of a binary column, without a copy where they are one chunk."""
    parts = [np.zeros(0, np.uint8)]
    for chunk in column.cast(pa.large_binary()).chunks:
        if len(chunk):
            edges = np.frombuffer(chunk.buffers()[1], np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[edges[0]:edges[-1]])
    return (parts[-1] if len(parts) <= 2 else np.concatenate(parts)).view(np.uint64)


def _subtree(group: pa.Table) -> pa.Table:
    """The places of one group's suffixes that repeat, by batch; rows of the batches' own go on as they are."""
    leaves = group.filter(group.column("codes").is_valid())
    counts = leaves.column("n").to_numpy()
    # one view of all codes: the values of a column lie one behind the other
    deep = deep_nodes(_values(leaves.column("codes")))
    out, at = [], 0
    for batch, n, data in zip(leaves.column("batch").to_pylist(), counts.tolist(), leaves.column("places")):
        flags, at = deep[at:at + n], at + n
        if flags.any():
            places = _places(data.as_py(), n)[flags]
            out.append({"batch": batch, "n": len(places), "places": _packed(places), "prints": None, "bounds": None})
    own = group.filter(group.column("prints").is_valid()).select(_FOUND.names)
    return pa.concat_tables([pa.Table.from_pylist(out, _FOUND), own.cast(_FOUND)])


def _passages(width: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        """Of one batch: each text with repeats, and the stretches of words that they cover."""
        rows = group.to_pylist()
        own = next(r for r in rows if r["prints"] is not None)
        prints, bounds = np.frombuffer(own["prints"], np.int64).reshape(-1, 2), np.frombuffer(own["bounds"], np.int64)
        found = np.zeros(bounds[-1], bool)
        for r in rows:
            found[_places(r["places"], r["n"])] = True
        texts = np.flatnonzero(np.add.reduceat(np.append(found, False), bounds[:-1]) * (np.diff(bounds) > 0))
        spans = []
        for k in texts:
            begin, end = textkit.stretches(found[bounds[k]:bounds[k + 1]])
            end = end + width - 1
            # stretches of passages that overlap are one
            part = np.flatnonzero(begin[1:] > end[:-1])
            spans.append(np.stack([begin[np.append(0, part + 1)], end[np.append(part, len(end) - 1)]], axis=1).astype(np.int64).tobytes())
        return pa.table({"p": pa.array(prints[texts, 0]), "q": pa.array(prints[texts, 1]), "spans": pa.array(spans, pa.binary())})

    return run


def repeated_passages(texts: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(p, q, spans): the hashes of each text that has repeated passages, and the stretches of words these cover (pairs of 64-bit integers)."""
    hot, total = frequent_prefixes(texts, plan)
    groups = max(texts.sparkSession.sparkContext.defaultParallelism, -(-total // plan.group))
    found = _sent(texts, plan, hot, groups).groupBy("group").applyInArrow(_subtree, "batch binary, n int, places binary, prints binary, bounds binary")
    return found.groupBy("batch").applyInArrow(_passages(plan.width), "p long, q long, spans binary")


def _with_passages(docs: DataFrame, plan: Plan, scratch: Scratch) -> DataFrame:
    """doc_id, text, spans of every row. Texts meet their stretches by hash; equal texts have the same ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text", PIECE_BYTES):
            prints = text_prints(textkit.texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints[:, 0]), pa.array(prints[:, 1])], names=["doc_id", "text", "p", "q"])

    lean = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # written before the join, which can then split the rows of a text with many copies
    one = scratch.keep(repeated_passages(lean.select("text"), plan).groupBy("p", "q").agg(F.first("spans").alias("spans")), "passages")
    schema = T.StructType([*lean.schema.fields, T.StructField("p", T.LongType()), T.StructField("q", T.LongType())])
    return map_arrow(lean, run, schema).join(one, ["p", "q"], "left").select("doc_id", "text", "spans")


def _scan(docs: DataFrame, plan: Plan, fields: list[T.StructField], emit: Callable[[list[np.ndarray], np.ndarray, list[np.ndarray]], list[pa.Array]]) -> DataFrame:
    """``emit`` gets each text's stretches, its number of words removed, and its kept words' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text", PIECE_BYTES):
            texts = textkit.texts_of(batch.column("text"))
            starts, ends, first = texts.words(textkit.NOT_SPACE)
            keep = np.ones(len(starts), bool)
            spans = [np.frombuffer(s or b"", np.int64).reshape(-1, 2) for s in batch.column("spans").to_pylist()]
            for k, pairs in enumerate(spans):
                for a, b in pairs.tolist():
                    keep[first[k] + a:first[k] + b] = False
            data, offsets = textkit.kept_words(texts, starts, ends, first, keep)
            kept = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            out = emit(spans, textkit.sums_between(~keep, first), kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *out], names=["doc_id", "n_words", *[f.name for f in fields]])

    rows = _with_passages(docs, plan, Scratch(docs.sparkSession, "substrings"))
    return map_arrow(rows, run, T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), *fields]))


def repeats(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_words, spans: the stretches of words (start, end) of each text that repeated passages cover, by start.

    A passage is ``plan.width`` consecutive words of one text that also start anywhere else, in the same text included. Words
    are what white space (ASCII) parts, compared as they are. Null, empty and shorter texts have no passage. Rows that
    repeat are copies of each other, so their passages all count; rows without a doc_id are judged like others; a
    table without rows gives none; other columns are ignored. A text of any length is read whole by one worker. The same
    rows must come again when ``docs`` is read again, as from files.

    Passages are told apart by 64-bit codes among those of one subtree, so of N words about N * ``plan.group`` / 2 ** 65
    pairs of different passages are taken for equal (1e-5 of a pair in 30 GB). A subtree holds a suffix of each different
    passage per batch, so that a passage found everywhere is no hot key; prefixes too frequent for one subtree are extended.
    """
    def emit(spans: list[np.ndarray], removed: np.ndarray, kept: list[np.ndarray]) -> list[pa.Array]:
        every = np.concatenate([*spans, np.zeros((0, 2), np.int64)])
        structs = pa.StructArray.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["start", "end"])
        return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), structs)]

    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return _scan(docs, plan, [T.StructField("spans", T.ArrayType(pair))], emit)


def without_repeats(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_words, text: the words outside repeated passages joined by one space; edge cases as in :func:`repeats`."""
    return _scan(docs, plan, [T.StructField("text", T.StringType())], lambda spans, removed, kept: [pa.array([k.tobytes().decode() for k in kept], pa.string())])


def removal_table(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; edge cases as in :func:`repeats`."""
    fields = [T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    return _scan(docs, plan, fields, lambda spans, removed, kept: [pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])])
