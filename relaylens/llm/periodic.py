"""Periodic runs of words: multi-scale minimizers seed the long periods, direct scans at each lag find the short ones."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.llm import textkit
from relaylens.llm.common import map_arrow

#: A run is at least this many times as long as its period, and at least this many words long.
TIMES, LEAST = 4, 6
#: Periods up to here are found by comparing every word with the one this many places on.
LAGS = 8
_SALT = np.uint64(0xD1B54A32D192ED03)


def _unique(n: int, salt: int) -> np.ndarray:
    """Codes that no word has."""
    return textkit.mix(np.arange(n, dtype=np.uint64) * _SALT + np.uint64(salt))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` (a power of two) consecutive values."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """The places whose gram is the smallest of some window of ``width`` consecutive places."""
    if len(grams) < width:
        return np.zeros(0, np.int64)
    low = _sliding(grams, width, np.minimum)
    # the largest of the minima of all windows that hold the place is the place's own gram
    edge = np.zeros(width - 1, np.uint64)
    highest = _sliding(np.concatenate([edge, low, edge]), width, np.maximum)
    return np.flatnonzero(highest == grams)


def _factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return [*out, n] if n > 1 else out


def _smallest(codes: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no smaller period holds over ``codes[start:end]``, at least two periods long: it would divide the period."""
    return not any(np.array_equal(codes[start:end - period // f], codes[start + period // f:end]) for f in _factors(period))


def _reach(codes: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The largest stretch around ``at`` whose words equal those ``lag`` places on, by blocks that double in size."""
    low, high, n = at, at, len(codes) - lag
    size = 64
    while high < n:
        differ = np.flatnonzero(codes[high:min(high + size, n)] != codes[high + lag:min(high + size, n) + lag])
        if len(differ):
            high += int(differ[0])
            break
        high, size = min(high + size, n), size * 2
    size = 64
    while low > 0:
        differ = np.flatnonzero(codes[max(low - size, 0):low] != codes[max(low - size, 0) + lag:low + lag])
        if len(differ):
            low = max(low - size, 0) + int(differ[-1]) + 1
            break
        low, size = max(low - size, 0), size * 2
    return low, high


def _short(codes: np.ndarray, times: int, least: int, lags: int) -> Iterator[tuple[int, int, int]]:
    for lag in range(1, lags + 1):
        if len(codes) <= lag:
            return
        begins, ends = textkit.stretches(codes[:-lag] == codes[lag:])
        long = ends - begins >= max(least, times * lag) - lag
        for a, b in zip(begins[long].tolist(), ends[long].tolist()):
            if _smallest(codes, a, b + lag, lag):
                yield a, b + lag, lag


def _seeded(codes: np.ndarray, grams: np.ndarray, size: int, times: int) -> Iterator[tuple[int, int, int]]:
    """Runs with a period above ``size`` / 2 and up to ``size``; ``grams`` are the codes of ``size`` consecutive words.

    A run has one minimizer in each half ``size`` of places, and the same ones a period later; in between no gram is equal,
    as its own period would be shorter. So equal minimizers next to each other lie a period apart.
    """
    places = minimizers(grams, size // 2)
    order = places[np.argsort(grams[places], kind="stable")]
    gap = np.diff(order)
    pair = np.flatnonzero((grams[order[1:]] == grams[order[:-1]]) & (gap > size // 2) & (gap <= size))
    done: dict[int, int] = {}
    seeds = np.lexsort((order[pair], gap[pair]))
    for at, lag in zip(order[pair][seeds].tolist(), gap[pair][seeds].tolist()):
        if at < done.get(lag, -1):
            continue
        low, high = _reach(codes, at, lag)
        done[lag] = max(high, at + 1)
        if high + lag - low >= times * lag and _smallest(codes, low, high + lag, lag):
            yield low, high + lag, lag


def find_runs(words: np.ndarray, first: np.ndarray, times: int = TIMES, least: int = LEAST, lags: int = LAGS) -> list[np.ndarray]:
    """(start, length, period) of every run of each text, in that order; ``words`` are codes, text i has ``words[first[i]:first[i + 1]]``.

    ``times`` is 4 or more and ``lags`` a power of two: the guarantee of :func:`_seeded` needs runs of four periods.
    """
    counts = np.diff(first)
    out: list[set[tuple[int, int, int]]] = [set() for _ in counts]
    which = np.flatnonzero(counts > 1)
    # each text ends with a word of its own, so that nothing repeats over the edge of two texts
    owner = np.repeat(np.arange(len(which)), counts[which] + 1)
    base = np.cumsum(counts[which] + 1) - counts[which] - 1
    inside = np.arange(len(owner)) - base[owner]
    closing = inside == counts[which][owner]
    codes = words[np.where(closing, 0, first[which][owner] + inside)] if len(words) else words
    codes = np.where(closing, _unique(len(codes), 1)[:len(codes)], codes)

    def add(found: Iterator[tuple[int, int, int]]) -> None:
        for a, b, period in found:
            k = int(np.searchsorted(base, a, "right")) - 1
            out[which[k]].add((a - int(base[k]), b - a, period))

    add(_short(codes, times, least, lags))
    size, grams = 1, codes
    while True:
        grams = textkit.mix(grams * np.uint64(0x9DDFEA08EB382D69) + np.concatenate([grams[size:], _unique(min(size, len(grams)), size + 2)]))
        size *= 2
        if size <= lags:
            continue
        # texts too short for a run at this scale leave
        stay = counts[which] >= max(least, times * (size // 2 + 1))
        if not stay.any():
            break
        if not stay.all():
            mask = np.repeat(stay, counts[which] + 1)
            codes, grams, which = codes[mask], grams[mask], which[stay]
            base = np.cumsum(counts[which] + 1) - counts[which] - 1
        add(_seeded(codes, grams, size, times))
    return [np.array(sorted(runs), np.int64).reshape(-1, 3) for runs in out]


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Flags of the words that some run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run with the greatest length by period; ties go to the smallest start, then period."""
    return min(map(tuple, runs.tolist()), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def made_periodic(key: str, n: int) -> np.ndarray | None:
    """Places of the words that a tenth of all documents get in place of their own, so that their tails are periodic."""
    h = zlib.crc32(key.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


Arrange = Callable[[str, int], np.ndarray | None]


def _scan(docs: DataFrame, arrange: Arrange | None, times: int, least: int, fields: list[T.StructField], emit: Callable) -> DataFrame:
    """Runs of every text, and what ``emit`` makes of them. ``emit`` gets each text's runs and its kept words' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text"):
            texts = textkit.texts_of(batch.column("text"))
            starts, ends, first = texts.words(textkit.NOT_SPACE)
            codes = texts.hashes(starts, ends)
            moved: dict[int, np.ndarray] = {}
            if arrange is not None:
                for k, key in enumerate(batch.column("key").to_pylist()):
                    places = None if key is None else arrange(key, int(first[k + 1] - first[k]))
                    if places is not None:
                        moved[k] = first[k] + places
                shuffled = codes.copy()
                for k, places in moved.items():
                    shuffled[first[k]:first[k + 1]] = codes[places]
                codes = shuffled
            found = find_runs(codes, first, times, least)
            keep = np.ones(len(codes), bool)
            for k, runs in enumerate(found):
                if len(runs):
                    keep[first[k]:first[k + 1]] = ~dropped(runs, int(first[k + 1] - first[k]))
            data, offsets = textkit.kept_words(texts, starts, ends, first, keep)
            kept = [data[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for k, places in moved.items():
                chosen = places[keep[first[k]:first[k + 1]]]
                kept[k] = np.frombuffer(b" ".join(texts.data[a:b].tobytes() for a, b in zip(starts[chosen], ends[chosen])), np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *emit(found, kept)], names=["doc_id", "n_words", *[f.name for f in fields]]
            )

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()), *fields])
    lean = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("doc_id").cast("string").alias("key"))
    return map_arrow(lean, run, schema)


def _run_lists(found: list[np.ndarray]) -> pa.Array:
    every = np.concatenate([*found, np.zeros((0, 3), np.int64)])
    structs = pa.StructArray.from_arrays([pa.array(every[:, c]) for c in range(3)], names=["start", "length", "period"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), structs)


_RUNS = T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])))


def periodic_runs(docs: DataFrame, *, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs: every run of words of each text, by first word and period.

    A run is a stretch of words with smallest period q, at least ``times`` * q and ``least`` words long, that no neighbouring
    word extends. ``times`` is 4 or more. Null and empty texts have no words and no runs; rows that repeat, and rows without
    a doc_id, are judged each for themselves; a table without rows gives none; other columns are ignored. A text of any
    length is read whole by one worker, in time n log n and memory proportional to n. Words are told apart by 64-bit codes.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not found for certain")
    return _scan(docs, None, times, least, [_RUNS], lambda found, kept: [_run_lists(found)])


def collapsed(docs: DataFrame, *, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, text: the words of each text without those that a run holds after its first period, joined by one space.

    Edge cases as in :func:`periodic_runs`; a text without words becomes the empty text.
    """
    if times < 4:
        raise ValueError("runs of fewer than four periods are not found for certain")
    text = T.StructField("text", T.StringType())
    return _scan(docs, None, times, least, [text], lambda found, kept: [pa.array([k.tobytes().decode() for k in kept], pa.string())])


def run_table(docs: DataFrame) -> DataFrame:
    """The digest of every document's runs after :func:`made_periodic`: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    Edge cases as in :func:`periodic_runs`. Words of a document without a doc_id stay as they are.
    """
    names = ["n_runs", "start", "length", "period", "exponent_milli"]
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]

    def emit(found: list[np.ndarray], kept: list[np.ndarray]) -> list[pa.Array]:
        best = [strongest(runs) for runs in found]
        listed = ["".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist()) for runs in found]
        columns = [[b and b[c] for b in best] for c in range(3)]
        return [
            pa.array([len(r) for r in found], pa.int64()), *[pa.array(c, pa.int64()) for c in columns],
            pa.array([b and 1000 * b[1] // b[2] for b in best], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in listed]), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
        ]

    return _scan(docs, made_periodic, TIMES, LEAST, fields, emit).drop("n_words")
