"""Words, lines and their 64-bit hashes of many texts at once, on numpy views of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = (2 << 20) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240131).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_OTHER = np.random.default_rng(20240201).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)

#: Bytes that belong to a word. Bytes from 0x80 on belong to characters outside ASCII, which both kinds of word hold.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    ALNUM[_low:_high + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _grown(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = 1 << (n - 1).bit_length()
        powers, inverses = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        powers[0] = inverses[0] = 1
        _powers, _inverses = np.multiply.accumulate(powers), np.multiply.accumulate(inverses)


class Texts:
    """The UTF-8 bytes of consecutive texts; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._sums: dict[bool, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> Texts:
        """With A-Z as a-z."""
        return Texts(LOWER[self.data], self.offsets)

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every maximal run of ``inside`` bytes, and the number of the first word of each text."""
        flags = inside[self.data]
        before = np.empty_like(flags)
        before[:1] = False
        before[1:] = flags[:-1]
        after = np.empty_like(flags)
        after[-1:] = False
        after[:-1] = flags[1:]
        cuts = self.offsets[(self.offsets > 0) & (self.offsets < len(flags))]
        before[cuts] = False
        after[cuts - 1] = False
        starts = np.flatnonzero(flags & ~before)
        return starts, np.flatnonzero(flags & ~after) + 1, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First byte and end of every line (split at newlines; an empty text has one empty line), and each text's first line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        owner = np.concatenate([np.arange(len(self)), np.searchsorted(self.offsets, breaks, "right") - 1])
        # a text's first start comes with the others of the text; its ends are put in order of place likewise
        by_start, by_end = np.lexsort((starts, owner)), np.lexsort((ends, owner))
        counts = np.bincount(owner, minlength=len(self)) if len(self) else np.zeros(0, np.int64)
        return starts[by_start], ends[by_end], np.concatenate([[0], np.cumsum(counts)])

    def hashes(self, starts: np.ndarray, ends: np.ndarray, *, second: bool = False) -> np.ndarray:
        """A 64-bit hash of the bytes of every span, or the second of two such hashes."""
        n = len(self.data)
        _grown(n + 1)
        if second not in self._sums:
            self._sums[second] = np.zeros(n + 1, np.uint64)
            np.cumsum((_OTHER if second else _BYTE)[self.data] * _powers[:n], out=self._sums[second][1:])
        sums = self._sums[second][ends] - self._sums[second][starts]
        return mix(sums * _inverses[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Number of flagged bytes in each text."""
        return sums_between(flags, self.offsets)


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values[bounds[i]:bounds[i + 1]]`` for each i."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def owners(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to, from the number of each text's first word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def texts_of(column: pa.Array | pa.ChunkedArray) -> Texts:
    """View of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return Texts(data[offsets[0]:offsets[-1]], offsets - offsets[0])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = texts_of(batch.column(column)).offsets[1:]
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of ``width`` consecutive words for every window that lies in one text, and the number of its first word."""
    last = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(len(hashes)) + width <= last)
    out = np.zeros(len(at), np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + hashes[at + k])
    return out, at


def kept_words(texts: Texts, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each text's words flagged in ``keep``, joined by one space, and where each text's bytes begin."""
    chosen = np.flatnonzero(keep)
    edges = np.zeros(len(texts.data) + 1, np.int8)
    edges[starts[chosen]] += 1
    edges[ends[chosen]] -= 1
    inside = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)
    owner = np.searchsorted(first, chosen, "right")
    later = np.zeros(len(chosen), bool)
    later[1:] = owner[1:] == owner[:-1]
    # the byte before a word that is not its text's first is white space
    gaps = starts[chosen[later]] - 1
    inside[gaps] = True
    data = texts.data.copy()
    data[gaps] = 0x20
    total = np.zeros(len(inside) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    return data[inside], total[texts.offsets]


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of every maximal stretch of true flags."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]
