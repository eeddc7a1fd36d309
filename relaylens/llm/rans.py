"""Static range asymmetric numeral coding of token ids, in independent blocks of interleaved lanes."""

from __future__ import annotations

import zlib

import numpy as np

SCALE = 20
LANES = 256
BLOCK = 1 << 16
_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << SCALE) - 1)


def frequencies(ids: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Frequencies of ``size`` symbols that sum to 2 ** SCALE, at least 1 for each symbol counted."""
    out = np.zeros(size, np.int64)
    if not len(ids):
        return out
    if len(ids) > 1 << SCALE:
        raise ValueError(f"more than {1 << SCALE} different ids")
    total = int(counts.sum())
    scaled = np.maximum(1, np.array([int(n) * (1 << SCALE) // total for n in counts], np.int64))
    rest = (1 << SCALE) - int(scaled.sum())
    order = np.lexsort((ids, -scaled))
    while rest:
        # what rounding left over goes to, or comes from, the largest
        able = order[scaled[order] > 1] if rest < 0 else order
        step = able[:abs(rest)]
        scaled[step] += 1 if rest > 0 else -1
        rest += -len(step) if rest > 0 else len(step)
    out[ids] = scaled
    return out


class Coder:
    """Encodes and decodes blocks with one shared table of frequencies."""

    def __init__(self, table: np.ndarray):
        # the symbol after the last stands for nothing: coding it leaves a state as it is
        self.size = len(table)
        self.frequency = np.append(table, 1 << SCALE).astype(np.uint64)
        self.start = np.append(np.cumsum(table) - table, 0).astype(np.uint64)
        self.symbol = np.repeat(np.arange(self.size, dtype=np.uint32), table)

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(states, words) of each block of at most ``BLOCK`` ids, all blocks at a time.

        Id k of a block is in lane k % LANES. Lanes are coded from their last id to the first; the words that lanes give
        off lie in the order in which decoding takes them up.
        """
        steps = max((-(-len(b) // LANES) for b in blocks), default=0)
        ids = np.full((len(blocks), steps * LANES), self.size, np.int64)
        for row, block in zip(ids, blocks):
            row[:len(block)] = block
        ids = ids.reshape(len(blocks), steps, LANES)
        state = np.full((len(blocks), LANES), _LOW, np.uint64)
        words = np.empty((steps, len(blocks), LANES), np.uint32)
        given = np.empty((steps, len(blocks), LANES), bool)
        for step in range(steps - 1, -1, -1):
            frequency, start = self.frequency[ids[:, step]], self.start[ids[:, step]]
            full = state >= frequency << np.uint64(63 - SCALE)
            words[step], given[step] = state & np.uint64(0xFFFFFFFF), full
            state = np.where(full, state >> np.uint64(32), state)
            quotient = state // frequency
            state = (quotient << np.uint64(SCALE)) + (state - quotient * frequency) + start
        return [(state[b], words[:, b][given[:, b]]) for b in range(len(blocks))]

    def decode(self, blocks: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of blocks given as (number of ids, states, words)."""
        if not blocks:
            return []
        counts = np.array([n for n, _, _ in blocks])
        steps = int(-(-counts.max() // LANES))
        words = np.concatenate([w for _, _, w in blocks] + [np.zeros(1, np.uint32)]).astype(np.uint64)
        at = np.cumsum([0] + [len(w) for _, _, w in blocks[:-1]])[:, None]
        state = np.stack([s for _, s, _ in blocks])
        out = np.empty((len(blocks), steps, LANES), np.uint32)
        lane = np.arange(LANES)
        for step in range(steps):
            slot = state & _MASK
            symbol = self.symbol[slot]
            out[:, step] = symbol
            live = step * LANES + lane < counts[:, None]
            after = self.frequency[symbol] * (state >> np.uint64(SCALE)) + slot - self.start[symbol]
            short = live & (after < _LOW)
            place = at + np.cumsum(short, axis=1) - 1
            after = np.where(short, after << np.uint64(32) | words[np.where(short, place, 0)], after)
            at = at + short.sum(axis=1, keepdims=True)
            state = np.where(live, after, state)
        return [row.reshape(-1)[:n] for row, n in zip(out, counts)]


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings put together, from the (length, CRC-32) of each."""
    out = 0
    for length, crc in parts:
        # a CRC is affine in its start value, so appending as many zeros shows what the start contributes
        carried, bare = out, 0
        for begin in range(0, length, 1 << 20):
            zeros = bytes(min(1 << 20, length - begin))
            carried, bare = zlib.crc32(zeros, carried), zlib.crc32(zeros, bare)
        out = carried ^ bare ^ crc
    return out
