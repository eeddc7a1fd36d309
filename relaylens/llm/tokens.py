"""Token ids of many texts, and the bytes that each token stands for."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from relaylens.llm import textkit

#: Distinct words that a Python worker remembers the ids of, before it starts anew.
REMEMBERED = 500_000
#: Bytes of text whose words are looked up at a time.
PIECE_BYTES = (1 << 20) - 1
#: Words that are handed to the library in one text.
TOGETHER = 1000
_SPACE, _NEWLINE, _APOSTROPHE = 0x20, 0x0A, 0x27
#: Bytes that are white space for some definition of it.
_WHITE = np.isin(np.arange(256), [*range(0x09, 0x0E), *range(0x1C, 0x21)])
#: ASCII letters, digits and other visible characters; 0 for all other bytes.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Places of the white-space characters outside ASCII."""
    out = []
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        width = 2 if lead == 0xC2 else 3
        at = at[at + width <= len(data)]
        second = data[at + 1]
        third = data[at + width - 1]
        if lead == 0xC2:
            found = (second == 0x85) | (second == 0xA0)
        elif lead == 0xE1:
            found = (second == 0x9A) & (third == 0x80)
        elif lead == 0xE2:
            found = ((second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))) | ((second == 0x81) & (third == 0x9F))
        else:
            found = (second == 0x80) & (third == 0x80)
        out.append(at[found])
    return np.concatenate(out)


def _irregular(texts: textkit.Texts) -> np.ndarray:
    """Whether a text has white space other than single spaces and newlines between other characters."""
    data, offsets = texts.data, texts.offsets
    white = _WHITE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    inner = offsets[:-1][np.diff(offsets) > 0]
    before[inner] = True
    after[offsets[1:][np.diff(offsets) > 0] - 1] = True
    odd = ((data == _SPACE) | (data == _NEWLINE)) & (before | after)
    out = np.zeros(len(texts), bool)
    places = np.concatenate([np.flatnonzero(odd), _wide_space(data)])
    out[np.searchsorted(offsets, places, "right") - 1] = True
    return out


def _kinds(data: np.ndarray) -> np.ndarray:
    """1 to 3 for the bytes of letters (ASCII and U+00C0 to U+017F), digits and other visible characters of ASCII; 0 for all others."""
    kinds = _KIND[data]
    lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC5))
    # U+00D7 and U+00F7 are signs
    lead = lead[(data[lead] != 0xC3) | ((data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7))]
    kinds[lead] = kinds[lead + 1] = 1
    return kinds


def _places(data: bytes, part: bytes) -> list[int]:
    out, at = [], data.find(part)
    while at >= 0:
        out.append(at)
        at = data.find(part, at + 1)
    return out


def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the character that byte-level vocabularies write for each byte of :func:`_kinds`, and their number."""
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    shown = [b""] * 256
    for c in map(chr, [*range(0x80), *range(0xC0, 0x180)]):
        for byte, written in zip(c.encode(), level.pre_tokenize_str(c)[0][0]):
            shown[byte] = written.encode()
    return np.array([list(c.ljust(2, b"\0")) for c in shown], np.uint8), np.array([len(c) for c in shown])


class Encoder:
    """A byte-level BPE tokenizer file. Every text gets the ids that the library gives for the whole text.

    The pre-tokenizer always cuts before a single space, and before and after a single newline, that stands between
    other characters. So where all white space of a text is of this kind, its words are encoded one by one, each
    distinct word once, and the ids put together; other texts are handed to the library whole. Words are remembered by two
    64-bit hashes; a word that agrees in one only sends its text to the library, too.

    The usual byte-level pre-tokenizer cuts between letters, digits and other visible characters, too, but for what follows
    an apostrophe. With it, words are cut there where both sides are of :func:`_kinds`, and a word of one kind goes to the
    library's model as it is, without the pre-tokenizer's expression. Texts that hold a special token are handed over whole.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(k) or "" for k in range(size)]
        added = set(self.tokenizer.get_added_tokens_decoder())
        # a byte-level vocabulary writes each byte as one character
        self.bytes_of = np.array([len(n.encode()) if k in added else len(n) for k, n in enumerate(names)], np.int64)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.model = self._bare_model()
        self._forget()

    def _bare_model(self) -> Tokenizer | None:
        """The file's model alone, for words parted by spaces in the vocabulary's characters, if its pre-tokenizer is the usual one."""
        file = json.loads(self.tokenizer.to_str())
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if not usual.items() <= (file["pre_tokenizer"] or {}).items() or any(file[k] for k in ("normalizer", "truncation", "padding")):
            return None
        self.shown, self.width = _alphabet()
        return Tokenizer.from_str(json.dumps(file | {"added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))

    def _forget(self) -> None:
        self.known, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """``hashes`` ascend."""
        start = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, ids])
        at = np.searchsorted(self.known, hashes)
        self.known, self.check = np.insert(self.known, at, hashes), np.insert(self.check, at, checks)
        self.start, self.length = np.insert(self.start, at, start), np.insert(self.length, at, length)

    def _new(self, data: np.ndarray, kinds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words at these places, and their number for each word."""
        # a space at a word's start goes with the characters behind it
        head = starts + (data[starts] == _SPACE)
        turns = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kinds[1:] != kinds[:-1], out=turns[2:])
        bare = (head < ends) & (self.model is not None)
        bare[bare] = (kinds[head[bare]] > 0) & (turns[ends[bare]] == turns[head[bare] + 1])
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts[~bare].tolist(), ends[~bare].tolist())]
        sides = [(bare, self._of_model(data, starts[bare], ends[bare])), (~bare, self._apart(words, (ends - starts)[~bare]))]
        length = np.zeros(len(starts), np.int64)
        for side, (_, own) in sides:
            length[side] = own
        ids, owner = np.zeros(length.sum(), np.uint32), np.repeat(bare, length)
        for side, (own, _) in sides:
            ids[owner if side is bare else ~owner] = own
        return ids, length

    def _of_model(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one kind, each encoded by the model as it is, and their number for each word."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sizes = ends - starts
        upto = np.cumsum(sizes)
        chars = data[np.arange(upto[-1]) + np.repeat(starts - (upto - sizes), sizes)]
        # the first word of a text needs no space before it
        wide = self.width[chars]
        wide[upto[:-1]] += 1
        place = np.cumsum(wide)
        out = np.full(place[-1], _SPACE, np.uint8)
        out[place - self.width[chars]] = self.shown[chars, 0]
        two = self.width[chars] == 2
        out[place[two] - 1] = self.shown[chars[two], 1]
        cuts = np.append(place[upto - 1][TOGETHER - 1::TOGETHER], place[-1])
        raw, texts, at = out.tobytes(), [], 0
        for cut in np.unique(cuts).tolist():
            texts.append(raw[at:cut].decode())
            at = cut
        encoded = self.model.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        return ids, self._lengths(ids, upto)

    def _lengths(self, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Number of ids for each word, from the bytes up to each word's end."""
        ends = np.cumsum(self.bytes_of[ids])
        at = np.searchsorted(ends, cuts)
        if len(ends) < len(cuts) or ends[-1] != cuts[-1] or (ends[at] != cuts).any():
            raise ValueError("the vocabulary's tokens do not split texts into their bytes")
        return np.diff(np.concatenate([[0], at + 1]))

    def _apart(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each encoded by itself, and their number for each word; ``sizes`` are the words' bytes.

        Words are put together in longer texts, where the pre-tokenizer cuts between them as before, and told apart
        by the bytes of their tokens: this costs the library less than as many short texts.
        """
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        parts = [w if w[0] == " " or w == "\n" else "\n" + w for w in words]
        # the newline before the first word of a line is a token of its own, which the word does not keep
        extra = np.fromiter((p is not w for p, w in zip(parts, words)), bool, len(parts))
        together = [parts[k:k + TOGETHER] for k in range(0, len(parts), TOGETHER)]
        encoded = self.tokenizer.encode_batch_fast(["".join(p) for p in together], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in encoded])
        length = self._lengths(ids, np.cumsum(sizes + extra))
        keep = np.ones(len(ids), bool)
        keep[(np.cumsum(length) - length)[extra]] = False
        return ids[keep], length - extra

    def encode(self, column: pa.Array | Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin. Null counts as the empty text."""
        column = column if isinstance(column, (pa.Array, pa.ChunkedArray)) else pa.array(column, pa.string())
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = [self._encode(piece.column(0)) for piece in textkit.slices(iter([batch]), "text", PIECE_BYTES)]
        ids = np.concatenate([np.zeros(0, np.uint32), *(i for i, _ in parts)])
        return ids, np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(n for _, n in parts)]))]).astype(np.int64)

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number for each text."""
        texts = textkit.texts_of(column)
        data, offsets = texts.data, texts.offsets
        if len(self.known) > REMEMBERED:
            self._forget()
        whole = _irregular(texts)
        cut = data == _SPACE
        kinds = _kinds(data)
        if self.model is not None:
            cut[1:] |= (kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0) & (data[:-1] != _APOSTROPHE)
            raw = data.tobytes()
            for special in self.special:
                for at in _places(raw, special):
                    whole[np.searchsorted(offsets, at, "right") - 1] = True
        newlines = np.flatnonzero(data == _NEWLINE)
        cut[newlines] = True
        cut[newlines[newlines + 1 < len(data)] + 1] = True
        filled = np.diff(offsets) > 0
        cut[offsets[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        owner = np.searchsorted(offsets, starts, "right") - 1
        # an empty text begins where the next one does
        kept = ~whole[owner]
        starts, ends, owner = starts[kept], ends[kept], owner[kept]
        distinct, one, back = np.unique(texts.hashes(starts, ends), return_index=True, return_inverse=True)
        checks = texts.hashes(starts[one], ends[one], second=True)
        at = np.searchsorted(self.known, distinct)
        at[at == len(self.known)] = 0
        new = np.flatnonzero(self.known[at] != distinct) if len(self.known) else np.arange(len(distinct))
        if len(new):
            self._learn(distinct[new], checks[new], *self._new(data, kinds, starts[one[new]], ends[one[new]]))
            at = np.searchsorted(self.known, distinct)
        if len(distinct) and (clash := self.check[at] != checks).any():
            whole[owner[clash[back]]] = True
            kept = ~whole[owner]
            back, owner = back[kept], owner[kept]
        length = self.length[at][back].astype(np.int64)
        upto = np.cumsum(length)
        ids = self.ids[np.arange(upto[-1] if len(upto) else 0) + np.repeat(self.start[at][back] - (upto - length), length)]
        counts = np.bincount(owner, length, len(texts)).astype(np.int64)
        if whole.any():
            apart = np.flatnonzero(whole)
            others = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([column[int(k)].as_py() or "" for k in apart], add_special_tokens=False)]
            before = np.cumsum(counts)[apart] - counts[apart]
            counts[apart] = [len(x) for x in others]
            ids = np.insert(ids, np.repeat(before, counts[apart]), np.concatenate(others))
        return ids, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file. Spark runs a task per core, so the library's own threads would only add memory."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)
