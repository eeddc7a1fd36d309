"""Parts that need no Spark: index, coder, flow, trigram queries, hashing, token allocation."""

import random
import zlib
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from relaylens.llm import near_dup, rans, textkit, token_counts, trigrams
from relaylens.llm.flow import Network
from relaylens.llm.fm_index import FMIndex, suffix_array
from relaylens.llm.mixing import plan, targets
from relaylens.llm.tokens import Encoder, default_vocabulary


def test_fm_index_equals_search():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 70))
        symbols = rng.integers(0, 4, n) * (rng.random(n) < 0.9)
        index = FMIndex(symbols, every=4)
        phrases = [list(rng.integers(1, 5, rng.integers(1, 6))) for _ in range(8)]
        table = np.zeros((8, 6), np.int64)
        for k, p in enumerate(phrases):
            table[k, :len(p)] = p
        low, high = index.search(table, np.array([len(p) for p in phrases]))
        for k, p in enumerate(phrases):
            expected = [q for q in range(n) if list(symbols[q:q + len(p)]) == p]
            assert sorted(index.locate(np.arange(low[k], max(low[k], high[k]))).tolist()) == expected


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(2)
    for _ in range(50):
        symbols = np.append(rng.integers(0, 3, 80), 0)
        zeros = {p: k for k, p in enumerate(np.flatnonzero(symbols == 0))}

        def suffix(p):
            out = []
            while symbols[p]:
                out.append((1, symbols[p]))
                p += 1
            return [*out, (0, zeros[p])]

        order = suffix_array(symbols)
        assert sorted(order.tolist()) == list(range(81))
        inner = [p for p in order if symbols[p]]
        assert inner == sorted(inner, key=suffix)


@pytest.mark.parametrize("sizes", [[], [0], [1], [255, 256, 257, 65536, 3, 0]])
def test_coder_round_trip(sizes):
    rng = np.random.default_rng(3)
    blocks = [rng.zipf(1.3, n).clip(0, 50_000).astype(np.uint32) for n in sizes]
    every = np.concatenate([*blocks, np.array([7], np.uint32)])
    ids, counts = np.unique(every, return_counts=True)
    table = rans.frequencies(ids, counts, 50_257)
    assert table.sum() == 1 << rans.SCALE and (table[ids] > 0).all()
    coder = rans.Coder(table)
    coded = coder.encode(blocks)
    decoded = coder.decode([(len(b), s, w) for b, (s, w) in zip(blocks, coded)])
    assert [b.tolist() for b in decoded] == [b.tolist() for b in blocks]


def test_coder_is_near_entropy():
    ids = np.random.default_rng(4).zipf(1.2, 60_000).clip(0, 40_000).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    (states, words), = rans.Coder(rans.frequencies(seen, counts, 50_000)).encode([ids])
    entropy = -(np.log2(counts / counts.sum()) * counts).sum() / 8
    assert entropy <= words.nbytes + states.nbytes <= entropy * 1.03 + 2200


def test_crc_of_parts():
    data = random.Random(1).randbytes(2_500_000)
    cuts = [0, 3, 3, 1_400_000, 2_500_000]
    assert rans.crc_joined([(b - a, zlib.crc32(data[a:b])) for a, b in zip(cuts, cuts[1:])]) == zlib.crc32(data)


def test_words_by_word_equal_the_library():
    encoder = Encoder(default_vocabulary())
    texts = ["", None, " ", "\n", "a  b", " a b", "a b ", "a\nb", "a \nb", "a\n\nb", "a\tb c", "don't can't 's x", "x<|endoftext|>y z", "中文 字 　x y", "é b c", "\x1c a", "a \x85 b", "12 3.4 !!"] * 2
    ids, first = encoder.encode(texts)
    for k, text in enumerate(texts):
        own = ids[first[k]:first[k + 1]].tolist()
        assert own == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert encoder.bytes_of[own].sum() == len((text or "").encode())


def test_pieces_of_words_equal_the_library():
    """Words are cut between letters, digits and signs; each distinct piece goes to the library once."""
    encoder = Encoder(default_vocabulary())
    rng = random.Random(4)
    parts = ["a", "Bz", "'", "'s", "'re", "'T", "don't", "12", ".", ",", "-", "_", " ", " ", " ", "\n", "é", "Œ", "×", "÷a", "ſ", "中", "²", "Ⅷ", "\u0301", "\x00", "\x7f", "\x1c", "\t", "\u3000", "<", "<|endoftext|>", "|>"]
    texts = ["".join(rng.choice(parts[:rng.choice([18, len(parts)])]) for _ in range(rng.randrange(20))) for _ in range(6000)]
    ids, first = encoder.encode(texts)
    for k, wanted in enumerate(encoder.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[first[k]:first[k + 1]].tolist() == wanted.ids, texts[k]
    encoder = Encoder(default_vocabulary())
    encoder.encode([" ".join(f"x{'abcdefgh'[k % 8]}{'éstuvw'[k // 8]}{sign}" for k in range(48) for sign in ("", ",", ".", ";", ")", "-"))])
    # 48 words behind a space, the first of all without one, and five signs
    assert len(encoder.known) == 54


def test_trigram_queries():
    assert trigrams.query_of("AKIA[A-Z0-9]+") == frozenset([frozenset({"aki", "kia"})])
    assert trigrams.query_of("[0-9a-f]{32,}") == trigrams.ANYTHING
    assert trigrams.query_of("(abc|xyz)+[0-9]") == frozenset([frozenset({"abc"}), frozenset({"xyz"})])
    assert trigrams.query_of("ab?cde") == frozenset([frozenset({"cde", "bcd", "abc"}), frozenset({"acd", "cde"})])
    assert trigrams.query_of("x*") == trigrams.ANYTHING
    rng = random.Random(2)
    import re

    for pattern in ("(foo|bar)baz?q", "a{2}bcd", "x(yz)?w[ab]c", "(?:one|two)three[0-9]*four"):
        query = trigrams.query_of(pattern)
        for _ in range(3000):
            text = "".join(rng.choice(["foo", "bar", "ba", "z", "q", "aa", "bcd", "x", "yz", "w", "ac", "bc", "one", "two", "three", "four", "7"]) for _ in range(5))
            if re.search(pattern, text):
                assert any(all(t in text for t in part) for part in query), (pattern, text)


def test_flow_is_cheapest():
    rng = random.Random(3)
    for _ in range(40):
        sizes, quota = [rng.randrange(4) for _ in range(3)], [rng.randrange(6) for _ in range(2)]
        members = [rng.choice([(0,), (1,), (0, 1)]) for _ in range(3)]
        network, first, second = Network(), [], []
        for k, n in enumerate(sizes):
            first.append(network.add("s", ("p", k), n, 0))
            second.append(network.add("s", ("p", k), n, 1))
            for q in members[k]:
                network.add(("p", k), ("q", q), 9)
        for q, n in enumerate(quota):
            network.add(("q", q), "t", n)
        sent = network.send("s", "t")
        cost = sum(network.flow(e) for e in second)
        best = (0, 0)
        for takes in product(*[range(2 * n + 1) for n in sizes]):
            for split in product(*[range(t + 1) for t in takes]):
                into = [0, 0]
                for k, (t, a) in enumerate(zip(takes, split)):
                    into[0] += a if 0 in members[k] else 0
                    into[1] += t - a if 1 in members[k] else 0
                    if (a and 0 not in members[k]) or (t - a and 1 not in members[k]):
                        break
                else:
                    if into[0] <= quota[0] and into[1] <= quota[1]:
                        best = max(best, (sum(takes), -sum(max(0, t - n) for t, n in zip(takes, sizes))))
        assert (sent, -cost) == best


def test_targets_and_plan():
    assert targets({"a": 100, "b": 100, None: 0}) == {"a": 200.0, "b": 100.0, None: 0.0}
    out = plan({'["a"]': 100, '["b"]': 50, '["a","b"]': 40, "[null]": 10})
    assert all(out.taken[p] <= 2 * n for p, n in {'["a"]': 100, '["b"]': 50, '["a","b"]': 40, "[null]": 10}.items())
    assert sum(v for (_, s), v in out.routed.items() if s == "b") == round(out.target["b"])
    assert plan({}).taken == {}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(6)
    shared, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate([shared, x])) for x in (a, b)]
    hashes = np.concatenate([*sets, sets[0][:1]])
    first = np.cumsum([0, len(sets[0]), len(sets[1]), 1, 0])
    out = near_dup.sketches(hashes, first)
    full = np.iinfo(np.uint64).max
    assert (out[:3] != full).all() and (out[3] == full).all()
    assert abs((out[0] == out[1]).mean() - 0.8) < 0.12


def test_hashes_of_equal_spans():
    texts = textkit.texts_of(pa.array(["ab cd", None, "", "cd ab é é"]))
    starts, ends, first = texts.words(textkit.NOT_SPACE)
    hashes = texts.hashes(starts, ends)
    assert first.tolist() == [0, 2, 2, 2, 6]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and hashes[4] == hashes[5] and len(set(hashes.tolist())) == 3


def test_token_allocation_rules():
    ends = np.array([2, 5, 6])  # tokens [0,2) [2,5) [5,6)
    low, high = np.array([0, 3]), np.array([3, 6])
    assert token_counts.allocate(ends, low, high, "start").tolist() == [2, 1]
    assert token_counts.allocate(ends, low, high, "majority").tolist() == [1, 2]
    assert np.allclose(token_counts.allocate(ends, low, high, "share"), [1 + 1 / 3, 1 + 2 / 3])
    assert token_counts.allocate(np.zeros(0, int), np.array([0]), np.array([0]), "start").tolist() == [0]
