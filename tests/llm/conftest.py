import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, kinds array<string>, Found long, label double, bucket int, cell string, kept boolean"
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short item"), (None, "Only null item here"), (4, None), (5, "..."), (2, "another text of item two")]


def _words(rng, n, size=400):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(size)}é" if rng.random() < 0.2 else f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and very long texts, ties, repeated rows, near copies, junk."""
    rng = random.Random(5)
    base = " ".join(_words(rng, 120, 100_000))
    words = base.split()
    texts = [
        None, "", " \n\t ", "x", "two words", "A b C", base, base, base.upper().replace("É", "é"), " ".join([*words[:-2], "other", "end"]), " ".join(["start", *words[3:]]),
        " ".join(words[:60] + _words(rng, 60, 100_000)), "same line\n" * 30, "l1\nl2\nl3\nl1\nl2\nl3\nl4", "l1\nl2\nown", "a a a a a a\n" * 20,
        "see One TWO three,four five; six seven eight nine ten eleven twelve and short ITEM.", "only null item here", "prefix another text of item two",
        'password = "abcdefgh1234" token:short secret=token:longvalue12345 API_KEY=zzzzzzzzzz', "AKIAABCDEFGHIJKL12 AKIA123 " + "0123456789abcdef" * 3,
        "ſecret=abcdefghij TOKEN='a.b-c_d+e/f=' é api_key: 12345678", "xoxb-1234567890-abc gh ghp_" + "a" * 40 + " -----BEGIN RSA PRIVATE KEY-----",
        "mail a.b+c@x-y.example.org, c@d.e_f@g.h and @no; 10.0.0.256 1.2.3.4 1.2.3.4.5 001.002.003.004", "4111 1111 1111 1111 4111-1111-1111-1112 " + "1 " * 40,
        "+1 (988) 555-2485 +49 12 +123456789012345678 call", "<|endoftext|> tabs\tand  double  spaces \n lines\r\n",
        "\x1c sep \x85 nel 　 wide ​ zero", " ".join(_words(rng, 30_000)), "9" * 30_000, "x@" * 5_000, ("key " * 8 + "\n") * 300, "\n" * 500,
    ]
    rows = [(k, t, "en" if k % 3 else None, ["s1", "s2", None][k % 3], None if k % 4 == 0 else k) for k, t in enumerate(texts)]
    for k in range(40, 90):
        rows.append((k, " ".join(_words(rng, 150, 100_000)) + "\nshared closing line\nof two lines", "de", "s1", 1))
    return rows


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    extra = ("clash", ["x"], 1, 1.0, 1, "cell", True)
    return spark.createDataFrame([(*r, *extra) for r in edge_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def repeated(spark, edge_rows):
    """Rows that repeat: equal ones, one doc_id with two texts, null ids."""
    rows = [r for r in edge_rows if r[0] in (1, 6, 7, 13, 14, 16, 19, 40, 41)]
    rows = [*rows, *rows[1:4], (6, "another text of the same document", "en", "s1", 1), (None, rows[1][1], None, None, None), (None, None, None, None, None), (None, "free", "en", "s9", 4)]
    return spark.createDataFrame([(*r, "clash", None, None, None, None, None, None) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")
