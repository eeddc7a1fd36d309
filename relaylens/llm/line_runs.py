"""Line dedup: a suffix array over line ids by distributed prefix doubling; its common-prefix intervals are the repeated runs, whose later copies go."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relaylens.llm import textkit
from relaylens.llm.common import Scratch, map_arrow

#: Lines of the shortest run that is deleted.
MIN_LINES = 2
#: Words, parted by white space, of a run that is deleted even if it has fewer lines: a paragraph can be one line.
MIN_WORDS = 50
_LAST = (1 << 63) - 1


#: A line's place among all lines: by document, then by the text's hash and the row for rows that repeat a doc_id, then by number.
PLACE = ("doc", "same", "row", "pos")
#: Classes that hold at least one part in so many of a level's positions are dealt out in shares; there are at most so many of them.
HOT = 512
SHARES = 16


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): each row with a number of its own, for rows that repeat a doc_id."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def line_ids(rows: DataFrame) -> DataFrame:
    """(row, doc_id, same, n_lines, lines, checks, words): the ids of a text's lines, 128 bits in two columns, in order, and the words in each.

    ``same`` is a hash of the text. Null text has no lines, empty text one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text"):
            texts = textkit.texts_of(batch.column("text"))
            starts, ends, first = texts.lines()
            word_starts, _, _ = texts.words(textkit.NOT_SPACE)
            counts = np.searchsorted(word_starts, ends) - np.searchsorted(word_starts, starts)
            offsets = pa.array(first, pa.int32())

            def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
                return pa.ListArray.from_arrays(offsets, pa.array(values, kind))

            ids = [lists(texts.hashes(starts, ends, second=x).view(np.int64), pa.int64()) for x in (False, True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("same"), pa.array(np.diff(first), pa.int64()), *ids, lists(counts, pa.int32())],
                names=["row", "doc_id", "same", "n_lines", "lines", "checks", "words"],
            )

    hashed = rows.withColumn("same", F.hash("text"))
    return map_arrow(hashed, run, "row long, doc_id long, same int, n_lines long, lines array<long>, checks array<long>, words array<int>")


def _at(*columns: str) -> Column:
    return F.struct(*(columns or PLACE))


def _joined(rows: DataFrame, classes: DataFrame, keys: tuple[str, ...], total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of their class. Of ``total`` rows in all classes, a class with more than one in ``HOT`` is joined in shares."""
    is_hot = F.col("n") * HOT >= total
    hot = classes.filter(is_hot).select(*[F.col(k).alias(f"hot_{k}") for k in keys], F.lit(True).alias("hot"))
    on = [F.col(k) == F.col(f"hot_{k}") for k in keys]
    # at most HOT classes hold that many
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("share", F.when(F.col("hot"), F.pmod(F.xxhash64("row", "pos"), F.lit(SHARES)).cast("int")).otherwise(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    return dealt.drop("hot", *[f"hot_{k}" for k in keys]).join(classes.withColumn("share", F.explode(copies)), [*keys, "share"], how).drop("share")


@dataclass(frozen=True)
class Level:
    """Positions whose next ``width`` lines occur again: ``PLACE``, ``name`` (the rank of these lines), ``n`` (positions with that name) and the ``first`` of them."""

    width: int
    rows: DataFrame


def levels(lines: DataFrame, scratch: Scratch) -> list[Level]:
    """The suffix array by prefix doubling: for widths 1, 2, 4, ... the positions whose next ``width`` lines occur again, with their ranks.

    A position's key at twice the width is made of two ranks at the width, its own and that of the position ``width`` lines on. The keys
    that occur again are sorted over the cluster and numbered in that order, so a name is the place of its interval in the array of suffixes
    sorted by that many lines (lines are in the order of their 128-bit ids), and equal names are equal keys, not equal hashes. A position
    that is alone in its interval has its place and takes no further part, so the tables shrink; there are as many rounds as the
    logarithm of the longest repeated run.
    """
    place = [F.coalesce("doc_id", F.lit(_LAST)).alias("doc"), "same", "row"]
    every = lines.select(*place, F.posexplode(F.arrays_zip("lines", "checks")).alias("pos", "id"))
    keyed = every.select(*PLACE, F.col("id.lines").alias("a"), F.col("id.checks").alias("b"))
    out: list[Level] = []
    width = 1
    while True:
        classes = keyed.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(_at()).alias("first")).filter("n > 1")
        ordered = scratch.keep(classes, f"classes{width}").repartitionByRange("a", "b").sortWithinPartitions("a", "b")
        ranks = scratch.keep(ordered.withColumn("name", F.monotonically_increasing_id()), f"ranks{width}")
        total = ranks.agg(F.sum("n")).first()[0]
        if not total:
            return out
        rows = scratch.keep(_joined(keyed, ranks, ("a", "b"), total).select(*PLACE, "name", "n", "first"), f"level{width}")
        out.append(Level(width, rows))
        on = rows.select(F.col("row").alias("r"), (F.col("pos") - width).alias("p"), F.col("name").alias("b"))
        here = rows.select(*PLACE, F.col("name").alias("a"))
        keyed = here.join(on, (F.col("row") == F.col("r")) & (F.col("pos") == F.col("p"))).select(*PLACE, "a", "b")
        width *= 2


def _branches(level: Level, wider: Level | None) -> DataFrame:
    """(length, of, PLACE): of every interval at a width one position for each way it goes on to twice the width, the first of them."""
    rows = level.rows.select(F.lit(level.width).alias("length"), F.struct("first.row", "first.pos").alias("of"), *PLACE, "n")
    if wider is not None:
        on = wider.rows.select(F.col("row").alias("r"), F.col("pos").alias("p"), F.col("n").alias("m"), (F.col("first") == _at()).alias("leads"))
        rows = rows.join(on, (F.col("row") == F.col("r")) & (F.col("pos") == F.col("p")), "left")
        # an interval that goes on in one way only has no common prefix of its own
        rows = rows.filter(F.col("m").isNull() | (F.col("leads") & (F.col("m") < F.col("n"))))
    return rows.select("length", "of", *PLACE)


def _deeper(items: DataFrame, level: Level, scratch: Scratch) -> DataFrame:
    """``items`` after a look ``level.width`` lines further: those that go on alike form an interval of their own, whose first stays with the others."""
    on = level.rows.select(F.col("row").alias("r"), F.col("pos").alias("p"), F.col("name").alias("then"))
    step = items.join(on, (F.col("row") == F.col("r")) & (F.col("pos") + F.col("length") == F.col("p")), "left").drop("r", "p")
    step = scratch.keep(step, f"step{level.width}")
    keys = ("length", "of", "then")
    alike = step.filter("then IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(_at()).alias("first")).filter("n > 1")
    alike = scratch.keep(alike, f"alike{level.width}")
    total = alike.agg(F.sum("n")).first()[0]
    if not total:
        return items
    found = _joined(step, alike, keys, total, "left")
    stays = F.struct("length", "of")
    goes = F.struct((F.col("length") + level.width).alias("length"), F.struct("first.row", "first.pos").alias("of"))
    both = F.when(F.col("first").isNull(), F.array(stays)).when(F.col("first") == _at(), F.array(stays, goes)).otherwise(F.array(goes))
    return scratch.keep(found.select(F.explode(both).alias("i"), *PLACE).select("i.*", *PLACE), f"items{level.width}")


def copies(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, pos, length, of_row, of_pos): every position whose line stands earlier, the longest run that it shares with an earlier place, and the first such place.

    These are the intervals of the suffix array by their common prefix. At each width an interval is held by one position for each way
    it goes on to twice the width; looks half, a quarter, ... of the width further part these positions until the ones left together share
    exactly ``length`` lines. Each position is left in one interval that it is not the first of: the deepest with an earlier member.
    """
    found = levels(lines, scratch)
    items = None
    for k in reversed(range(len(found))):
        own = _branches(found[k], found[k + 1] if k + 1 < len(found) else None)
        items = own if items is None else _deeper(items, found[k], scratch).unionByName(own)
    if items is None:
        return lines.sparkSession.createDataFrame([], "row long, pos int, length int, of_row long, of_pos int")
    later = items.filter(F.col("of") != F.struct("row", "pos"))
    return scratch.keep(later.select("row", "pos", "length", F.col("of.row").alias("of_row"), F.col("of.pos").alias("of_pos")), "copies")


def _beside(every: DataFrame, min_lines: int) -> DataFrame:
    """(row, start, end): windows of ``min_lines`` lines whose longest copy overlaps them, but that also stand earlier without overlap.

    From place to earlier place a window leads to the first that holds the same lines; only texts that overlap their own copies are walked.
    """
    overlap = (F.col("row") == F.col("of_row")) & (F.col("pos") - F.col("of_pos") < min_lines)
    long = every.filter(F.col("length") >= min_lines)
    texts = long.filter(overlap).select("row").distinct()

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        root: dict[int, int | None] = {}
        row, out = int(part["row"].iloc[0]), []
        for pos, of_row, of_pos in zip(part["pos"].tolist(), part["of_row"].tolist(), part["of_pos"].tolist()):
            root[pos] = None if of_row != row else root.get(of_pos, of_pos)
            if of_row == row and pos - of_pos < min_lines and (root[pos] is None or pos - root[pos] >= min_lines):
                out.append(pos)
        return pd.DataFrame({"row": [row] * len(out), "start": out, "end": [p + min_lines for p in out]}).astype({"row": "int64", "start": "int32", "end": "int32"})

    return long.join(texts, "row").select("row", "pos", "of_row", "of_pos").groupBy("row").applyInPandas(walk, "row long, start int, end int")


def _wordy(runs: DataFrame, lines: DataFrame, min_words: int) -> DataFrame:
    """Of runs (row, start, end) those of at least ``min_words`` words."""
    words = lines.select(F.col("row").alias("r"), "words").filter(F.aggregate("words", F.lit(0), lambda a, x: a + x) >= min_words)
    total = F.aggregate(F.slice("words", F.col("start") + 1, F.col("end") - F.col("start")), F.lit(0), lambda a, x: a + x)
    return runs.join(words, F.col("row") == F.col("r")).filter(total >= min_words).select("row", "start", "end")


def deletions(rows: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """(row, doc_id, n_lines, runs): the runs of lines to delete, array of (start, end), merged and in order.

    Deleted is every line of a run of at least ``min_lines`` lines that also stands earlier, the two not overlapping. If ``min_words``
    is given, so is a shorter run of at least that many words: the longest that a position shares with an earlier place, cut where it
    overlaps that. The first document, by doc_id, then by text hash and row, keeps its run; every line keeps the first place it stands at.
    """
    lines = scratch.keep(line_ids(rows), "lines")
    cut = F.when(F.col("row") == F.col("of_row"), F.least("length", F.col("pos") - F.col("of_pos"))).otherwise(F.col("length"))
    found = copies(lines, scratch)
    every = found.select("row", F.col("pos").alias("start"), (F.col("pos") + cut).alias("end"))
    short = F.col("end") - F.col("start") < min_lines
    runs = every.filter(~short).unionByName(_beside(found, min_lines))
    if min_words is not None:
        runs = runs.unionByName(_wordy(every.filter(short), lines, min_words))
    # runs of one document that touch are one
    upto = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("new", F.coalesce(F.col("start") > upto, F.lit(True)).cast("int"))
    island = F.sum("new").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.withColumn("island", island).groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    lists = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))
    out = lines.select("row", "doc_id", "n_lines").join(lists, "row", "left")
    return out.withColumn("runs", F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")))


def line_table(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_runs, longest_run, runs (start-end of line numbers from 0, end exclusive, comma-joined) of every document.

    Null text counts as one empty line; rows that repeat a doc_id are judged each by its own text, the first by text hash and row keeps its
    lines; null ids come last; a text of any length is whole, its lines spread over tasks; an empty table gives none; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    found = deletions(scratch.keep(numbered(docs).withColumn("text", F.coalesce("text", F.lit(""))), "rows"), scratch, min_lines, min_words)
    lengths = F.transform("runs", lambda r: r["end"] - r["start"])
    return found.select(
        "doc_id", "n_lines", F.aggregate(lengths, F.lit(0), lambda a, x: a + x).cast("long").alias("n_deleted"), F.size("runs").cast("long").alias("n_runs"),
        F.coalesce(F.array_max(lengths), F.lit(0)).cast("long").alias("longest_run"),
        F.array_join(F.transform("runs", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("runs"),
    )


def without_repeats(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """(doc_id, text): every document without the later copies of repeated runs; a document that is all copy has empty text."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = scratch.keep(numbered(docs), "rows")
    found = deletions(rows, scratch, min_lines, min_words).filter("size(runs) > 0").select(F.col("row").alias("r"), "runs")
    kept = F.expr("""array_join(filter(split(text, '\n', -1), (x, i) -> NOT exists(runs, r -> i >= r.start AND i < r.end)), '\n')""")
    joined = rows.join(found, F.col("row") == F.col("r"), "left")
    return joined.select("doc_id", F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("text"))
