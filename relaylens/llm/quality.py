"""Quality rules: robust multivariate outliers among document statistics, by language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.llm import textkit
from relaylens.llm.common import Scratch, fresh, map_arrow

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
AXES = ("words", "word_length", "symbols", "dup_lines", "repeats")
#: Spread that an axis gets where a cell's own is below it: without it a statistic that is constant in a group would reject every other value.
FLOORS = (0.35, 0.06, 0.03, 0.1, 0.1)
SUPPORT = 0.75
MIN_ROWS = 200
STEPS = 5
BINS = 256
#: Distances are cut at the quantile of a chi-square law that one document in this many exceeds.
ONE_IN = 1e3


def count_statistics(column: pa.Array) -> list[np.ndarray]:
    """The counts of ``COUNTS`` for each text; null counts as empty."""
    texts = textkit.texts_of(column)
    data = texts.data
    starts, ends, first = texts.words(textkit.NOT_SPACE)
    n_words = np.diff(first)
    characters = (data & 0xC0) != 0x80
    word_chars = texts.per_text(characters & textkit.NOT_SPACE[data])

    line_starts, line_ends, line_first = texts.lines()
    worded = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    owner = textkit.owners(line_first)[worded]
    keys = textkit.mix(texts.hashes(line_starts[worded], line_ends[worded]) ^ textkit.mix(owner.astype(np.uint64)))
    _, kept = np.unique(keys, return_index=True)
    lines = np.bincount(owner, minlength=len(texts))
    distinct = np.bincount(owner[kept], minlength=len(texts))

    hashes, at = textkit.windows(texts.hashes(starts, ends), first, 3)
    hashes ^= textkit.mix(textkit.owners(first)[at].astype(np.uint64))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(starts) + 1, bool)
    for k in range(3):
        cover[at[again] + k] = True
    return [n_words, word_chars, texts.per_text(SYMBOLS[data]), np.diff(line_first), lines - distinct, textkit.sums_between(cover[:-1], first)]


def with_statistics(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``name`` of the counts in each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, text):
            counts = count_statistics(batch.column(text))
            struct = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in counts], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns, struct], names=[*batch.schema.names, name])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, STATISTICS)]))


def base_failed(s: str) -> Column:
    return F.expr(f"{s}.n_words < 50 OR 100 * {s}.n_repeat_words > 50 * {s}.n_words")


def axes(s: str) -> list[Column]:
    """The transformed statistics, one per axis: lengths on a log scale, shares as angles."""
    words = F.expr(f"CAST(greatest({s}.n_words, 1) AS DOUBLE)")
    share = {
        "symbols": F.col(f"{s}.n_symbols") / F.expr(f"CAST(greatest({s}.word_chars, 1) AS DOUBLE)"),
        "dup_lines": F.col(f"{s}.n_dup_lines") / F.expr(f"CAST(greatest({s}.n_lines, 1) AS DOUBLE)"),
        "repeats": F.col(f"{s}.n_repeat_words") / words,
    }
    angles = [F.asin(F.sqrt(F.least(x, F.lit(1.0)))) for x in share.values()]
    return [F.log(words), F.log1p(F.col(f"{s}.word_chars") / words), *angles]


def noises(s: str) -> list[Column]:
    """Variance that counting alone gives each axis of a document: the angle of a share of n has 1 / 4n; repeated words come in sixes at least."""
    counted = {"word_chars": 0.25, "n_lines": 0.25, "n_words": 1.5}
    return [F.lit(0.0), F.lit(0.0), *[F.lit(c) / F.expr(f"CAST(greatest({s}.{n}, 1) AS DOUBLE)") for n, c in counted.items()]]


def cutoff(dimensions: int = len(AXES), one_in: float = ONE_IN) -> float:
    """Chi-square quantile by the Wilson-Hilferty approximation, its normal quantile by Newton's method."""
    z, tail = 3.0, 1 / one_in
    for _ in range(100):
        z -= (tail - math.erfc(z / math.sqrt(2)) / 2) / (math.exp(-z * z / 2) / math.sqrt(2 * math.pi))
    c = 2 / (9 * dimensions)
    return dimensions * (1 - c + z * math.sqrt(c)) ** 3


def _cells(stats: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) -> the cell whose estimate its documents are held against.

    Groups with under ``min_rows`` documents are pooled by language; what is too few even so is held against all documents.
    """
    own = stats.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") < min_rows
    pools = own.filter(small).groupBy("lang").agg(F.sum("n").alias("pool"))
    cell = F.when(~small, F.struct(F.lit("source").alias("level"), "lang", "source")).otherwise(
        F.when(F.col("pool") >= min_rows, F.struct(F.lit("lang").alias("level"), "lang", F.lit(None).cast("string").alias("source")))
        .otherwise(F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))
    )
    pools = pools.withColumnRenamed("lang", "pool_lang")
    joined = own.join(pools, F.col("lang").eqNullSafe(F.col("pool_lang")), "left")
    return joined.select("lang", "source", F.to_json(cell).alias("cell"))


#: ``spread`` has the variances.
_FIT = "cell string, start int, n long, log_det double, centre array<double>, inverse array<double>, spread array<double>"


def _refit(support: float, floors: tuple[float, ...]):
    d = len(floors)

    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        """One cell's next estimate, from the moments of its documents by bin of distance: at most BINS rows."""
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy()
        upto = int(np.searchsorted(np.cumsum(n), support * n.sum())) + 1
        used = bins.iloc[:upto]
        m = float(used["n"].sum())
        centre = np.stack(used["sums"].to_list()).sum(axis=0) / m
        second = np.zeros((d, d))
        second[np.triu_indices(d)] = np.stack(used["products"].to_list()).sum(axis=0) / m
        second = second + np.triu(second, 1).T
        raw = second - np.outer(centre, centre)
        # few documents can lie on a line: products are shrunk a little, so that the matrix has an inverse
        cov = raw * (m / (m + d))
        np.fill_diagonal(cov, np.maximum(np.diag(raw), np.square(floors)))
        return pd.DataFrame({
            "cell": [key[0]], "start": [key[1]], "n": [int(n.sum())], "log_det": [float(np.linalg.slogdet(cov)[1])],
            "centre": [centre.tolist()], "inverse": [np.linalg.inv(cov).ravel().tolist()], "spread": [np.diag(cov).tolist()],
        })

    return run


def _distance(x: str, d: int) -> Column:
    terms = [f"({x}[{i}] - centre[{i}]) * ({x}[{j}] - centre[{j}]) * inverse[{i * d + j}]" for i in range(d) for j in range(d)]
    return F.expr(" + ".join(terms))


def fit(stats: DataFrame, scratch: Scratch, *, support: float = SUPPORT, min_rows: int = MIN_ROWS, steps: int = STEPS,
        floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Minimum-covariance-determinant estimate of every (lang, source): centre, inverse covariance, variances.

    ``stats`` has lang, source and ``x``, the axes of every document. Concentration steps run from two starts (the
    coordinates' medians with their median deviations, and the plain moments): each step keeps the ``support`` share of
    a cell's documents nearest to the estimate and takes the moments of those; the start with the smaller
    determinant wins. A step is one aggregation over all documents into at most ``BINS`` distance bins per cell,
    so a source with a third of all rows is summed by all tasks. The subset's spread is too small for all the cell's
    documents, so each axis is widened to the median deviation from the centre, and to its floor where it is still below that.
    """
    d = len(floors)
    cells = scratch.keep(_cells(stats, min_rows), "cells")
    on = [F.col("s.lang").eqNullSafe(F.col("c.lang")), F.col("s.source").eqNullSafe(F.col("c.source"))]
    whole = F.get_json_object("cell", "$.level") == "all"
    points = stats.alias("s").join(cells.filter(~whole).alias("c"), on).select("c.cell", "s.x")
    every = cells.filter(whole).select("cell").first()
    if every is not None:
        points = points.unionByName(stats.select(F.lit(every.cell).alias("cell"), "x"))
    points = scratch.keep(points, "points")
    median = [F.percentile_approx(F.col("x")[i], 0.5, 1000).alias(f"m{i}") for i in range(d)]
    # written tables of a row per cell are small enough to be sent to the tasks, which the planner sees by their size
    middle = scratch.keep(points.groupBy("cell").agg(*median), "middle")
    spread = points.join(middle, "cell").groupBy("cell").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(d)],
        *[F.percentile_approx(F.abs(F.col("x")[i] - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i in range(d)],
    )
    plain = points.groupBy("cell").agg(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)],
    )

    def start(frame: DataFrame, number: int, factor: float) -> DataFrame:
        def weight(i: int) -> Column:
            return 1 / F.pow(F.greatest(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * factor, F.lit(floors[i])), 2)

        inverse = [weight(i) if i == j else F.lit(0.0) for i in range(d) for j in range(d)]
        return frame.select(
            "cell", F.lit(number).alias("start"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("log_det"),
            F.array(*[F.col(f"m{i}") for i in range(d)]).alias("centre"), F.array(*inverse).alias("inverse"),
        )

    estimate = scratch.keep(start(spread, 0, 1.4826).unionByName(start(plain, 1, 1.0)), "start")
    # equal steps of the logarithm: the subset's edge is exact to a few hundredths of a distance
    bin_of = F.least(F.greatest(F.floor((F.log(F.col("d2") + 1e-9) + 9) * 14), F.lit(0)), F.lit(BINS - 1)).cast("int")
    for k in range(steps):
        binned = points.join(estimate, "cell").withColumn("d2", _distance("x", d)).withColumn("bin", bin_of)
        sums = binned.groupBy("cell", "start", "bin").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.col("x")[i]).alias(f"a{i}") for i in range(d)],
            *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"b{i}_{j}") for i in range(d) for j in range(i, d)],
        ).select(
            "cell", "start", "bin", "n", F.array(*[F.col(f"a{i}") for i in range(d)]).alias("sums"),
            F.array(*[F.col(f"b{i}_{j}") for i in range(d) for j in range(i, d)]).alias("products"),
        )
        estimate = scratch.keep(sums.groupBy("cell", "start").applyInPandas(_refit(support, floors), _FIT), f"step{k}")
    best = estimate.groupBy("cell").agg(F.min_by(F.struct("n", "centre", "inverse", "spread"), F.struct("log_det", "start")).alias("b"))
    best = scratch.keep(best.select("cell", "b.*"), "best")
    deviations = points.join(best.select("cell", "centre"), "cell").groupBy("cell").agg(
        *[F.percentile_approx(F.abs(F.col("x")[i] - F.col("centre")[i]), 0.5, 1000).alias(f"s{i}") for i in range(d)]
    )
    wider = F.array(*[F.expr(f"greatest(1.4826D * s{i} / sqrt(spread[{i}]), 1D)") for i in range(d)])
    scaled = best.join(deviations, "cell").withColumn("wider", wider).select(
        "cell", "n", "centre", F.array(*[F.expr(f"inverse[{i * d + j}] / (wider[{i}] * wider[{j}])") for i in range(d) for j in range(d)]).alias("inverse"),
        F.array(*[F.expr(f"spread[{i}] * wider[{i}] * wider[{i}]") for i in range(d)]).alias("spread"),
    )
    fitted = scaled.join(cells, "cell").select("lang", "source", "cell", "n", "centre", "inverse", "spread")
    return scratch.keep(fitted, "fitted")


def judged(scored: DataFrame, s: str, fitted: DataFrame, verdict: str, *, limit: float | None = None) -> DataFrame:
    """``scored`` with a struct column called ``verdict``: base_failed, distance, kept.

    Rejected are documents that fail the base rules, and those whose squared distance exceeds ``limit``. A document's deviation
    on an axis counts by the cell's variance and its own counting noise together, so that one line in five is less than 20 in 100.
    """
    limit = cutoff(len(AXES)) if limit is None else limit
    name = fresh(scored.columns, "fit")
    small = fitted.select(F.struct("*").alias(name))
    on = F.col("lang").eqNullSafe(F.col(f"{name}.lang")) & F.col("source").eqNullSafe(F.col(f"{name}.source"))
    x, d = fresh([*scored.columns, name], "x"), len(AXES)
    off = [
        (value - F.col(f"{name}.centre")[i]) * F.sqrt(F.col(f"{name}.spread")[i] / (F.col(f"{name}.spread")[i] + noise))
        for i, (value, noise) in enumerate(zip(axes(s), noises(s)))
    ]
    terms = " + ".join(f"{x}[{i}] * {x}[{j}] * {name}.inverse[{i * d + j}]" for i in range(d) for j in range(d))
    out = scored.join(small, on, "left").withColumn(x, F.array(*off))
    failed = base_failed(s)
    distance = F.coalesce(F.expr(terms), F.lit(0.0))
    kept = ~failed & (distance <= limit)
    return out.withColumn(verdict, F.struct(failed.alias("base_failed"), distance.alias("distance"), kept.alias("kept"))).drop(x, name)


def narrow_statistics(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, lang, source and the counts ``s`` of every document, written once."""
    lean = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return scratch.keep(with_statistics(lean, "s").drop("text"), "statistics")


def _estimates(stats: DataFrame, scratch: Scratch) -> DataFrame:
    usable = stats.filter(~base_failed("s")).select("lang", "source", F.array(*axes("s")).alias("x"))
    return fit(usable, scratch)


def quality_table(docs: DataFrame) -> DataFrame:
    """Counts, base rules and verdict of every document.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance. Null text has no
    words and fails the base rules; null lang or source is a group like any other, and groups too small for an estimate of
    their own are held against their language or all documents; repeated rows are judged alike; an empty table gives an empty
    result; very long texts are read whole by one worker; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    stats = narrow_statistics(docs, scratch)
    out = judged(stats, "s", _estimates(stats, scratch), "verdict")
    return out.select(
        "doc_id", *[F.col(f"s.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "verdict.base_failed", "verdict.kept", "verdict.distance",
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_table` keeps, all columns as they are.

    The estimates come from a narrow table of statistics; the texts themselves are only scanned, never shuffled.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    fitted = _estimates(narrow_statistics(docs, scratch), scratch)
    name = fresh(docs.columns, "statistics")
    scored = with_statistics(docs.withColumn("text", F.col("text").cast("string")), name)
    verdict = fresh(scored.columns, "verdict")
    kept = judged(scored, name, fitted, verdict).filter(F.col(verdict).getField("kept"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
