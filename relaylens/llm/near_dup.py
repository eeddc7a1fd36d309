"""MinHash near-dedup: fast similarity sketching, banding, and verification on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylens.llm import textkit
from relaylens.llm.common import Scratch, map_arrow, unpacked
from relaylens.llm.components import components

SHINGLE = 3
NUMERATOR, DENOMINATOR = 85, 100
#: A pair at the threshold shares no band with probability (1 - 0.85 ** 5) ** 25 = 4e-7.
BANDS, ROWS = 25, 5
BINS = BANDS * ROWS
#: Pairs are dropped unverified when fewer coordinates than this agree: 2e-7 of the pairs at the threshold do so.
AGREE = 81
#: Turns in which every bucket compares one more centre with its members, before the rest goes to the prefix join.
TURNS = 2
_SALTS = textkit.mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after the other, and where each text's begin.

    A text with words but fewer than ``width`` has its whole word sequence as its one shingle.
    """
    texts = textkit.texts_of(column).lowered()
    starts, ends, first = texts.words(textkit.NOT_SPACE)
    words = texts.hashes(starts, ends)
    hashes, at = textkit.windows(words, first, width)
    owner = textkit.owners(first)[at]
    for k in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < width)):
        whole = np.uint64(len(words[first[k]:first[k + 1]]))
        for word in words[first[k]:first[k + 1]]:
            whole = textkit.mix(np.array([whole * np.uint64(3) ^ word]))[0]
        hashes, owner = np.append(hashes, whole), np.append(owner, k)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def sketches(hashes: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches of sets, one row of ``bins`` coordinates each.

    In round i < ``bins`` every element of a set falls into a hashed bin with a hashed value above all those of earlier
    rounds, and each bin keeps its smallest; a set whose bins are all filled is done. Round ``bins`` + j places every
    element in bin j, so that every coordinate of a non-empty set gets a value. Two sets agree in a coordinate with
    the probability of their similarity, and the share of agreeing coordinates is concentrated about it.
    """
    count = len(first) - 1
    out = np.full((count, bins), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    active = np.flatnonzero(np.diff(first))
    for turn in range(2 * bins):
        if not len(active):
            break
        lengths = first[active + 1] - first[active]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(first[active] - (ends - lengths), lengths)
        mixed = textkit.mix(hashes[at] ^ _SALTS[turn])
        value = np.uint64(turn) << np.uint64(40) | (mixed & np.uint64(0xFFFFFFFF)) << np.uint64(8)
        place = ((mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(flat, np.repeat(active * bins, lengths) + place, value)
        active = active[(out[active] == np.iinfo(np.uint64).max).any(axis=1)]
    return out


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    raw = hashes.tobytes()
    return [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]


def _lean(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("mark"))


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, fingerprint, n_shingles, keys, sketch) of every document; ``sketch`` keeps 16 bits of each coordinate, ``mark`` tells the texts of a doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text"):
            hashes, first = shingle_sets(batch.column("text"))
            signature = sketches(hashes, first)
            bands = textkit.mix(signature).reshape(-1, BANDS, ROWS)
            keys = np.broadcast_to(textkit.mix(np.arange(BANDS, dtype=np.uint64)), bands.shape[:2])
            for k in range(ROWS):
                keys = textkit.mix(keys * np.uint64(0x9DDFEA08EB382D69) + bands[:, :, k])
            short = textkit.mix(signature).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("mark"), pa.array(_fingerprints(hashes, first), pa.binary()), pa.array(np.diff(first), pa.int64()),
                pa.FixedSizeListArray.from_arrays(pa.array(keys.astype(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())),
                pa.array([row.tobytes() for row in short], pa.binary()),
            ], names=["doc_id", "mark", "fingerprint", "n_shingles", "keys", "sketch"])

    return map_arrow(_lean(docs), run, "doc_id long, mark long, fingerprint binary, n_shingles long, keys array<long>, sketch binary")


def full_sets(texts: DataFrame) -> DataFrame:
    """(id, shingles): the full set of every text of ``texts`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.slices(batches, "text"):
            hashes, first = shingle_sets(batch.column("text"))
            sets = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), sets], names=["id", "shingles"])

    return map_arrow(texts, run, "id long, shingles array<long>")


def _alike(pairs: DataFrame, sketch: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches agree in at least ``AGREE`` coordinates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BINS) for c in ("s", "t"))
            yield batch.select(["a", "b"]).filter(pa.array((left == right).sum(axis=1) >= AGREE))

    left = sketch.select(F.col("id").alias("a"), F.col("sketch").alias("s"))
    right = sketch.select(F.col("id").alias("b"), F.col("sketch").alias("t"))
    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "s", "t"), run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    shared = pairs.join(right, "b").join(left, "a").select(
        "a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("n")
    )
    return shared.filter(F.expr(f"{DENOMINATOR} * i >= {NUMERATOR} * (n - i)")).select("a", "b")


def _centre_pairs(members: DataFrame, weight: DataFrame, turn: int) -> DataFrame:
    """(a, b): in every bucket, its centre and each other member.

    Centres are the members found in the most and largest buckets: the text that a group of copies was made from
    agrees with more of them than they do with each other. Turn k takes the member k places behind.
    """
    ranked = members.join(weight, "id").select("bucket", "id", F.struct(-F.col("weight"), F.col("id")).alias("order"))
    best = ranked.groupBy("bucket").agg(F.min("order").alias("o"))
    for _ in range(turn):
        later = ranked.join(best, "bucket").filter(F.col("order") > F.col("o"))
        best = later.groupBy("bucket").agg(F.min("order").alias("o"))
    centres = best.select("bucket", F.col("o.id").alias("centre"))
    pairs = members.join(centres, "bucket").filter(F.col("id") != F.col("centre"))
    return pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()


def _prefix_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): every pair of ``rest`` (id, label) with different labels that can be similar enough, found exactly.

    Two sets that overlap enough share a shingle among the rarest n - ceil(0.85 n) + 1 of each. Shingles of one document
    only count for a set's prefix but are never joined.
    """
    shingles = rest.join(sets, "id").select("id", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    often = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    common = shingles.join(often, "shingle").select("id", "label", "n", F.struct("df", "shingle").alias("s"))
    ordered = common.groupBy("id", "label", "n").agg(F.array_sort(F.collect_list("s")).alias("s"))
    # the n - size(s) shingles of this document alone come first
    reach = F.expr(f"greatest(n - ((n * {NUMERATOR} + {DENOMINATOR - 1}) DIV {DENOMINATOR}) + 1 - (n - size(s)), 0)").cast("int")
    prefix = ordered.select("id", "label", "n", (F.col("n") - F.size("s")).alias("alone"), F.posexplode(F.slice("s", F.lit(1), reach)).alias("at", "s"))
    # shingles from this one on, in the common order: no more than these are shared where this is the first shared one
    prefix = prefix.select("id", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), "s.shingle")
    other = prefix.select(F.col("id").alias("b"), F.col("label").alias("m"), F.col("n").alias("k"), F.col("left").alias("right"), F.col("shingle").alias("same"))
    fits = F.expr(f"{DENOMINATOR + NUMERATOR} * least(left, right) >= {NUMERATOR} * (n + k)")
    sizes = F.expr(f"{DENOMINATOR} * least(n, k) >= {NUMERATOR} * greatest(n, k)")
    pairs = prefix.join(other, (F.col("shingle") == F.col("same")) & F.expr("id < b AND label <> m") & sizes & fits)
    return pairs.select(F.col("id").alias("a"), "b").distinct()


def _across(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between labels that are not the same yet."""
    first = labels.select(F.col("id").alias("a"), F.col("label").alias("x"))
    second = labels.select(F.col("id").alias("b"), F.col("label").alias("y"))
    return links.join(first, "a").join(second, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents with equal sets are one class, represented by its smallest doc_id. Representatives that share a band meet
    in a bucket; there each is compared with the bucket's centre, by sketch and then on full sets, and confirmed links
    join components. Buckets whose members are not yet of one component go on with the next centre, and after
    ``TURNS`` turns with an exact prefix join, so no bucket emits all pairs of its members and none is capped. (The prefix join
    does meet every pair that shares a rare shingle and fits in size: texts of one template that are not similar enough.)

    Null or empty text: empty set, linked with nothing, kept. Rows that repeat a doc_id are judged each by its own text, and each
    text links on. Rows without a doc_id link texts like others; their component_id is the smallest doc_id of their
    component, or null where it has none (they are kept then). Very long texts are read whole by one worker. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    scan = scratch.keep(sketched(docs), "scan")
    filled = scan.filter("n_shingles > 0")
    # a class is known by its smallest doc_id and, as that may have several texts, by the mark of its text
    of_text = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark"))
    classes = filled.groupBy("fingerprint").agg(of_text.alias("one"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    classes = scratch.keep(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = classes.select("id", F.explode("keys").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = scratch.keep(rows.join(shared, "bucket").select("bucket", "id", "n"), "members")
    weight = scratch.keep(members.groupBy("id").agg(F.sum("n").alias("weight")), "weight")
    wanted = classes.join(weight.select("id"), "id").select("id", F.col("one.doc_id").alias("wanted"), F.col("one.mark").alias("mark"))
    needed = _lean(docs).join(wanted, ["mark"]).filter(F.col("doc_id").eqNullSafe(F.col("wanted")))
    # rows may repeat
    sets = scratch.keep(full_sets(needed.groupBy("id").agg(F.min("text").alias("text"))), "sets")
    sketch = classes.join(weight, "id", "left_semi").groupBy("id").agg(F.first("sketch").alias("sketch"))
    labels = weight.select("id", F.col("id").alias("label"))
    open_members = members.select("bucket", "id")
    for turn in range(TURNS + 1):
        if turn < TURNS:
            candidates = _centre_pairs(open_members, weight, turn)
        else:
            rest = open_members.select("id").distinct().join(labels, "id")
            candidates = _prefix_pairs(rest, sets)
        alike = scratch.keep(_alike(candidates, sketch), f"alike{turn}")
        found = _confirmed(alike, sets)
        if turn:
            found = _across(found, labels)
        found = scratch.keep(found, f"links{turn}")
        if not found.isEmpty():
            # links between labels so far; only these are put together anew
            joined = components(found, scratch, f"labels{turn}").select(F.col("id").alias("label"), F.col("label").alias("lower"))
            labels = scratch.keep(labels.join(joined, "label", "left").select("id", F.coalesce("lower", "label").alias("label")), f"all{turn}")
        if turn < TURNS:
            split = open_members.join(labels, "id").groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"))
            left = split.filter("low <> high").select("bucket")
            open_members = scratch.keep(open_members.join(left, "bucket", "left_semi"), f"open{turn}")
            if open_members.isEmpty():
                break
    of_class = classes.select("fingerprint", "id", F.col("one.doc_id").alias("doc_id")).join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    lowest = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_class = of_class.select("fingerprint", "label").join(lowest, "label").select("fingerprint", "component_id")
    out = scan.select("doc_id", "n_shingles", "fingerprint").join(of_class, "fingerprint", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document :func:`near_duplicates` keeps, all columns as they are, one row per doc_id.

    Of rows that repeat a kept doc_id the one with the smallest text stays. Rows without a doc_id cannot be told apart and stay.
    """
    kind = docs.schema["doc_id"].dataType
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").cast(kind)).distinct()
    # the join has dealt and sorted the rows by doc_id, which the aggregation goes on with
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.col("text").cast("string"), F.lit("")))
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(row.alias("row"))
    return unpacked(one, docs.columns).unionByName(docs.filter("doc_id IS NULL"))
