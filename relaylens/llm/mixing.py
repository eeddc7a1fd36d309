"""Mixing sources to target weights: a minimum-cost flow from documents, grouped by the sources they belong to, to quotas."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.llm.common import Scratch, fresh, ship
from relaylens.llm.flow import Network

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # all targets together, as a fraction of all sizes
REPEATS = 2
SEED = 11
#: A membership pattern's documents are dealt to so many buckets by a seeded hash.
BUCKETS = 4096
#: Documents at least on either side of the cut through a pattern's order that are chosen one by one.
ZONE = 512
#: Exchanges of two documents at most that bring a pattern nearer to what is asked for.
SWAPS = 8


def size_of(text: str = "text") -> Column:
    """Number of words in the whole text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def in_order(sources) -> list:
    """Sources by code point, null last."""
    return sorted(sources, key=lambda s: (s is None, s or ""))


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = REPEATS) -> dict:
    """Source -> target. Weights repeat over the ordered sources; what exceeds ``most`` times a source's size is shared anew."""
    names = in_order(sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = sum(sizes.values()) * share[0] / share[1], list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not above:
            return out | {s: unit * weight[s] for s in open_}
        for s in above:
            out[s] = float(most * sizes[s])
            left -= out[s]
        left, open_ = max(left, 0.0), [s for s in open_ if s not in above]
    return out


@dataclass(frozen=True)
class Plan:
    """``taken``: pattern -> words the mix takes from its documents. ``routed``: (pattern, source) -> words for the quota."""

    target: dict
    source_size: dict
    taken: dict[str, int]
    routed: dict[tuple[str, str | None], int]


def plan(sizes: dict[str, int], **options) -> Plan:
    """Routes the words of every membership pattern (a JSON list of sources) to quotas at the least cost of repetition.

    A pattern offers its words once for nothing, a second time for 1 a word, and so on; what a source asks for is its target. The network has a
    node per pattern and source: a catalogue of sources, not documents.
    """
    most = options.get("most", REPEATS)
    members = {p: json.loads(p) for p in sizes}
    source_size: dict = {}
    for p, names in members.items():
        for s in names:
            source_size[s] = source_size.get(s, 0) + sizes[p]
    target = targets(source_size, **options)
    network, edges = Network(), {}
    for p, names in sorted(members.items()):
        for times in range(most):
            network.add("from", ("pattern", p), sizes[p], times)
        for s in names:
            edges[p, s] = network.add(("pattern", p), ("source", s), most * sizes[p])
    for s in in_order(source_size):
        network.add(("source", s), "to", round(target[s]))
    network.send("from", "to")
    routed = {key: network.flow(number) for key, number in edges.items()}
    taken = {p: sum(routed[p, s] for s in names) for p, names in members.items()}
    return Plan(target, source_size, taken, routed)


def _fill(zone: pd.DataFrame) -> pd.DataFrame:
    """Takes each document, in seeded order, that still fits into the pattern's room, then exchanges some for larger ones.

    Equal rows stand or fall together.
    """
    units = zone.groupby(["place", "doc_id"], dropna=False, sort=False).agg(size=("size", "sum"), room=("room", "first")).reset_index()
    units = units.sort_values(["place", "doc_id"], na_position="first")
    room, size = int(units["room"].iloc[0]), units["size"].to_numpy()
    taken = np.zeros(len(units), bool)
    for k, n in enumerate(size):
        if 0 < n <= room:
            room -= n
            taken[k] = True
    for _ in range(SWAPS):
        # what is left is used by a document in place of a smaller one, the best exchange first
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken & (size > 0))
        if not room or not len(inside) or not len(outside):
            break
        inside = inside[np.argsort(size[inside], kind="stable")]
        at = np.searchsorted(size[inside], size[outside] - room)
        gain = np.where(at < len(inside), size[outside] - size[inside[np.minimum(at, len(inside) - 1)]], 0)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            break
        taken[inside[at[best]]], taken[outside[best]], room = False, True, room - int(gain[best])
    picked = list(zip(units["place"][taken], units["doc_id"][taken]))
    return pd.DataFrame({
        "place": pd.Series([p for p, _ in picked], dtype="int64"),
        "doc_id": pd.Series([None if pd.isna(d) else int(d) for _, d in picked], dtype="Int64"),
    })


def with_copies(docs: DataFrame, sources: Column, name: str, *, seed: int = SEED, **options) -> tuple[DataFrame, Plan]:
    """``docs`` with struct column ``name``: pattern, size, copies (how often the mix holds the document); and the plan.

    ``sources`` is the array of sources that a document belongs to. Sizes are summed by pattern and the flow gives the words to take
    from each; all its documents are then taken as often as fits, and a seeded choice of them once more. For the
    choice, documents are put in the order of a seeded hash of id and text: whole buckets of the order up to near the cut, then,
    among the ``ZONE`` documents or more on either side of it, each that still fits. So a pattern's words come near to what the
    flow asks for and never exceed it, and no task gets more of a pattern than a few buckets. Null text has size 0 and is taken 0 times.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mix")
    place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    about = F.struct(
        F.to_json(F.array_sort(F.array_distinct(sources))).alias("pattern"), size_of().alias("size"), place.alias("place"),
        F.col("doc_id").cast("long").alias("doc_id"), F.shiftrightunsigned(place, 64 - BUCKETS.bit_length() + 1).cast("int").alias("bucket"),
    )
    rows = docs.withColumn(name, about)
    narrow = scratch.keep(rows.select(f"{name}.*"), "sizes")
    buckets = scratch.keep(narrow.groupBy("pattern", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "buckets")
    sizes = {r["pattern"]: r["size"] for r in buckets.groupBy("pattern").agg(F.sum("size").alias("size")).collect()}
    chosen = plan(sizes, **options)
    whole = {p: chosen.taken[p] // n if n else 0 for p, n in sizes.items()}
    schema = T.StructType([
        T.StructField("pattern", T.StringType()), T.StructField("times", T.IntegerType()), T.StructField("rest", T.LongType()),
    ])
    asked = spark.createDataFrame([(p, int(whole[p]), int(chosen.taken[p] - whole[p] * n)) for p, n in sizes.items()], schema)
    # a pattern has at most BUCKETS rows here
    running = "OVER (PARTITION BY pattern ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    cut = buckets.join(F.broadcast(asked), "pattern").withColumn("before", F.expr(f"coalesce(sum(size) {running}, 0L)"))
    cut = cut.withColumn("under", F.expr("before + size <= rest"))
    cut = cut.withColumn("ahead", F.expr(f"coalesce(sum(IF(under, 0L, n)) {running}, 0L)"))
    cut = cut.withColumn("behind", F.expr(f"sum(IF(under, n, 0L)) OVER (PARTITION BY pattern) - IF(under, n, 0L) - coalesce(sum(IF(under, n, 0L)) {running}, 0L)"))
    cut = cut.withColumn("zone", F.expr(f"IF(under, behind, ahead) < {ZONE}")).withColumn("full", F.expr("under AND NOT zone"))
    cut = cut.withColumn("room", F.expr("rest - sum(IF(full, size, 0L)) OVER (PARTITION BY pattern)"))
    cut = scratch.keep(cut.select("pattern", "bucket", "times", "full", "room", "zone"), "cut")
    zone = narrow.join(cut.filter("zone"), ["pattern", "bucket"]).select("pattern", "place", "doc_id", "size", "room")
    picks = scratch.keep(zone.groupBy("pattern").applyInPandas(_fill, "place long, doc_id long"), "picks")
    pick, side = fresh(rows.columns, "pick"), fresh(rows.columns, "cut")
    picks = picks.select(F.struct(F.col("place").alias("p"), F.col("doc_id").alias("d")).alias(pick))
    sides = cut.select(F.struct("pattern", "bucket", "times", "full").alias(side))
    found = rows.join(sides, (F.col(f"{name}.pattern") == F.col(f"{side}.pattern")) & (F.col(f"{name}.bucket") == F.col(f"{side}.bucket")), "left")
    found = found.join(picks, (F.col(f"{name}.place") == F.col(f"{pick}.p")) & F.col(f"{name}.doc_id").eqNullSafe(F.col(f"{pick}.d")), "left")
    once_more = F.col(f"{side}.full") | F.col(f"{pick}.p").isNotNull()
    copies = F.when(F.col(f"{name}.size") > 0, F.col(f"{side}.times") + once_more.cast("int")).otherwise(0)
    return found.withColumn(name, F.struct(f"{name}.pattern", f"{name}.size", copies.alias("copies"))).drop(side, pick), chosen


def mix_table(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document, each belonging to the one source it names.

    Null sources are a source of their own, the last; null or empty text has size 0; rows that repeat an id and a text are taken alike;
    an empty table gives an empty result; other columns are ignored.
    """
    lean = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    mixed, chosen = with_copies(lean, F.array("source"), "mix")
    known = docs.sparkSession.createDataFrame(
        [(s, n, float(chosen.target[s])) for s, n in chosen.source_size.items()], "name string, source_size long, target double"
    )
    out = mixed.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("name")), "left")
    return out.select(
        "doc_id", F.col("mix.size").alias("size"), "source_size", "target", (F.col("mix.size") * F.col("mix.copies")).cast("long").alias("taken"),
        F.col("mix.copies").alias("copies"),
    )


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, all columns as they are."""
    name = fresh(docs.columns, "mix")
    mixed, _ = with_copies(docs, F.array(F.col("source").cast("string")), name)
    again = fresh([*docs.columns, name], "copy")
    rows = mixed.filter(F.col(name).getField("copies") > 0).withColumn(again, F.explode(F.sequence(F.lit(1), F.col(name).getField("copies"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
