"""Connected components of a graph given as links between documents' ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from relaylens.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str, *, start: DataFrame | None = None) -> DataFrame:
    """(id, label): the smallest id reachable over ``links`` (a, b), for every id that has a link or a label in ``start``.

    Rounds of hooking and jumping: each id takes the smallest label among its own and its neighbours', and passes it to
    the id that it was labelled with before; then every label is replaced by its label's label. Paths halve in a round,
    so the number of rounds grows with the logarithm of the longest. Every round is a written table; the driver
    only learns how many labels changed, which is counted as the table is written.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    edges = scratch.keep(both.toDF("a", "b").distinct(), f"{name}-edges")
    nodes = edges.select(F.col("a").alias("id"), F.col("a").alias("label"))
    if start is not None:
        nodes = nodes.unionByName(start.select("id", "label"))
    labels = scratch.keep(nodes.groupBy("id").agg(F.min("label").alias("label")), f"{name}-0")
    turn = 0
    while True:
        turn += 1
        near = edges.join(labels, edges.a == labels.id).groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        seen = labels.join(near, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "near").alias("best"))
        # hook: the former label learns of the better one, too
        hooked = seen.select("id", "old", "best").union(seen.filter("best < old").select(F.col("old"), F.lit(None).cast("long"), F.col("best")))
        hooked = hooked.groupBy("id").agg(F.max("old").alias("old"), F.min("best").alias("best"))
        # jump: each label becomes its label's label, as far as that is known before this turn
        above = labels.select(F.col("id").alias("p"), F.col("label").alias("above"))
        jumped = hooked.join(above, hooked.best == above.p, "left").select("id", "old", F.least("best", "above").alias("label"))
        seen_changes = Observation()
        fresh = F.col("old").isNull() | (F.col("old") != F.col("label"))
        after = scratch.keep(jumped.observe(seen_changes, F.count_if(fresh).alias("n")), f"{name}-{turn}")
        changed = seen_changes.get["n"]
        scratch.drop(f"{name}-{turn - 1}")
        labels = after.select("id", "label")
        if not changed:
            return labels
