"""Totals that follow samples by a step function, composed in a tree.

A total t and a sample x give x where x >= t, else t + x. Over any stretch of samples that is a function of the incoming total: a few
constant steps, then ``t + added``. Two such functions compose to one of the same kind, whatever the grouping, and a new step needs a
sample above twice the sum before it, so a stretch has at most 63 steps however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = "array<struct<limit: bigint, result: bigint>>"
FUNCTION = f"struct<steps: {STEPS}, added: bigint>"


def _function(steps: Column, added: Column) -> Column:
    return F.struct(steps.alias("steps"), added.alias("added"))


def nothing() -> Column:
    """The function of no samples."""
    return _function(F.array().cast(STEPS), F.lit(0).cast("long"))


def _step(limit: Column, result: Column) -> Column:
    return F.struct(limit.alias("limit"), result.alias("result"))


def _last_limit(f: Column) -> Column:
    return F.coalesce(F.try_element_at(f["steps"], F.lit(-1))["limit"], F.lit(-1).cast("long"))


def applied(f: Column, total: Column) -> Column:
    """The total after the stretch."""
    return F.coalesce(F.try_element_at(F.filter(f["steps"], lambda s: total <= s["limit"]), F.lit(1))["result"], total + f["added"])


def after_sample(f: Column, x: Column) -> Column:
    """The function of a stretch and one more sample."""
    raised = F.transform(f["steps"], lambda s: _step(s["limit"], F.when(x >= s["result"], x).otherwise(s["result"] + x)))
    reach = x - f["added"]
    more = F.when(reach > _last_limit(f), F.array(_step(reach, x))).otherwise(F.array().cast(STEPS))
    return _function(F.concat(raised, more), f["added"] + x)


def composed(f: Column, g: Column) -> Column:
    """The function of a stretch ``f`` followed by a stretch ``g``."""
    first = F.transform(f["steps"], lambda s: _step(s["limit"], applied(g, s["result"])))
    moved = F.transform(g["steps"], lambda s: _step(s["limit"] - f["added"], s["result"]))
    return _function(F.concat(first, F.filter(moved, lambda s: s["limit"] > _last_limit(f))), f["added"] + g["added"])


def of_samples(samples: Column) -> Column:
    """The function of an array of samples in order."""
    return F.aggregate(samples, nothing(), after_sample)


def of_functions(functions: Column) -> Column:
    """The function of an array of functions in order."""
    return F.aggregate(functions, nothing(), composed)


def starts(functions: Column, total: Column) -> Column:
    """The totals before each of the functions, the first of which gets ``total``."""
    begin = F.struct(total.alias("total"), F.array().cast("array<bigint>").alias("seen"))
    return F.aggregate(
        functions, begin, lambda a, f: F.struct(applied(f, a["total"]).alias("total"), F.concat(a["seen"], F.array(a["total"])).alias("seen")), lambda a: a["seen"]
    )


def deltas(samples: Column, total: Column) -> Column:
    """What each sample adds to the total before it."""
    begin = F.struct(total.alias("total"), F.array().cast("array<bigint>").alias("seen"))

    def add(a: Column, x: Column) -> Column:
        d = F.when(x >= a["total"], x - a["total"]).otherwise(x)
        return F.struct((a["total"] + d).alias("total"), F.concat(a["seen"], F.array(d)).alias("seen"))

    return F.aggregate(samples, begin, add, lambda a: a["seen"])
