"""Spans of regular-expression matches as columns, without code outside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:long,end:long,hit:string>>"


#: Steps that are walked at a time: a walk copies what it has so far at every step.
STRIDE = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def walked(steps: Column, gap: Callable[[Column], Column], size: Callable[[Column], Column], item: Callable[[Column, Column, Column], Column], kind: str) -> Column:
    """``item(start, end, step)`` of every step, which lies ``gap`` behind the one before and is ``size`` long; an array of type ``kind``.

    Blocks of ``STRIDE`` steps are walked from 0 and then moved to where the blocks before them end, so that long arrays take time in proportion.
    """
    empty, zero = F.array().cast(kind), F.lit(0).cast("long")

    def block(part: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            start = a["at"] + gap(s)
            return F.struct((start + size(s)).cast("long").alias("at"), F.concat(a["out"], F.array(F.struct(start.cast("long").alias("start"), s.alias("step")))).alias("out"))

        return F.aggregate(part, F.struct(zero.alias("at"), F.slice(F.transform(part, lambda s: F.struct(zero.alias("start"), s.alias("step"))), 1, 0).alias("out")), step)

    def moved(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("seen")),
                             lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["seen"], F.array(a["at"])).alias("seen")), lambda a: a["seen"])
        return F.flatten(F.zip_with(blocks, starts, lambda b, at: F.transform(b["out"], lambda o: item((at + o["start"]).cast("long"), (at + o["start"] + size(o["step"])).cast("long"), o["step"]))))

    def all_blocks(every: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / STRIDE).cast("int"))
        return F.transform(numbers, lambda k: block(F.slice(every, k * STRIDE + 1, F.lit(STRIDE))))

    return bound(steps, lambda every: F.when(F.size(every) <= 0, empty).otherwise(bound(all_blocks(every), moved)))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, hit), in code points, end exclusive.

    The text between two matches gives the distance from one to the next.
    """
    def placed(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        steps = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"))
        spans = walked(
            steps, lambda s: F.length(s["gap"]), lambda s: F.length(s["hit"]),
            lambda start, end, s: F.struct(start.alias("start"), end.alias("end"), s["hit"].alias("hit")), SPANS,
        )
        return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(spans)

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """The spans as (start, ord, kind, end), which sort by place and then by kind as listed."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def joined(spans: Sequence[Column] | Column) -> Column:
    """kind:start:end of all tagged spans, by start and then kind, comma-joined."""
    every = spans if isinstance(spans, Column) else F.concat(*spans)
    texts = F.transform(F.array_sort(every), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def duck_quoted(text: str) -> str:
    """``text`` as a string literal of DuckDB."""
    return "'" + text.replace("'", "''") + "'"


def duck_matches(text: str, pattern: str) -> str:
    """DuckDB text for the same: list of structs start, end, hit."""
    quoted = pattern.replace("'", "''")
    return (
        f"list_transform(range(1, len(regexp_extract_all({text}, '{quoted}')) + 1), lambda i: "
        f"{{'start': list_sum(list_transform(string_split_regex({text}, '{quoted}')[:i], lambda x: len(x)))"
        f" + coalesce(list_sum(list_transform(regexp_extract_all({text}, '{quoted}')[:i - 1], lambda x: len(x))), 0),"
        f" 'hit': regexp_extract_all({text}, '{quoted}')[i]}})"
    )
