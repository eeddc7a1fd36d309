"""Running totals and previous-row values along a key's timeline.

A plain ``Window.partitionBy(key).orderBy(...)`` sends a whole key to one task, which fails to scale
when a single job or topic owns a large share of the rows. Here the timeline of a key is cut into
chunks (an hour, a block of offsets): one aggregation summarises each chunk, a window over the
summaries carries totals and last rows from chunk to chunk, and the row-level window is partitioned
by (key, chunk). The result equals that of the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

_KEY, _CHUNK, _SPAN = "__key", "__chunk", "__span"
SPAN = 512  # chunks
_FIRST = -(1 << 63)  # chunk of rows without a position: nulls sort first


def hour_of(ts: str) -> Column:
    """Chunk of a timestamp column: its hour since the epoch (any timestamp type)."""
    return F.expr(f"unix_micros(CAST({ts} AS TIMESTAMP)) DIV 3600000000")


def minute_of(ts: str) -> Column:
    """Chunk of a timestamp column: its minute since the epoch (any timestamp type)."""
    return F.expr(f"unix_micros(CAST({ts} AS TIMESTAMP)) DIV 60000000")


def fitted_chunk(df: DataFrame, keys: Sequence[str], ts: str, *, max_rows: int = 1 << 22) -> Column:
    """Like :func:`minute_of`, but finer when some key has more than ``max_rows`` rows in a minute.

    Counts the rows per key and minute (combined before the shuffle) to choose the width.
    """
    counts = df.groupBy(*keys, minute_of(ts).alias("__minute")).agg(F.count(F.lit(1)).alias("__n"))
    densest = counts.agg(F.max("__n")).first()[0] or 0
    width = max(1, 60_000_000 // max(1, -(-densest // max_rows)))
    return F.expr(f"unix_micros(CAST({ts} AS TIMESTAMP)) DIV {width}")


def block_of(position: str, rows: int = 1 << 18) -> Column:
    """Chunk of a dense integer position (an offset, a row id): blocks of ``rows`` positions."""
    return F.expr(f"CAST({position} AS BIGINT) DIV {int(rows)}")


def along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    *,
    running: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    whole: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` inside each ``keys`` group.

    ``running``: name -> expression, summed from the key's first row up to this row.
    ``previous``: name -> expression, its value on the row just before (null on the first row).
    ``whole``: name -> expression, summed over all rows of the key.
    ``chunk`` must never decrease along ``order``. Rows that tie in ``order`` are put in order by the values that are summed or
    handed on, then by a hash of the row, so a result does not depend on how rows lie in files.

    Rows are dealt out once, by key and chunk; their sums and last values, and the windows inside the chunks, are taken from that one
    shuffle. Chunks are summed up once more in spans of ``SPAN`` chunks, so the chunks of a span meet in a task, and the spans of a
    key: a busy key's rows are never together. Blocks of offsets are bounded by their size, hours by how densely a job is
    sampled. For a series with millions of rows an hour pass a finer chunk.
    """
    running, previous, whole = dict(running or {}), dict(previous or {}), dict(whole or {})
    # The keys travel as one struct: unlike plain columns, structs with null fields compare as equal, and the
    # join and the row-level window share one shuffle. The chunk comes first because a number sorts fastest.
    rows = df.withColumns({_KEY: F.struct(*keys), _CHUNK: F.coalesce(chunk, F.lit(_FIRST))}).repartition(_CHUNK, _KEY)
    # The hash makes the summaries need every column, as the rows do, so that both read the same shuffle.
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, MapType)])
    ties = [*previous.values(), *running.values(), hashed]
    in_chunk = Window.partitionBy(_CHUNK, _KEY).orderBy(*order, *ties)
    up_to_row = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    position = F.struct(*order, *[e.alias(f"__tie{k}") for k, e in enumerate(ties)])
    sums = [F.sum(e).alias(f"__sum_{n}") for n, e in {**running, **whole}.items()]
    lasts = [F.max_by(F.struct(*[e.alias(n) for n, e in previous.items()]), position).alias("__last")] if previous else []
    chunks = rows.groupBy(_CHUNK, _KEY).agg(*sums, *lasts, F.bit_xor(hashed).alias("__hash")).filter("__hash IS NOT NULL")
    chunks = chunks.select(
        _CHUNK, _KEY, *[f"__sum_{n}" for n in {**running, **whole}], *[F.col(f"__last.{n}").alias(f"__last_{n}") for n in previous],
        # never null, or the planner would add a filter on one side and read the input twice
        F.coalesce(F.expr(f"{_CHUNK} DIV {SPAN}"), F.lit(0)).alias(_SPAN),
    ).repartition(_KEY, _SPAN)
    spans = chunks.groupBy(_KEY, _SPAN).agg(
        *[F.sum(f"__sum_{n}").alias(f"__sum_{n}") for n in (*running, *whole)],
        *[F.max_by(f"__last_{n}", _CHUNK).alias(f"__last_{n}") for n in previous],
    )
    by_span = Window.partitionBy(_KEY).orderBy(_SPAN)
    spans = spans.select(
        _KEY, _SPAN,
        *[F.coalesce(F.sum(f"__sum_{n}").over(by_span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"__earlier_{n}") for n in running],
        *[F.sum(f"__sum_{n}").over(Window.partitionBy(_KEY)).alias(f"__whole_{n}") for n in whole],
        *[F.lag(f"__last_{n}").over(by_span).alias(f"__former_{n}") for n in previous],
    )
    by_chunk = Window.partitionBy(_KEY, _SPAN).orderBy(_CHUNK)
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    first_in_span = F.row_number().over(by_chunk) == 1
    carried = chunks.join(spans, [_KEY, _SPAN]).select(
        _KEY, _CHUNK,
        *[(F.col(f"__earlier_{n}") + F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0))).alias(f"__before_{n}") for n in running],
        *[F.col(f"__whole_{n}") for n in whole],
        *[F.when(first_in_span, F.col(f"__former_{n}")).otherwise(F.lag(f"__last_{n}").over(by_chunk)).alias(f"__carry_{n}") for n in previous],
    )
    joined = rows.join(carried, [_CHUNK, _KEY])
    first_in_chunk = F.row_number().over(in_chunk) == 1
    return joined.select(
        *df.columns,
        *[
            (F.col(f"__before_{n}") + F.coalesce(F.sum(e).over(up_to_row), F.lit(0))).alias(n)
            for n, e in running.items()
        ],
        *[
            F.when(first_in_chunk, F.col(f"__carry_{n}")).otherwise(F.lag(e).over(in_chunk)).alias(n)
            for n, e in previous.items()
        ],
        *[F.col(f"__whole_{n}").alias(n) for n in whole],
    )
