"""Rows of a stream handed on in closed chunks of event time, with what came before them, on Spark's keyed state.

Two stateful steps follow one another. The first is keyed by job and chunk, so that a busy job is spread over tasks: it holds a
chunk's rows until an event-time timer says that the watermark has passed its end, then emits them with a summary. The second is
keyed by job and sees the summaries only (the rows pass through under their chunk's key): it keeps the last row and the number of rows so
far, and emits both for every chunk that closes. A micro-batch then holds whole chunks and, for each, the row before it, so the values
of previous rows come from a window inside the chunk. Holding, ordering, versions, repeats and recovery are Spark's.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from relaylens.streaming.mirror import BatchWriter, reading_once

# The processors run in Python workers and travel with the plan, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROW, LAST, CARRIED, LATE = "row", "last", "carried", "late"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _position(row: Sequence[Any], order: Sequence[int]) -> tuple:
    """Sorts like the columns numbered ``order``, nulls first."""
    return tuple((row[k] is not None, row[k]) for k in order)


def _marked_names(state: T.StructType) -> list[str]:
    return ["job", "chunk", "kind", "n", *state.fieldNames()]


class Closing(StatefulProcessor):
    """Holds the rows of a job's chunk until the watermark has passed its end; late rows go on at once, marked as such.

    ``newest`` keeps only the last row by ``order``, where that is all a chunk is judged by.
    """

    def __init__(self, state: T.StructType, at: int, order: Sequence[int], width: int, newest: bool):
        self.schema, self.at, self.order, self.width, self.newest = state, at, order, width, newest
        self.names = _marked_names(state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed, row_of, held = timerValues.getCurrentWatermarkInMs() * 1000, Row(*self.names), []
        for row in rows:
            values = tuple(row)[2:]  # after job and chunk
            if values[self.at] is None or values[self.at] < passed:
                yield row_of(*key, LATE, 1, *values)
            else:
                held.append(values)
        if held:
            if self.newest:
                self.held.put([max([*self.held.get(), *held], key=lambda r: _position(r, self.order))])
            else:
                self.held.appendList(held)
            self.handle.registerTimer((key[1] + 1) * self.width // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        row_of, last, count = Row(*self.names), None, 0
        for values in self.held.get():
            yield row_of(*key, ROW, 1, *values)
            count += 1
            if last is None or _position(values, self.order) > _position(last, self.order):
                last = values
        if last is not None:
            yield row_of(*key, LAST, count, *last)
        self.held.clear()

    def close(self) -> None:
        pass


class Carrying(StatefulProcessor):
    """Per job, the last row of all closed chunks and their number of rows, emitted before each chunk that closes."""

    def __init__(self, state: T.StructType):
        self.schema = T.StructType([T.StructField("n", T.LongType()), *state.fields])
        self.names = _marked_names(state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        row_of, closed = Row(*self.names), []
        for row in rows:
            _, *values = row
            if values[2] == LAST:
                closed.append(values)
            else:
                yield row_of(*values)
        if not closed:
            return
        before = tuple(self.last.get()) if self.last.exists() else None
        # chunks close in order of time; several may in one micro-batch
        for job, chunk, _, count, *values in sorted(closed, key=lambda r: r[1]):
            if before is not None:
                yield row_of(job, chunk, CARRIED, *before)
            before = ((before[0] if before else 0) + count, *values)
        self.last.update(before)

    def close(self) -> None:
        pass


class NewestRow(StatefulProcessor):
    """Keeps the newest row of every key and hands all rows on."""

    def __init__(self, schema: T.StructType, keys: int, order: Sequence[int]):
        self.schema, self.keys, self.order = schema, keys, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best, row_of = tuple(self.newest.get()) if self.newest.exists() else None, Row(*self.schema.fieldNames())
        for row in rows:
            values = tuple(row)[self.keys:]
            if best is None or _position(values, self.order) > _position(best, self.order):
                best = values
            yield row_of(*values)
        self.newest.update(best)

    def close(self) -> None:
        pass


class ChunkedQuery(NamedTuple):
    """A running query that works on rows in order of their time; ``finish`` hands on what is held when it has stopped for good."""

    query: StreamingQuery
    finish: Callable[[], None]


class Chunks:
    """A stream's rows in chunks of ``width_seconds`` of its time column, by ``job_id``.

    ``order`` puts the rows of a job in order; ties are put in order by ``values``, which are the columns whose previous values are wanted.
    """

    def __init__(self, stream: DataFrame, *, ts: str, order: Sequence[str], values: Sequence[str], width_seconds: float, delay_seconds: float, newest: bool = False):
        self.stream, self.ts, self.order, self.values, self.newest = stream, ts, tuple(order), tuple(values), newest
        self.width, self.delay = int(width_seconds * 1e6), f"{int(delay_seconds * 1000)} milliseconds"
        self.fields = stream.schema.fields
        # times travel as microseconds, which Python workers do not convert
        self.plain = T.StructType([T.StructField(f"c{k}", T.LongType() if self._timed(f) else f.dataType) for k, f in enumerate(self.fields)])
        self.positions = [stream.columns.index(c) for c in (*self.order, *self.values)]

    @staticmethod
    def _timed(field: T.StructField) -> bool:
        return isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType))

    def _packed(self, rows: DataFrame) -> list[Column]:
        return [
            (F.unix_micros(F.col(f"`{f.name}`").cast("timestamp")) if self._timed(f) else F.col(f"`{f.name}`")).alias(f"c{k}") for k, f in enumerate(self.fields)
        ]

    def _unpacked(self, source: str = "") -> list[Column]:
        return [
            (F.timestamp_micros(F.col(f"{source}c{k}")).cast(f.dataType) if self._timed(f) else F.col(f"{source}c{k}")).alias(f.name) for k, f in enumerate(self.fields)
        ]

    def rows(self) -> DataFrame:
        """(job, chunk, kind, n, the stream's columns): closed chunks, the row before each (``n`` rows so far), and late rows."""
        marked = T.StructType([
            T.StructField("job", self.stream.schema["job_id"].dataType), T.StructField("chunk", T.LongType()), T.StructField("kind", T.StringType()),
            T.StructField("n", T.LongType()), *self.plain.fields,
        ])
        at = self.stream.columns.index(self.ts)
        timed = self.stream.withColumn("__mark", F.col(self.ts).cast("timestamp")).withWatermark("__mark", self.delay)
        # without the watermark's column late rows are not dropped but told apart below
        packed = timed.select(F.col("job_id").alias("job"), *self._packed(timed)).withColumn("chunk", F.expr(f"CAST(floor(c{at} / {self.width}) AS BIGINT)"))
        packed = packed.select("job", "chunk", *self.plain.fieldNames())
        closing = Closing(self.plain, at, self.positions, self.width, self.newest)
        closed = packed.groupBy("job", "chunk").transformWithState(closing, marked, "Append", "EventTime")
        spread = F.when(F.col("kind") == LAST, F.lit(None)).otherwise(F.col("chunk")).cast("long")
        keyed = closed.select(F.struct("job", spread.alias("chunk")).alias("key"), *marked.fieldNames())
        return keyed.groupBy("key").transformWithState(Carrying(self.plain), marked, "Append", "None")

    def start(
        self, handle: BatchWriter, rest: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, trigger: dict | None, write_late: BatchWriter | None
    ) -> ChunkedQuery:
        """``handle`` gets each micro-batch's chunks (see :meth:`stepped`); ``rest`` the rows still held at the end and each job's last row."""
        late_to = write_late or (lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{checkpoint}/order/late/batch={batch_id}"))
        place = f"{checkpoint}/offsets"

        def run(batch: DataFrame, batch_id: int) -> None:
            late = batch.filter(F.col("kind") == LATE).select(*self._unpacked())
            if not late.isEmpty():
                late_to(late, batch_id)
            handle(batch.filter(F.col("kind") != LATE).select("chunk", "kind", "n", *self._unpacked()), batch_id)

        def finish() -> None:
            spark = self.stream.sparkSession
            held, last = state(spark, place, "held"), state(spark, place, "last")
            if held is None:
                return
            held = held.select(*self._unpacked("list_element."))
            rest(held, last.select(F.col("value.n").alias("n"), *self._unpacked("value.")), last_batch(spark, place) + 1)

        return ChunkedQuery(started(self.rows(), reading_once(run), place, trigger), finish)

    def stepped(self, chunks: DataFrame) -> DataFrame:
        """The rows of whole chunks with ``prev_`` values of the row before and their number (``tick``)."""
        before = Window.partitionBy("job_id", "chunk").orderBy(F.col("kind") != CARRIED, *self.order, *self.values)
        steps = [F.lag(v).over(before).alias(f"prev_{v}") for v in self.values]
        tick = F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("tick")
        return chunks.select("*", *steps, tick).filter(F.col("kind") == ROW).drop("chunk", "kind", "n")


def started(rows: DataFrame, run: BatchWriter, place: str, trigger: dict | None) -> StreamingQuery:
    """The query over ``rows``, its state in RocksDB as keyed state needs."""
    spark = rows.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        # the query keeps the settings of its start
        writer = rows.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", place)
        return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def _operators(spark: SparkSession, place: str) -> list[Row]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/state")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return []
    return spark.read.format("state-metadata").load(place).collect()  # a row per stateful step


def last_batch(spark: SparkSession, place: str) -> int:
    return max(r.maxBatchId for r in _operators(spark, place))


def state(spark: SparkSession, place: str, variable: str, batch_id: int | None = None) -> DataFrame | None:
    """A state variable of a query as Spark's state source reads it, after a batch or the last one; none before the first."""
    found = [r for r in _operators(spark, place) if f'"stateName":"{variable}"' in r.operatorProperties]
    if not found:
        return None
    reader = spark.read.format("statestore").option("operatorId", found[0].operatorId).option("stateVarName", variable)
    return (reader if batch_id is None else reader.option("batchId", batch_id)).load(place)
