"""Log folders, report files, and date-partitioned tables with retention."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylens.functions.dated import DAY, day_of
from relaylens.operators.maintenance import retention_days
from relaylens.session import checkpoint_root


def read_log_lines(spark: SparkSession, path: str, *, streaming: bool = False) -> DataFrame:
    """Lines of all log files under ``path`` (a folder or a glob), in a ``line`` column."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).withColumnRenamed("value", "line")


def write_report(rows: DataFrame, path: str) -> None:
    """Report rows as CSV; the part files follow the order of the rows."""
    rows.orderBy("section", F.col("at").desc(), F.col("row_id").desc()).select("c1", "c2", "c3").write.mode("overwrite").csv(path)


class DatedTable:
    """A Parquet table partitioned by the day of its time column: appended to, read, and pruned by whole days."""

    def __init__(self, spark: SparkSession, name: str, ts: str = "ts"):
        self.spark, self.name, self.ts = spark, name, ts

    def append(self, rows: DataFrame) -> None:
        dated = rows.withColumn("event_date", F.to_date(self.ts))
        # Rows of a day go to several writers: days are uneven, and AQE splits or merges the partitions.
        dated.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").format("parquet").saveAsTable(self.name)

    def read(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """The rows, or those from ``start`` to ``end`` (both included); only the folders of those days are read."""
        table = self.spark.table(self.name)
        # the day column is marked, so that operators over these rows prune by it too
        rows = table.select(*[day_of(self.ts) if c == DAY else F.col(f"`{c}`") for c in table.columns])
        kind = rows.schema[self.ts].dataType
        if start is not None:
            rows = rows.filter((F.col("event_date") >= F.lit(start.date())) & (F.col(self.ts) >= F.lit(start).cast(kind)))
        if end is not None:
            rows = rows.filter((F.col("event_date") <= F.lit(end.date())) & (F.col(self.ts) <= F.lit(end).cast(kind)))
        return rows

    def days(self) -> list[date]:
        """The days that have rows; rows without a time are in none of them."""
        values = [r[0].split("=")[1] for r in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()]
        return sorted(date.fromisoformat(v) for v in values if v != "__HIVE_DEFAULT_PARTITION__")

    def prune(self, *, as_of: datetime, days: int, stage: str | None = None) -> None:
        """Drop days before the cutoff, and rewrite the day the cutoff falls into. Rows without a time stay.

        The rewritten day passes through ``stage``, a folder that all executors share (by default one below
        ``spark.checkpoint.dir``), which is removed afterwards.
        """
        cutoff = as_of - timedelta(days=retention_days(days))
        there = self.days()
        self._drop([day for day in there if day < cutoff.date()])
        if cutoff.date() not in there:
            return
        edge = self.read().filter(F.col("event_date") == F.lit(cutoff.date()))
        kept = edge.filter(F.col(self.ts) >= F.lit(cutoff).cast(edge.schema[self.ts].dataType))
        # The rows are read from the table that is overwritten, so they go through a staged copy first.
        root = stage or checkpoint_root(self.spark)
        if root is None:
            raise ValueError("pass a stage folder or set spark.checkpoint.dir")
        staged = f"{root}/staged-{uuid.uuid4().hex}"
        kept.write.parquet(staged)
        survivors = self.spark.read.schema(kept.schema).parquet(staged)
        if survivors.isEmpty():
            self._drop([cutoff.date()])
        else:
            survivors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(self.name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _drop(self, days: list[date]) -> None:
        if days:
            parts = ", ".join(f"PARTITION (event_date = DATE'{day.isoformat()}')" for day in days)
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS {parts}")
