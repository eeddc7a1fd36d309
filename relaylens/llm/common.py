"""What the operators of this subpackage share: reading tables, written intermediate tables, fresh column names."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.session import checkpoint_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="relaylens-"), "relaylens_package")
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped.add(context.applicationId)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    ship(df.sparkSession)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        # the worker process stays for later tasks
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(released, schema)


class Scratch:
    """Tables written to the cluster's shared checkpoint folder, so that an executor's loss costs no recomputation.

    Each object has a folder of its own below ``spark.checkpoint.dir``.
    """

    def __init__(self, spark: SparkSession, label: str):
        root = checkpoint_root(spark)
        if not root:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.spark = spark
        self.path = f"{root.rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"

    def place(self, name: str) -> str:
        return f"{self.path}/{name}"

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """``df`` written once; the returned frame reads it back."""
        df.write.option("compression", codec).parquet(self.place(name))
        return self.spark.read.schema(df.schema).parquet(self.place(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no frame still in use reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.place(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unpacked(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The fields of struct column ``row`` as columns."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def text_of(column: str = "text") -> Column:
    """The text column as a string, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
