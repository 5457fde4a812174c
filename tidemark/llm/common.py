"""What the operators share: reading tables, the shared folder, and tables written to cut lineage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir

#: ASCII white space; the same bytes that bytes.split() splits at.
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: Arrow batches of at most so many rows, so that a batch is small both in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives freed memory back to the system at its end, as workers stay and wait for more tasks."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)

    return outer


def lower_ascii(c):
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(c, UPPER, UPPER.lower())


#: Paths of the tables written and not dropped yet, oldest first.
MADE: list[str] = []


def written(df: DataFrame, label: str, slim: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost nothing twice.

    slim: its rows are few and small next to the input, so that a file for each 16 shuffle partitions is enough.
    The table stays until drop() or sweep() takes it away, as what is planned over it may run later.
    """
    spark = df.sparkSession
    if slim:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MADE.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder below shared_dir() that is no longer read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in MADE:
        MADE.remove(path)


def drop(table: DataFrame) -> None:
    """Removes a table that written() made and nothing will read again."""
    drop_path(table.sparkSession, table._written_at)


def sweep(spark: SparkSession, since: list[str], keep: DataFrame) -> None:
    """Removes the tables made since a copy of MADE was taken, but `keep`; for the end of a step whose result is written."""
    for path in [p for p in MADE if p not in since and p != keep._written_at]:
        drop_path(spark, path)


def write_bytes(spark: SparkSession, path: str, raw: bytes) -> None:
    """A file in the shared folder, whatever store that is; one that is there already with this name is kept."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(raw)
        out.close()
        fs.rename(part, p)
