"""Small helpers shared by the operators."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_partitions, materialize, scratch_root

__all__ = ["default_partitions", "materialize", "scratch_root", "scratch_path", "table", "strings", "bounded_batches", "pieces", "giving_back", "input_partitions", "kept_in_worker", "free_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def strings(df: DataFrame, column: str):
    """The column as text; a binary or other typed column is cast."""
    kind = df.schema[column].dataType
    return F.col(column) if isinstance(kind, T.StringType) else F.col(column).cast("string")


#: Rows and bytes of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch limits to BATCH_ROWS and BATCH_BYTES where they are
    unset: the default of 10,000 texts a batch may hold hundreds of MB."""
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, str(value))


def pieces(batch: pa.RecordBatch, text: str, limit: int = 2_000_000):
    """Slices of the batch whose texts have about ``limit`` bytes, or one row."""
    upto = np.cumsum([0, *(pc.binary_length(batch.column(text)).fill_null(0).to_pylist())])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def giving_back(run):
    """The batch function, after which the task's freed memory goes back to the system:
    Python workers stay for later tasks and stages."""
    def around(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # where the C library has it
        if trim:
            trim(0)
    return around


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores after it while the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def kept_in_worker(kind: str, key, make):
    """``make()``, kept by the Python worker process for later tasks with the same key; one
    object per kind is kept. (Functions come to workers by value, and with them new module variables.)"""
    box = sys.modules.setdefault("_kept_in_worker", types.ModuleType("_kept_in_worker")).__dict__
    if kind not in box or box[kind][0] != key:
        box[kind] = None, None      # the one before goes first
        box[kind] = key, make()
    return box[kind][1]


def input_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle whose volume follows the input: at least the
    session's setting, at least one per input split."""
    return max(default_partitions(df.sparkSession), df.rdd.getNumPartitions())
