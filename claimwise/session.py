"""Session construction and lineage cutting.

Everything else in the package takes an existing ``SparkSession``; this module
only builds one for tests/bench and owns the single place where intermediate
results are materialised (``materialize``), so iterative jobs survive lost
executors without recomputing long lineages.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[int, str] = {}


def build_session(master: str | None = None, app: str = "claimwise",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session tuned for this workload; on a cluster pass ``master=None`` and
    let spark-submit decide. UI stays off (no server)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if os.environ.get("CLAIMWISE_DRIVER_MEMORY"):
        conf["spark.driver.memory"] = os.environ["CLAIMWISE_DRIVER_MEMORY"]
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster (``spark.checkpoint.dir``).

    Only a local-mode session without one gets a private temp folder (tests);
    on a cluster a missing setting is an error rather than a silent
    machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running claimwise jobs")
    key = id(sc)
    if key not in _LOCAL_DIRS:
        _LOCAL_DIRS[key] = tempfile.mkdtemp(prefix="claimwise-ckpt-", dir="/tmp")
    sc.setCheckpointDir(_LOCAL_DIRS[key])
    return sc.getCheckpointDir() or _LOCAL_DIRS[key]


def scratch_root(spark: SparkSession) -> str:
    """Folder for this application's intermediates: one per application under
    the shared checkpoint folder, so a finished run is removed with one delete
    (or by the folder's retention policy)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/claimwise-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str = "stage", **options) -> tuple[DataFrame, str]:
    """``df`` written once as Parquet under the checkpoint folder and read back, and the folder. ``options`` of the writer."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").options(**options).parquet(path)
    return spark.read.parquet(path), path


#: Bytes that a reader or an Arrow batch holds of rows that are blocks of many values.
BATCH_BYTES = 16_000_000
#: Readers and Arrow batches take this many rows, however wide these are.
_BATCH_ROWS = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


@contextmanager
def wide_rows(spark: SparkSession, row_bytes: int) -> Iterator[None]:
    """Queries planned inside take so few rows at a time that these hold ``BATCH_BYTES`` at most (or one row)."""
    before = {k: spark.conf.get(k) for k in _BATCH_ROWS}
    try:
        for k, v in before.items():
            most = int(v) if int(v) > 0 else BATCH_BYTES        # 0: no limit
            spark.conf.set(k, str(max(1, min(most, BATCH_BYTES // max(1, row_bytes)))))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``staged`` has written and that a newer one replaces."""
    if not path.startswith(scratch_root(spark) + "/"):
        raise ValueError(f"{path} is not one of this application's intermediates")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str = "stage", min_partitions: int | None = None) -> DataFrame:
    """Write ``df`` once to the checkpoint folder as parquet and read it back.

    One computation (``checkpoint()`` on an unpersisted plan computes twice),
    lineage cut, and the result is a plain file scan that any executor can
    re-read after a failure. ``min_partitions``: when the written result reads
    back as fewer splits than that (small data in few files), it is spread
    once more so later iterative jobs use every core; at cluster scale the
    file count already exceeds it and nothing extra happens.
    """
    spark = df.sparkSession
    back, path = staged(df, label)
    if min_partitions and back.rdd.getNumPartitions() < min_partitions:
        path2 = f"{path}-spread"
        back.repartition(min_partitions).write.mode("overwrite").parquet(path2)
        back = spark.read.parquet(path2)
    return back


def active_session() -> SparkSession:
    """The running session from any thread (worker threads of a pool have no
    thread-local active session of their own)."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def run_parallel(tasks: dict, max_workers: int | None = None) -> dict:
    """Run independent Spark jobs (e.g. three model fits) from a small thread
    pool, as ``CrossValidator(parallelism=...)`` does; returns name -> result.

    The default width comes from the session setting ``claimwise.fit.parallelism``
    (3): concurrent fits each cache their own training instances, so a
    memory-tight cluster sets it to 1."""
    from concurrent.futures import ThreadPoolExecutor
    if max_workers is None:
        max_workers = int(active_session().conf.get("claimwise.fit.parallelism", "3"))
    if max_workers <= 1:
        return {name: fn() for name, fn in tasks.items()}
    with ThreadPoolExecutor(max_workers=max_workers) as pool:
        futures = {name: pool.submit(fn) for name, fn in tasks.items()}
        return {name: f.result() for name, f in futures.items()}


def parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
