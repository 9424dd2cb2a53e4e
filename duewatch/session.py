"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_private: dict[str, str] = {}
_open: list[str] = []


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("duewatch")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting, as in tests, gets a private temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    application = spark.sparkContext.applicationId
    if application not in _private:
        _private[application] = tempfile.mkdtemp(prefix="duewatch-")
    return _private[application]


@contextmanager
def staging(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder for the intermediate tables of one run; it goes when the run ends."""
    folder = staged_path(spark, label)
    _open.append(folder)
    try:
        yield folder
    finally:
        _open.remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged_path(spark: SparkSession, label: str) -> str:
    """A new place in the folder of the innermost :func:`staging`, or else in the shared folder."""
    return f"{_open[-1] if _open else shared_dir(spark) + '/duewatch'}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    Cuts the lineage: a lost executor re-reads files instead of recomputing the inputs, and every
    later use sees exactly the same rows.
    """
    spark = df.sparkSession
    path = staged_path(spark, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fit_tasks(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks of a fit, which scans its rows thousands of times: as many as run at once, ``rows_per_task`` rows at least.

    More tasks than cores would only launch more of them in every scan.
    """
    return max(1, min(math.ceil(rows / rows_per_task), spark.sparkContext.defaultParallelism))
