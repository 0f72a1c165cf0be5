"""Session set-up and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lexigrain")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_folder() -> str:
    """One folder per process for sessions without a shared one; it goes with the process."""
    folder = tempfile.mkdtemp(prefix="lexigrain-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which every executor can reach.

    Without the setting only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would lose the data with its executor, so the setting is required there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_folder()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Unlike a cached table it survives the loss of executors, cuts the lineage of iterative jobs and
    gives Catalyst a measured size, from which it chooses between broadcast and shuffle joins.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widen(df: DataFrame) -> DataFrame:
    """Spread a scan that has fewer input splits than the cluster has cores.

    A table in one row group is read by one task; CPU-heavy projections above it need more. Scans
    with enough splits are left alone, so no shuffle is added to large tables.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    return max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism
    )


def colocate(df: DataFrame, key: str) -> DataFrame:
    """Partition by ``key`` once, while rows are still whole texts.

    Every later aggregate or window keyed by ``key`` plus other columns then runs without another
    exchange. A table bucketed by ``key`` needs no call.
    """
    return df.repartition(shuffle_width(df.sparkSession), key)
