"""Session set-up, the shared checkpoint folder and partitioning helpers."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table that is sent whole to every executor.
BROADCAST_BYTES = 256 << 20

# Seconds between two looks of the driver for shuffles that nothing refers to any more.
SWEEP_SECONDS = 10

# Session options the jobs are written for. A cluster may set its own
# spark.sql.shuffle.partitions; nothing here depends on a particular count.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files go once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "rankloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the options above; keyword names use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    options = DEFAULTS | {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, taken from ``spark.checkpoint.dir``.

    A folder of our own is made only in local mode and only when none is
    named: on a cluster a machine-local folder would be lost with its machine.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current is None and named is not None:
        sc.setCheckpointDir(named)
        current = sc.getCheckpointDir()
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-"))
        current = sc.getCheckpointDir()
    return named or current


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: its rows are written to the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by one job: Parquet on the shared path, read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), "rankloom", f"{name}-{uuid.uuid4().hex}")


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Meanwhile, shuffles, cached blocks and checkpoints that nothing refers to any more go every few seconds.

    Spark lets them go when the driver's garbage is collected, which a driver that holds little seldom does: a long
    chain of jobs would leave the files of all of its steps.
    """
    over, jvm = threading.Event(), spark.sparkContext._jvm

    def sweep() -> None:
        while not over.wait(SWEEP_SECONDS):
            jvm.System.gc()

    sweeper = threading.Thread(target=sweep, daemon=True)
    sweeper.start()
    try:
        yield
    finally:
        over.set()
        sweeper.join()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def colocate(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition on ``keys`` once, so later work on the same keys stays put.

    The width is stated so that adaptive execution does not merge partitions
    by their size here: texts grow many times over once they become n-grams.
    """
    return df.repartition(shuffle_width(df.sparkSession), *keys)


def packed(df: DataFrame, *cols: str) -> DataFrame:
    """Even out partitions by their real size, for tables that are written or read many times."""
    return df.hint("rebalance", *cols)


def spread_scan(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a bare scan that has fewer partitions than there are cores, as a few big files give.

    A scan that is wide enough is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def table_bytes(df: DataFrame, row_bytes: Column | int) -> int:
    """Exact size of a table from the bytes of each row."""
    size = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def broadcast_if_small(df: DataFrame, row_bytes: Column | int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only after measuring the table; a larger one is joined by shuffle."""
    return F.broadcast(df) if table_bytes(df, row_bytes) <= limit else df
