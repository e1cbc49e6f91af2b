"""Session settings and the small guards every operator shares."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the local benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("boxweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only when neither the session nor its context names one and everything runs in one
    process (tests, one machine) is a temporary folder set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep_state(spark: SparkSession) -> None:
    """State of streams in RocksDB; its files take the disk that they fill, as each of many small stores would reserve 4 MB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives executor loss."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """Broadcast hint only after a check of the size.

    Beyond ``max_rows`` the plan is left to the shuffle join. The count stops at
    the bound, so the check costs a scan of at most ``max_rows + 1`` rows.
    """
    rows = df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """All rows of a key in one task, for steps in Python that rely on it.

    By a hash of the keys: Spark leaves out a repartition by the very columns that a join below has just dealt by, and
    then turns that join into a broadcast that reads its rows where they lie, so a key would be in several tasks.
    """
    return df.repartition(F.xxhash64(*keys))


def reach_workers(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started.

    Local workers get its folder on their path; executors of a cluster get it as a file.
    """
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parents[1])
    known = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in known:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([root, *[p for p in known if p]])
    if not sc.master.startswith("local"):
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "boxweave"), "zip", root, "boxweave")
        sc.addPyFile(archive)
