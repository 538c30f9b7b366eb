"""Session builder and the few settings every job of this library relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lonja", cpus: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches. On a cluster, build the session there and pass it in."""
    n = cpus or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LONJA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the one that the context has. A temporary folder of this machine is made
    only where neither is set and the session runs on one machine (tests); it is removed at the end."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lonja-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cuts lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
