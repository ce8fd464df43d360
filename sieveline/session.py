"""Session helpers shared by tests, the benchmark and batch jobs."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def local_session(app: str = "sieveline", cpus: int | str = 8) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only where it
    is unset (tests, a laptop) is a local folder made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sieveline-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def ship_package() -> None:
    """Let Python workers run this package's functions without having it installed.

    Functions and classes then travel with the plan; state processors and data
    sources start workers that see neither ``addPyFile`` archives nor paths
    added by the driver.
    """
    import sieveline

    cloudpickle.register_pickle_by_value(sieveline)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a table written mid-plan."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")
