"""Session helpers: configuration defaults and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

def build_session(master: str | None = None, app: str = "montevar",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create a session with the settings the operators assume, or reuse the active one.

    An already running session (a cluster job, a notebook) is returned as is:
    its owner's configuration wins and nothing here overrides it.  Only the
    checkpoint folder is ensured (from ``spark.checkpoint.dir`` when set).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Small shuffles of CPU-heavy stages (windows, many aggregates) keep enough tasks.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.reuseSubquery": "true",
        "spark.sql.parquet.filterPushdown": "true",
    }
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM; size its heap (no effect
        # once a JVM is running, and never applied to cluster sessions).
        conf["spark.driver.memory"] = os.environ.get("MONTEVAR_DRIVER_MEMORY", "12g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests, a notebook) gets a fresh scratch folder; on a cluster
    that is an error, because executors could not see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="montevar-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured
