"""Session helpers: a tuned local session for tests/bench and the scratch folder."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "turnlake",
                  extra_conf: dict | None = None) -> SparkSession:
    """Session for tests and the bench.  On a cluster, build the session with the cluster's
    own settings instead; the operators do not depend on any of these values."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TURNLAKE_DRIVER_MEMORY", "16g"))
    )
    for k, v in (extra_conf or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session (``spark.checkpoint.dir``).

    Only when the session names none (local tests) is a folder under /tmp set.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = f"/tmp/turnlake-checkpoints-{uuid.uuid4().hex[:8]}"
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder, for written intermediate tables,
    stream inputs/outputs and stream checkpoints."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/turnlake-{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df):
    """``df.checkpoint()`` (reliable, into the shared checkpoint folder; never a local
    checkpoint), making sure the session has a checkpoint folder first."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def swept(spark: SparkSession) -> None:
    """Lets the session delete the shuffle files and checkpoints that nothing refers to any more.  Spark does so when
    the driver collects its garbage, which a loop with small driver objects may not cause before the disk is full."""
    gc.collect()  # Python's handles of the driver's objects
    spark.sparkContext._jvm.System.gc()


def stored(df, name: str) -> tuple:
    """``(df as a written table, its path)``.  Unlike a checkpoint, whose plan carries the estimated size of all that it was
    made of, it has the size of its files: a loop of joins over it plans each round alike."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of :func:`stored` that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
