"""Session and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "routewise", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session with AQE on and the UI off.

    On a cluster pass ``master=None`` and let spark-submit decide; the shuffle
    partition count then comes from the cluster defaults (AQE coalesces small
    partitions and splits skewed ones at run time).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoint files of frames that went out of scope are removed
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master and master.startswith("local"):
        # local mode: the driver JVM is the executor; give it a real heap
        conf["spark.driver.memory"] = "16g"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it.  Only in local mode, where driver and executors are
    one machine, an unset folder is replaced by a temporary one; elsewhere a
    driver-local folder would not be visible to executors, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="routewise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder (never a node-local dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex}"


def local_fs_path(path: str) -> str:
    """Strip a ``file:`` scheme for local assertions in tests."""
    return path[len("file:"):] if path.startswith("file:") else path


def materialize(df, mode: str = "checkpoint"):
    """Cut the lineage of a frame that several actions reuse.

    ``checkpoint`` writes it to the shared ``spark.checkpoint.dir`` (survives
    executor loss, never a node-local folder); ``persist`` keeps it in
    executor memory/disk and recomputes lost blocks from lineage."""
    if mode == "persist":
        from pyspark import StorageLevel
        out = df.persist(StorageLevel.MEMORY_AND_DISK)
        out.count()
        return out
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
