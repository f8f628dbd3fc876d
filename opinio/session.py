"""Session construction and shared-storage helpers."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

# Conservative defaults that hold from local[8] up to a large cluster: AQE
# re-plans joins from runtime sizes, coalesces small shuffle partitions and
# splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Remove checkpoint files once nothing references them (long-lived
    # sessions would otherwise accumulate them in the shared folder).
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "opinio", extra: dict | None = None) -> SparkSession:
    """Return the active session or build one with :data:`DEFAULT_CONF`."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system
    every executor can reach); Spark then registers it as the context's
    checkpoint folder at start-up.  Only where it is unset and everything runs in
    one process (master ``local``) is a private folder created, registered with
    ``SparkContext.setCheckpointDir`` and removed at exit; elsewhere its
    absence is an error, since no executor could read another's folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="opinio-ckpt-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


_WORK_DIRS: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint root."""
    path = os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _WORK_DIRS.append(path)
    return path


def clean_work_dirs(spark: SparkSession) -> None:
    """Delete the folders that :func:`work_dir` handed out in this process,
    once no result reads them any more (end of a benchmark or test run)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WORK_DIRS:
        where = jvm.org.apache.hadoop.fs.Path(_WORK_DIRS.pop())
        where.getFileSystem(conf).delete(where, True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of written intermediates on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of results that are settled.

    Files go when the driver's references are collected; without a hint that happens only
    when its heap fills, long after a large job's disk could have been free.
    """
    for _ in range(2):  # the first collection frees what holds the shuffles, the second them
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
