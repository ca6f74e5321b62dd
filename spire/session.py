"""Session construction and the shared scratch folder.

Everything that has to survive an executor loss (checkpoints, streaming
state, intermediate tables) lives under ``spark.checkpoint.dir``.  On a
cluster that setting names a shared folder and is read from the session;
only a local session without it gets a fresh folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # bucketed postings are joined without an exchange only if Spark is
    # allowed to use the bucket layout
    "spark.sql.sources.bucketing.enabled": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "spire", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
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
    shared_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session; a local session (tests, bench) without the
    setting gets its own fresh folder.  A cluster session without it is an
    error: a machine-local folder would not survive an executor loss.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="spire-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared folder.  What is written there is
    deleted when Python ends, if the session is still up."""
    base = shared_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def _clean() -> None:
    context = SparkContext._active_spark_context
    if context is None or context._jsc is None:
        return
    conf = context._jsc.hadoopConfiguration()
    for path in _SCRATCH:
        with contextlib.suppress(Exception):  # a folder that is gone, or a JVM that is
            p = context._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
