"""A session with the settings that the engine expects; any other session with ANSI mode on will do."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None) -> SparkSession:
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions or cores))
    for k, v in {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    }.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); what is written there goes when Python ends.

    Where that is unset, a temporary folder serves a local master; any other raises, as its machines share no such folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="framewright-"))
        base = context.getCheckpointDir()
    root = f"{base.rstrip('/')}/framewright-{context.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


_roots: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    """Delete an application's tables, unless it was stopped before."""
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
