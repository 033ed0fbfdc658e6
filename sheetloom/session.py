"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles methods above 8000 bytes of code. Stages with many text conversions would exceed that and run
    # interpreted; with this limit they use several smaller methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

# Folders that a task writes at a time, and columns of all of them together.
MOST_WRITERS, MOST_BUFFERS = 32, 1_000


def build_session(master: str | None = None, app_name: str = "sheetloom", **extra: str) -> SparkSession:
    """A session with the settings the operators were tested under. On a cluster leave ``master`` to the submitter."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the code size limit above, unless its owner chose one."""
    key, default = "spark.sql.codegen.hugeMethodLimit", "65535"
    if spark.conf.get(key) == default:
        spark.conf.set(key, SETTINGS[key])
    return spark


@contextmanager
def several_writers(spark: SparkSession, columns: int) -> Iterator[None]:
    """Tasks write into several folders of a ``partitionBy`` at a time instead of sorting their rows by folder first, while the buffers of all columns stay few.

    What a task has for more folders than that, Spark sorts as before.
    """
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(MOST_WRITERS, MOST_BUFFERS // max(1, columns))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new, uniquely named folder below the shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` names that folder. Only a session in local mode, where driver and executors are one process, falls back to
    a folder of its own, which goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="sheetloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` at the shared folder unless the session already has one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(spark, "checkpoints"))
