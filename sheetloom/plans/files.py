"""The two file-system calls Spark's readers and writers do not cover, through the Hadoop API every path goes through.

They need a classic session; Spark Connect has no way to them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), location


def delete(spark: SparkSession, path: str) -> None:
    system, location = _located(spark, path)
    system.delete(location, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, location = _located(spark, path)
    return bool(system.exists(location))
