"""Paths of any file system that Spark can reach: listing, existence, small texts.

A path without a scheme belongs to the default file system of the session, so the same code works on
a local disk, HDFS or an object store.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _handle(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def _text(path) -> str:
    uri = path.toUri()
    return uri.getPath() if uri.getScheme() in (None, "file") else uri.toString()


def list_paths(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, in order; none if their folder is absent."""
    system, made = _handle(spark, pattern)
    return sorted(_text(s.getPath()) for s in system.globStatus(made) or [])


def exists(spark: SparkSession, path: str) -> bool:
    system, made = _handle(spark, path)
    return system.exists(made)


def remove(spark: SparkSession, path: str) -> None:
    system, made = _handle(spark, path)
    system.delete(made, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text, replacing what is there."""
    system, made = _handle(spark, path)
    out = system.create(made, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    return rows[0][0] if rows else ""
