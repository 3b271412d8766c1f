"""Hadoop FileSystem helpers (work on HDFS, object stores and local disks alike).

Only metadata calls on a few paths go through here; no rows do. Partition folders are never
named by hand: their paths come from the files Spark itself lists.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_and_path(spark: SparkSession, uri: str, encoded: bool = False):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri) if encoded else uri)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, uri: str) -> bool:
    """True if the folder exists. Errors other than "not found" propagate (no silent
    overwrite of a table we merely failed to reach)."""
    fs, p = _fs_and_path(spark, uri)
    return bool(fs.exists(p))


def delete(spark: SparkSession, uri: str, encoded: bool = False) -> bool:
    """Remove a folder; ``encoded`` paths are URIs as ``_metadata.file_path`` gives them."""
    fs, p = _fs_and_path(spark, uri, encoded)
    return bool(fs.delete(p, True))


def mkdirs(spark: SparkSession, uri: str) -> None:
    fs, p = _fs_and_path(spark, uri)
    fs.mkdirs(p)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, p = _fs_and_path(spark, source)
    _, q = _fs_and_path(spark, target)
    if not fs.rename(p, q):
        raise OSError(f"cannot rename {source} to {target}")
