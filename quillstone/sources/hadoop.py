"""Small files on whatever file system Spark reaches: created once, read whole, listed, deleted."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _where(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def local(spark: SparkSession, path: str) -> str | None:
    """The path on this machine's own file system, None on others."""
    where, fs = _where(spark, path)
    return unquote(urlparse(str(fs.makeQualified(where).toString())).path) if fs.getScheme() == "file" else None


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that is not there yet. False if it is: of several writers one wins.

    Distributed file systems decide that themselves; the local one through an exclusive open.
    """
    if name := local(spark, path):
        os.makedirs(os.path.dirname(name), exist_ok=True)
        try:
            with open(name, "x", encoding="utf-8") as f:
                f.write(text)
            return True
        except FileExistsError:
            return False
    where, fs = _where(spark, path)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception.getClass().getName()) or fs.exists(where):
            return False
        raise
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return True


def read_text(spark: SparkSession, path: str) -> str | None:
    """The whole file; None if it is not there."""
    where, fs = _where(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it is not there."""
    where, fs = _where(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _where(spark, path)
    fs.delete(where, True)
