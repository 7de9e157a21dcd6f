"""Files that tasks open themselves: qualified names from the driver, Arrow file systems inside tasks."""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host of its (or the default) file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(place).toString()


def folders_in(spark: SparkSession, root: str) -> list[str]:
    """Qualified names of the folders directly in ``root``: one listing call; none if it is absent."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    return sorted(s.getPath().toString() for s in system.listStatus(place) if s.isDirectory())


def opened(name: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a qualified name and the path in it."""
    if name.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", name)
    return fs.FileSystem.from_uri(name)
