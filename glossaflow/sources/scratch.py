"""Folders for what a plan writes on its way."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own_folder() -> str:
    own = tempfile.mkdtemp(prefix="glossaflow-")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a folder of this machine only where none is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder()


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes files or folders of any store that Spark can write to."""
    for path in paths:
        held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(held, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The paths of what lies in a folder, none if there is no folder."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().toString() for x in system.listStatus(held)] if system.exists(held) else []


def on_disk(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system names it, none if it lies in another store."""
    held = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    named = held.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(held).toUri()
    return named.getPath() if named.getScheme() == "file" else None


def temporary(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder that is deleted when this process ends."""

    def delete() -> None:
        if spark.sparkContext._jsc is not None:
            with contextlib.suppress(Exception):  # at the end the JVM may be gone
                remove(spark, path)

    path = folder(spark, what)
    atexit.register(delete)
    return path


def folder(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
