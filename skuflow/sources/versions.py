"""Versioned folders: models and their tables are written aside, and one pointer is renamed last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

POINTER = "CURRENT"


def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Call ``write`` with a new version folder below ``root`` and make that version the current one.

    A writer that fails, and a driver that is lost before the rename, leave the version before it current; what they
    wrote is never read. Versions stay until they are deleted, so readers that hold one go on reading it.
    """
    version = f"version-{uuid.uuid4().hex}"
    write(f"{root}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    aside = jvm.org.apache.hadoop.fs.Path(f"{root}/.{POINTER}-{version}")
    out = aside.getFileSystem(conf).create(aside, True)
    try:
        out.write(bytearray(version.encode()))
    finally:
        out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf)
    files.rename(aside, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), overwrite)
    return version


def current(spark: SparkSession, root: str) -> str:
    """Folder of the current version; a reader calls this once and reads everything below it."""
    rows = spark.read.option("wholetext", True).text(f"{root}/{POINTER}").collect()  # one name
    return f"{root}/{rows[0]['value']}"
