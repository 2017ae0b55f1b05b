"""Session defaults and the shared scratch area.

The library never needs its own session: every function takes DataFrames. The
builder below is for tests, the bench and ad-hoc use; on a cluster the values
come from ``spark-submit``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, scratch: str | None = None) -> SparkSession:
    """A session on this machine alone, so its tables may lie in a folder of this machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skuflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SKUFLOW_DRIVER_MEMORY", "8g"))
        .config("spark.checkpoint.dir", scratch or tempfile.mkdtemp(prefix="skuflow-"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below ``spark.checkpoint.dir``, which every executor can read.

    Where that is unset, the folder lies below the warehouse, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/skuflow-{spark.sparkContext.applicationId}"


def drop_shared(spark: SparkSession) -> bool:
    """Delete all tables this application wrote with ``materialize``; frames read from them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by writing ``df`` to the shared folder and reading it back.

    A written table survives the loss of any executor, and later stages read
    only the columns they need from it. Calling this runs a job.
    """
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
