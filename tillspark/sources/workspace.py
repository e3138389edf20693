"""Where intermediate tables go: the shared folder which the session names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`, or a folder below its warehouse where that is unset.

    Driver and executors reach both through Hadoop's file systems.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tillspark-scratch"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path below the shared folder which no other run uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/{label}-{app}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write as Parquet and read back, which cuts the lineage and survives lost executors.

    The table goes when the session's driver ends; until then frames may read it.
    """
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.mode("errorifexists").parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by `materialize` which nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
