"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    Only a session in one JVM may lack that setting: it gets a local folder. Elsewhere executors
    and driver share no local folder, so its absence is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder there that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below scratch_root."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write df as a scratch table and read it: cuts lineage and long plans, survives lost executors.

    Results that are not computed yet may read it, so it stays until drop_scratch, or discard.
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete scratch tables that materialize has returned, or a union of them, when all that reads them is written."""
    spark = table.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        if f"/{spark.sparkContext.applicationId}/" not in folder:
            raise ValueError(f"no scratch table: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application, once its results are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
