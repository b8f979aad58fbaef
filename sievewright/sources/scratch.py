"""New folders under the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The URI of ``spark.checkpoint.dir``.

    Where that is unset a local session gets a local folder; a cluster has to set it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not where and known.isDefined():
        where = known.get()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/") if re.match(r"[a-z0-9]+:", where) else "file://" + where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder not yet made, for tables that a query writes and reads again."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: what uses it twice computes it once, and executors that are lost take nothing of it along."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
