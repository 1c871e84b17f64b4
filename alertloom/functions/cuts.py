"""Cutting lineage with a table in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; without one, a fresh local folder under a local master, and an
    error under any other, whose executors don't share their disks."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = where or "file://" + tempfile.mkdtemp(prefix="spark-alertloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back; its lineage ends there."""
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lines_of(df: DataFrame, by: str | None = None) -> str:
    """Path of new text files in the shared folder with the column ``value``, by values of ``by`` a folder with one file each."""
    path = f"{folder(df.sparkSession)}/text-{uuid.uuid4().hex}"
    (df.repartition(by).write.partitionBy(by) if by else df.write).text(path)
    return path
