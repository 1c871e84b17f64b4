"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whitespace of every contract here: space and the control characters 9 to 13.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Rows that a key has at least where it counts as frequent.
HOT_LEAST = 200


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; without one, a fresh local one under a local master (tests), and an
    error under any other, whose executors don't share their disks."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-alertloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: lineage ends there, no executor is needed again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstash(df: DataFrame) -> None:
    """Delete the files of a table written by ``stash`` once nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most: int = 1 << 18) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has at most ``most`` rows, a few longs each; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df



def join_per_key(big: DataFrame, table: DataFrame, keys: list[str], count: str = "many", most: int = 1 << 16) -> DataFrame:
    """Inner join of ``big`` with ``table``, a written one with one row for each key and, in ``count``, how many rows of ``big`` have it.

    Keys of more than total / ``most`` rows, which are fewer than ``most``, go to every task; only the rows of other keys are shuffled,
    so no task gets all the rows of a frequent key.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = F.col(count) > max(HOT_LEAST, total // most)
    often, seldom = F.broadcast(table.filter(hot)), table.filter(~hot)
    return big.join(often, keys).unionByName(big.join(often.select(*keys), keys, "left_anti").join(seldom, keys))
