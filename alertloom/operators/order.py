"""Row numbers of a total order without one window over all rows, and means whose terms have an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.cuts import checkpointed


def ranged(d: DataFrame, order: list[Column], number: str) -> DataFrame:
    """``d`` in ranges of the order, written: column ``part``, the range, and ``number``, the 1-based place in it."""
    parts = d.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    # the range is a column of the written table, so what is counted and what is numbered are the same rows
    parts = checkpointed(parts)
    return parts.withColumn(number, F.row_number().over(Window.partitionBy("part").orderBy(*order)))


def numbered(d: DataFrame, order: list[Column], number: str) -> DataFrame:
    """``d`` with its 1-based place in ``order``, which is total: rows are dealt by ranges, numbered there, and moved by the sizes of the
    ranges before, a table of one row for each range."""
    parts = ranged(d, order, "within")
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return parts.join(F.broadcast(before), "part").withColumn(number, F.col("before") + F.col("within")).drop("part", "within", "before")


def least_from_above(d: DataFrame, order: list[Column], value: Column, least: str) -> DataFrame:
    """``d`` with the least ``value`` of a row and of all rows after it in ``order``: within its range, and of the ranges after."""
    parts = d.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    parts = checkpointed(parts.withColumn("v", value))
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    per = parts.groupBy("part").agg(F.min("v").alias("m"))
    after = per.select("part", F.min("m").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    return parts.withColumn("own", F.min("v").over(w)).join(F.broadcast(after), "part").withColumn(least, F.least("own", F.coalesce("after", "own"))).drop("part", "v", "own", "after")


def means(d: DataFrame, by: list[str], order: list[str], value: str, mean: str, *more: Column) -> DataFrame:
    """``d`` by ``by``: ``mean``, of ``value`` added up row by row in ``order``, and the aggregates ``more``.

    The last bits of a sum of doubles depend on the order of its terms: of partial sums, on how the rows were dealt. Where a mean is rounded
    or compared they decide ties.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    d = d.withColumn("so_far", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(w))
    return d.groupBy(*by).agg((F.max_by("so_far", "nth") / F.count(value)).alias(mean), *more)
