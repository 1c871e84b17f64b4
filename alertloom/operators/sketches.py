"""Sketches of distinct values and of frequent ones, stored by hour and combined over any span, with the bounds that they keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the distinct sketch as a power of two, and its error at three standard deviations.
LG_K = 12
DISTINCT_ERROR = 3 * 1.04 / (1 << (LG_K // 2))
#: Values that a frequency sketch tracks, the slots that it has for them (a power of two, three quarters full), and the share of all
#: events that a count is off by at most.
TRACKED = 64
SLOTS = 1 << (TRACKED * 4 // 3 - 1).bit_length()
FREQUENT_ERROR = 3.5 / SLOTS


def hourly(a: DataFrame, key: str, distinct: Column, value: Column) -> DataFrame:
    """(key, h, n, distincts, tops) of events with ts: a row an hour that later spans are combined from, so events are read once."""
    d = a.select(key, F.floor(F.unix_seconds("ts") / 3600).alias("h"), distinct.alias("d"), value.cast("string").alias("v"))
    return d.groupBy(key, "h").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("d", LG_K).alias("distincts"), F.expr(f"approx_top_k_accumulate(v, {TRACKED})").alias("tops"))


def combined(hours: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, distinct, tops) of ``hourly`` rows: events, estimated distinct values, and (item, count) of the tracked values."""
    d = hours.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("distincts")).alias("distinct"), F.expr(f"approx_top_k_combine(tops, {TRACKED})").alias("t"))
    return d.withColumn("tops", F.expr(f"approx_top_k_estimate(t, {TRACKED})")).drop("t")


def checked(found: DataFrame, exact: DataFrame, by: list[str]) -> DataFrame:
    """``found`` (combined) held against ``exact`` (by, value, m): n, exact distinct values, whether the estimate is within DISTINCT_ERROR, heavy
    values (more than FREQUENT_ERROR of n), and whether all of those are tracked and no count is off by more than that share."""
    truth = exact.groupBy(*by).agg(F.count(F.lit(1)).alias("exact"))
    tops = found.select(*by, F.explode_outer("tops").alias("x")).select(*by, F.col("x.item").alias("value"), F.col("x.count").alias("est"))
    each = exact.join(found.select(*by, "n"), by).join(tops, [*by, "value"], "left")
    heavy = F.col("m") > FREQUENT_ERROR * F.col("n")
    off = F.when(F.col("est").isNull(), heavy).otherwise((F.col("est") < F.col("m")) | (F.col("est") > F.col("m") + FREQUENT_ERROR * F.col("n")))
    per = each.groupBy(*by).agg(F.count_if(heavy).alias("heavy"), (~F.bool_or(off)).alias("heavy_ok"))
    d = found.join(truth, by).join(per, by)
    return d.select(*by, "n", "exact", (F.abs(F.col("distinct") - F.col("exact")) <= DISTINCT_ERROR * F.col("exact") + 1).alias("distinct_ok"), "heavy", "heavy_ok")
