"""The telemetry pipeline itself: completeness, lag, clocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAG_S, AHEAD_S, QUARTER_S = 900, 300, 900


def quality(events: DataFrame, ts: Column, now: Column, malformed: Column) -> DataFrame:
    """One row: events, malformed, timeless and future rows, first and last sane time; partial sums only."""
    future = ts > now
    sane = F.when(~future, ts)
    return events.agg(F.count(F.lit(1)).alias("events"), F.count_if(malformed).alias("malformed"), F.count_if(ts.isNull()).alias("no_time"), F.count_if(future).alias("future"), F.min(sane).alias("start_s"), F.max(sane).alias("end_s"))


def lag_quantiles(d: DataFrame, by: str, lag: str) -> DataFrame:
    """Exact quartiles and 95th percentile of the lag, by linear interpolation, and what they tell.

    Lags in seconds repeat, so counts per distinct value come first and the quantiles weigh them.
    """
    c = d.filter(F.col(lag).isNotNull()).groupBy(by, F.col(lag).alias("x")).agg(F.count(F.lit(1)).alias("w"))
    q = c.groupBy(by).agg(F.sum("w").alias("n"), F.percentile("x", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.95)]), F.col("w")).alias("q"), F.min("x").alias("lo"))
    q = q.select(by, "n", "lo", *[F.col("q")[i].alias(c) for i, c in enumerate(("p25", "p50", "p75", "p95"))])
    whole = F.round(F.col("p50") / QUARTER_S) * QUARTER_S
    zone = (F.abs(F.col("p50") - whole) <= 60) & (F.abs(whole) >= 1800) & (F.col("p75") - F.col("p25") <= 120)
    return q.withColumn("state", F.when(F.col("p50") < -AHEAD_S, "ahead").when(zone, "zone_offset").when(F.col("p95") > LAG_S, "late").otherwise("ok"))
