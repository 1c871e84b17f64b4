"""The alert view: one row per event with rule, source host, channel and severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of ``value`` for the severity levels, and the level above all.
BANDS, TOP = ((2.0, 2), (15.0, 5), (60.0, 7), (150.0, 10)), 13
#: Levels from which an alert is for an analyst, and from which it is high.
ANALYST, HIGH = 7, 12


def level(value: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for bound, lvl in BANDS:
        out = out.when(value < bound, F.lit(lvl))
    return out.otherwise(F.lit(TOP))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts (UTC), rule_id, src, ls, lvl, value, k of every event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("rule_id"), F.concat(F.lit("u"), F.col("user_id")).alias("src"),
        F.concat(F.lit("ch"), k % 4).alias("ls"), level(F.col("value")).alias("lvl"), "value", k.alias("k"),
    )


def r6(c: Column) -> Column:
    return F.round(c, 6)


def rounded(c: Column, places: int) -> Column:
    """``c`` as DuckDB rounds a double: scaled as a double and then to the nearest whole, halves away from zero. Spark's own rounding goes by the
    decimal text of ``c``, so that ties differ."""
    scaled = c * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**places).otherwise(c)
