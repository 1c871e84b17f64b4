"""Sketches stored by hour and combined by week, held against exact counts. With its SQL, on the bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.cuts import checkpointed
from alertloom.operators import sketches
from alertloom.operators.alerts import alerts
from alertloom.plans.noise_queries import WITH

QUERIES: dict = {}
_WEEK = 168


def sketches_by_week(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct and frequent values of each rule and week from sketches of its hours: what is exact, and whether the bounds hold."""
    value = F.when(F.col("k") < 50, F.concat(F.lit("often-"), F.col("k") % 5)).otherwise(F.concat(F.lit("k-"), "k", F.lit("-"), "src"))
    a = alerts(spark, sf).withColumn("v", value)
    hours = checkpointed(sketches.hourly(a, "rule_id", F.col("v"), F.col("v"))).withColumn("week", F.floor(F.col("h") / _WEEK))
    exact = a.groupBy("rule_id", F.floor(F.floor(F.unix_seconds("ts") / 3600) / _WEEK).alias("week"), F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("m"))
    return sketches.checked(sketches.combined(hours, ["rule_id", "week"]), exact, ["rule_id", "week"])


SQL = f"""{WITH}, v AS (SELECT rule_id, h // {_WEEK} AS week, CASE WHEN k < 50 THEN 'often-' || k % 5 ELSE 'k-' || k || '-' || src END AS value FROM a), c AS (SELECT rule_id, week, value, count(*) AS m FROM v GROUP BY ALL),
n AS (SELECT rule_id, week, sum(m)::BIGINT AS n FROM c GROUP BY ALL)
SELECT rule_id, week, n, count(*) AS exact, true AS distinct_ok, count(*) FILTER (m > {sketches.FREQUENT_ERROR!r} * n) AS heavy, true AS heavy_ok FROM c JOIN n USING (rule_id, week) GROUP BY ALL"""
QUERIES["sketches_by_week"] = (sketches_by_week, SQL)
