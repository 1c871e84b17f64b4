"""Findings folded into incidents, and the state of each domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Severities in order.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def rank(c: str):
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(c))


def fold(findings: DataFrame, explains: list[tuple[str, str]], depth: int = 3) -> DataFrame:
    """(fp, root): each finding under the one that explains it, or itself.

    A finding of kind a explains one of kind b on the same host if (a, b) is among ``explains`` and a's severity is not less. Of
    several, the gravest and then the least fingerprint. Roots of roots follow, ``depth`` levels at most.
    """
    f = findings.select("fp", "kind", "host", rank("severity").alias("rank"))
    causes = findings.sparkSession.createDataFrame(explains, "cause string, kind string")
    c = f.join(F.broadcast(causes), "kind").join(f.toDF("root", "cause", "host", "root_rank"), ["cause", "host"]).filter("root_rank >= rank and root <> fp")
    best = c.withColumn("r", F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("root_rank"), "root"))).filter("r = 1").select("fp", "root")
    up = f.select("fp").join(best, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    for _ in range(depth - 1):
        up = up.join(best.toDF("root", "higher"), "root", "left").select("fp", F.coalesce("higher", "root").alias("root"))
    return up


def domain_status(findings: DataFrame, domains: list[str], assessed: list[str]) -> DataFrame:
    """fail, warn, ok or not_assessed per domain, with its worst severity and number of findings."""
    all_ = findings.sparkSession.createDataFrame([(d, d in assessed) for d in domains], "domain string, assessed boolean")
    worst = findings.groupBy("domain").agg(F.max(rank("severity")).alias("worst"), F.count(F.lit(1)).alias("n"))
    state = F.when(~F.col("assessed"), "not_assessed").when(F.col("worst") >= 4, "fail").when(F.col("worst") >= 2, "warn").otherwise("ok")
    return F.broadcast(all_).join(worst, "domain", "left").select("domain", state.alias("status"), F.coalesce("worst", F.lit(0)).cast("long").alias("worst"), F.coalesce("n", F.lit(0)).alias("n"))
