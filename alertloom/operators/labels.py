"""Analyst verdicts: the latest per alert, counts, and the lower bound of the false-positive rate."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_VERDICTS, CONFIDENCE = 10, 0.95


def latest(verdicts: DataFrame, key: str = "alert_id") -> DataFrame:
    """One verdict per alert: a true positive wins, else the latest closed, the line number breaking ties."""
    return verdicts.groupBy(key).agg(F.max_by("verdict", F.struct((F.col("verdict") == "tp").cast("int"), "closed_s", "line")).alias("verdict"), F.count(F.lit(1)).alias("n_verdicts"))


def wilson_lower(k: Column, n: Column, confidence: float = CONFIDENCE) -> Column:
    """One-sided lower bound of a binomial share; null for no trials."""
    z = NormalDist().inv_cdf(confidence)
    p = k / n
    root = z * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), (p + z * z / (2.0 * n) - root) / (1.0 + z * z / n)))


def evidence(labelled: DataFrame, by: str) -> DataFrame:
    """Per key: counts of verdicts and the lower bound of the share of false and benign positives."""
    d = labelled.groupBy(by).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("tp", "fp", "btp")], F.count_if(F.col("verdict").isNull()).alias("unlabelled"))
    n = F.col("tp") + F.col("fp") + F.col("btp")
    return d.withColumn("fp_lower", F.when(n >= MIN_VERDICTS, wilson_lower((F.col("fp") + F.col("btp")).cast("double"), n.cast("double"))))
