"""What stands behind a silence or a candidate: precursors, live sources, repeated events, and overlapping scopes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEFORE_S, AFTER_S, AFTER_DROP_S = 7200, 600, 3600
LIVE_S = 60
OVERLAP, MOST = 0.8, 5


def tampering(anomalies: DataFrame, precursors: DataFrame) -> DataFrame:
    """(host, start_s, kind, n, latest_s): anomalies with a precursor on their host from two hours before to shortly after the start.

    An interval join on the host and on buckets of two hours, of which an anomaly meets the few that its interval touches.
    """
    until = F.col("start_s") + AFTER_S + F.when(F.col("kind") == "drop", AFTER_DROP_S).otherwise(0)
    a = anomalies.select("host", "start_s", "kind", (F.col("start_s") - BEFORE_S).alias("lo"), until.alias("hi"))
    a = a.withColumn("b", F.explode(F.sequence(F.floor(F.col("lo") / BEFORE_S), F.floor(F.col("hi") / BEFORE_S))))
    p = precursors.select(F.col("host").alias("on"), "at_s", F.floor(F.col("at_s") / BEFORE_S).alias("pb"))
    hit = a.join(p, (F.col("host") == F.col("on")) & (F.col("b") == F.col("pb")) & F.col("at_s").between(F.col("lo"), F.col("hi")))
    return hit.groupBy("host", "start_s", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("at_s").alias("latest_s"))


def dark_rules(a: DataFrame) -> DataFrame:
    """Per rule its last event, the last event of the sources that it used to fire on, and whether one of them went on without it."""
    pairs = a.groupBy("rule_id", "src", "ls").agg(F.max("ts").alias("t"))
    last = pairs.groupBy("rule_id").agg(F.max("t").alias("rule_last"))
    live = a.groupBy("src", "ls").agg(F.max("ts").alias("source_last"))
    d = pairs.join(live, ["src", "ls"]).join(last, "rule_id")
    went_on = F.unix_micros("source_last") - F.unix_micros("rule_last") > LIVE_S * 1_000_000
    return d.groupBy("rule_id").agg(F.unix_seconds(F.max("rule_last")).alias("last_s"), F.count_if(went_on).alias("live_sources"), F.count(F.lit(1)).alias("sources")).withColumn("dark", F.col("live_sources") > 0)


def correlated(a: DataFrame, times: int, seconds: int, by: tuple[str, ...] = ("rule_id", "src")) -> DataFrame:
    """Events that are at least the ``times``-th of their key within ``seconds``, by a time-range frame."""
    w = Window.partitionBy(*by).orderBy(F.unix_seconds("ts")).rangeBetween(-seconds, 0)
    return a.withColumn("recent", F.count(F.lit(1)).over(w)).filter(F.col("recent") >= times)


def select_scopes(scopes: DataFrame) -> DataFrame:
    """Of each rule's scopes (rule_id, subject, n, hours: array of what it covers), the MOST largest that overlap none before them.

    Two scopes overlap if they share OVERLAP of the smaller one. A rule has a few dozen scopes, one group each.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[set] = []
        keep = []
        for row in pdf.sort_values(["n", "subject"], ascending=[False, True]).itertuples(index=False):
            mine = set(row.hours)
            if len(chosen) < MOST and all(len(mine & c) < OVERLAP * min(len(mine), len(c)) for c in chosen):
                chosen.append(mine)
                keep.append((row.rule_id, row.subject, row.n, len(chosen)))
        return pd.DataFrame(keep, columns=["rule_id", "subject", "n", "nth"])

    return scopes.groupBy("rule_id").applyInPandas(one, "rule_id string, subject string, n long, nth long")
