"""Decisions about findings: who is told, what is accepted, what is grouped, and how fast a source could be missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators.incidents import rank

REMIND_S, LIKE = 12 * 3600, 5
SINGLE_CAUSE = 0.7
#: Patterns of accepted findings at most: each finding is held against all of them.
MOST_PATTERNS = 10_000
SLA_H = {"critical": 4, "standard": 24, "low": 72}


def accepted(findings: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """Findings with the acceptance that holds for them, or null: by fingerprint, or by kind and subject patterns; not if expired.

    ``rules`` is (rule, fp, kind_like, subject_like, until_s): a few lines of a file, matched as a theta side.
    """
    live = rules.filter(F.col("until_s").isNull() | (F.col("until_s") >= now)).withColumnRenamed("fp", "of")
    same = live.filter("of is not null").groupBy("of").agg(F.min("rule").alias("by_fp"))
    like = live.filter("of is null").select("rule", "kind_like", "subject_like")
    some = like.limit(MOST_PATTERNS + 1).count()
    if some > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of accepted findings")
    hit = findings.join(same, F.col("of") == F.col("fp"), "left").join(F.broadcast(like), F.expr("kind LIKE kind_like AND subject LIKE subject_like"), "left")
    return hit.groupBy("fp", "kind", "subject", "severity").agg(F.min(F.least("by_fp", "rule")).alias("accepted_by"))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    from alertloom.operators.incidents import SEVERITIES

    return findings.filter(rank("severity") >= SEVERITIES.index(severity) + 1)


def grouped(issues: DataFrame, like: int = LIKE) -> DataFrame:
    """(variant, tier, host, n): ``like`` and more hosts of one variant and tier are one finding without a host; critical hosts stay by
    themselves. Counts first, so a variant of many hosts is no group in memory."""
    n = issues.groupBy("variant", "tier").agg(F.count_distinct("host").alias("n"))
    many = n.filter((F.col("n") >= like) & (F.col("tier") != "critical"))
    alone = issues.join(many, ["variant", "tier"], "left_anti").select("variant", "tier", "host", F.lit(1).cast("long").alias("n")).distinct()
    return many.select("variant", "tier", F.lit(None).cast("string").alias("host"), "n").unionByName(alone)


def reminders(states: DataFrame, every_s: int = REMIND_S) -> DataFrame:
    """Runs of (fp, at_s, open) at which an open finding is told again: the first of each period since it opened."""
    w = Window.partitionBy("fp").orderBy("at_s")
    s = states.withColumn("starts", F.col("open") & ~F.coalesce(F.lag("open").over(w), F.lit(False)))
    s = s.withColumn("since", F.max(F.when(F.col("starts"), F.col("at_s"))).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("open")
    s = s.withColumn("period", F.floor((F.col("at_s") - F.col("since")) / every_s))
    first = s.withColumn("nth", F.row_number().over(Window.partitionBy("fp", "since", "period").orderBy("at_s"))).filter("nth = 1")
    return first.select("fp", "at_s", "since", "period", F.when(F.col("period") == 0, "opened").otherwise("reminder").alias("event"))


def hours_to_notice(mean: Column, k: Column, alpha: Column) -> Column:
    """Hours of silence of a steady source until it is less likely than ``alpha``; null for a source of no events."""
    return F.when(mean > 0, F.ceil(-F.log(alpha) / (k * F.log1p(mean / k))))


def monitorable(size: DataFrame, tier: Column, budget: float = 0.05) -> DataFrame:
    """Whether a key's silence could be noticed within its tier's time, from (key1, mean, k)."""
    n = size.agg(F.count(F.lit(1)).alias("keys"))
    sla = F.when(F.lit(False), 0)
    for t, h in SLA_H.items():
        sla = sla.when(F.col("tier") == t, h)
    d = size.join(F.broadcast(n)).withColumn("tier", tier).withColumn("t_min", hours_to_notice(F.col("mean"), F.col("k"), F.least(F.lit(0.5), F.lit(budget) / F.col("keys"))))
    return d.select("key1", "tier", "t_min", (F.coalesce(F.col("t_min") <= sla, F.lit(False))).alias("monitorable"))


def single_cause(deficits: DataFrame, share: float = SINGLE_CAUSE) -> DataFrame:
    """Per host with a deficit, the channel that accounts for at least ``share`` of it, or the host as a whole.

    ``deficits`` is (host, source, expected, observed).
    """
    d = deficits.withColumn("missing", F.greatest(F.lit(0.0), F.col("expected") - F.col("observed")))
    total = d.groupBy("host").agg(F.sum("missing").alias("total"), F.max_by("source", F.struct("missing", "source")).alias("source"), F.max("missing").alias("most")).filter("total > 0")
    return total.select("host", F.when(F.col("most") >= share * F.col("total"), F.col("source")).alias("cause"), F.round("total", 6).alias("missing"), F.round(F.col("most") / F.col("total"), 6).alias("share"))


def worst_sources(status: DataFrame, limit: int = 200) -> DataFrame:
    """The listing of a report: ``limit`` rows, gravest tier and lowest probability first (a report's own limit)."""
    order = F.array_position(F.array(*[F.lit(x) for x in ("critical", "standard", "low")]), F.col("tier"))
    return status.orderBy(order, "log_p0", "key1").limit(limit)
