"""Scopes of repeated alerts: the narrowest that an alert names, values that recur without news, the verdict on a rule, the spread of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.operators import noise
from alertloom.operators.alerts import ANALYST

# Verdicts by precedence, values and hosts listed for a rule, and the bounds of the spread of days.
VERDICTS = ("do_not_tune", "investigate", "fix_at_source", "aggregate", "tune", "watch", "learning")
LISTED_VALUES, LISTED_HOSTS = 10, 5
LEAST_EXPECTED, LEAST_DAYS, CLIP, MAD = 20.0, 5, 2.5, 1.4826


def narrowest(a: DataFrame, host: str, value: str, companion: str) -> DataFrame:
    """Counts of the narrowest scope of each alert: host, value and companion, or host and value (companion null) of the alerts without.

    Alerts with a companion don't count for the pair. Those without host or value have no scope.
    """
    named = a.filter(F.col(host).isNotNull() & F.col(value).isNotNull())
    return named.groupBy("rule_id", host, value, companion).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lvl") >= ANALYST).alias("analyst"))


def steady(a: DataFrame, value: str) -> DataFrame:
    """Per rule the LISTED_VALUES most frequent of the values that recur from early on, on most days and without bursts: rule_id,
    value, n, present, nth. A report: values beyond those listed are left out."""
    keyed = a.select("rule_id", F.col(value).alias("value"), "ts").filter(F.col("value").isNotNull())
    seen = noise.novelty(keyed, ("rule_id", "value")).filter((F.col("n") >= noise.MIN_EVENTS) & ~F.col("novel") & (F.col("persistence") >= noise.PERSISTENCE))
    calm = noise.bursts(keyed, ("rule_id", "value")).filter(~F.col("burst")).select("rule_id", "value")
    w = Window.partitionBy("rule_id").orderBy(F.desc("n"), "value")
    return seen.join(calm, ["rule_id", "value"]).select("rule_id", "value", "n", "present", F.row_number().over(w).alias("nth")).filter(F.col("nth") <= LISTED_VALUES)


def steady_hosts(a: DataFrame, host: str, value: str) -> DataFrame:
    """Per rule the LISTED_HOSTS hosts with most alerts that have one of its ``steady`` values: rule_id, host, n, nth."""
    counts = a.groupBy("rule_id", F.col(host).alias("host"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("host").isNotNull())
    n = counts.join(steady(a, value).select("rule_id", "value"), ["rule_id", "value"]).groupBy("rule_id", "host").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("rule_id").orderBy(F.desc("n"), "host")
    return n.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= LISTED_HOSTS)


def first_verdict(verdict: Column) -> Column:
    """Aggregate: the verdict of a group that comes first in VERDICTS; "watch" for none that is known."""
    order = F.array(*[F.lit(v) for v in VERDICTS])
    at = F.array_position(order, verdict)
    first = F.min(F.when(at > 0, at))
    return F.when(first.isNull(), "watch").otherwise(F.get(order, first.cast("int") - 1))


def rule_verdicts(rules: DataFrame, found: DataFrame, learning: bool = False, max_level: int = 11) -> DataFrame:
    """The verdict on each of ``rules`` (rule_id, level, burst) by those ``found`` on its scopes (rule_id, verdict).

    A rule of an unknown level or one above ``max_level`` is never tuned; a burst of the whole rule asks for an investigation.
    """
    all_found = found.select("rule_id", "verdict").unionByName(rules.filter("burst").select("rule_id", F.lit("investigate").alias("verdict")))
    first = all_found.groupBy("rule_id").agg(first_verdict(F.col("verdict")).alias("first"))
    fixed = F.when(F.lit(learning), "learning").when(F.col("level").isNull() | (F.col("level") > max_level), "do_not_tune")
    return rules.join(first, "rule_id", "left").select("rule_id", F.coalesce(fixed, "first", F.lit("watch")).alias("verdict"))


def day_spread(days: DataFrame, key: str = "key1") -> DataFrame:
    """Standard deviation of log(total / expected) over the days of a key (expected, total), beyond what chance gives.

    Days without events, or expected to have under LEAST_EXPECTED, are left out; logs are held within CLIP robust deviations of their
    median, and the median of 1 / expected is taken off the variance. Zero for keys of under LEAST_DAYS such days.
    """
    fit = (F.col("expected") >= LEAST_EXPECTED) & (F.col("total") > 0)
    d = days.filter(fit).select(key, F.log(F.col("total") / F.col("expected")).alias("x"), (1 / F.col("expected")).alias("chance"))
    middle = d.groupBy(key).agg(F.percentile("x", 0.5).alias("mid"), F.percentile("chance", 0.5).alias("noise"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_DAYS)
    d = d.join(middle, key)
    width = d.groupBy(key).agg((F.lit(CLIP * MAD) * F.percentile(F.abs(F.col("x") - F.col("mid")), 0.5)).alias("reach"))
    held = F.greatest(F.col("mid") - F.col("reach"), F.least(F.col("mid") + F.col("reach"), "x"))
    s = d.join(width, key).groupBy(key).agg(F.sqrt(F.greatest(F.lit(0.0), F.var_samp(held) - F.first("noise"))).alias("sigma"))
    return days.select(key).distinct().join(s, key, "left").select(key, F.coalesce("sigma", F.lit(0.0)).alias("sigma"))
