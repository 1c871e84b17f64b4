"""Which rules are noisy, what repeats in them, and which narrow conditions could be tuned without hiding anything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.cuts import checkpointed
from alertloom.operators.alerts import ANALYST, HIGH

MIN_ALERTS, MIN_PER_DAY = 50, 5.0
CLUSTER_GAP_S = 900
TOP_RULES, HEAVY, EXAMPLES = 25, 64, 3
MIN_SHARE, MIN_EVENTS, PERSISTENCE, NOVELTY, BURST = 0.2, 10, 0.8, 0.25, 5.0
CO_WINDOW_H = 24
BEACON_HOURS, BEACON_COVERAGE, BEACON_RUN = 12, 0.75, 4.0
GAP_WIDTH, MIN_GAPS = 1.1, 10


def day(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 86400).cast("long")


def hour(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 3600).cast("long")


def rule_stats(a: DataFrame) -> DataFrame:
    """Per rule: total, analyst-facing and high alerts, levels, active days, first and last time; partial sums combine before the shuffle."""
    return a.filter(F.col("rule_id").isNotNull()).groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("lvl") >= ANALYST).alias("analyst"), F.count_if(F.col("lvl") >= HIGH).alias("high"),
        F.min("lvl").alias("min_lvl"), F.max("lvl").alias("max_lvl"), F.count_distinct(day(F.col("ts"))).alias("active_days"),
        F.unix_seconds(F.min("ts")).alias("first_s"), F.unix_seconds(F.max("ts")).alias("last_s"),
    )


def window_days(a: DataFrame) -> DataFrame:
    """One row: first day, last day and number of days of the window."""
    d = a.agg(F.min(day(F.col("ts"))).alias("d0"), F.max(day(F.col("ts"))).alias("d1"))
    return d.withColumn("n_days", F.col("d1") - F.col("d0") + 1)


def noisy_rules(a: DataFrame) -> DataFrame:
    """Rules of at least MIN_ALERTS alerts and MIN_PER_DAY a day of the window."""
    s = rule_stats(a).join(F.broadcast(window_days(a).select("n_days")))
    return s.withColumn("per_day", F.col("total") / F.greatest("n_days", F.lit(1))).filter((F.col("total") >= MIN_ALERTS) & (F.col("per_day") >= MIN_PER_DAY))


def mining_order(stats: DataFrame) -> DataFrame:
    """Rules among the first TOP_RULES by analyst-facing alerts or by total, ranked in both."""
    by = lambda *c: F.row_number().over(Window.orderBy(*c))
    s = stats.select("rule_id", "total", "analyst", by(F.desc("analyst"), F.desc("total"), "rule_id").alias("by_analyst"), by(F.desc("total"), "rule_id").alias("by_total"))
    return s.filter((F.col("by_analyst") <= TOP_RULES) | (F.col("by_total") <= TOP_RULES))


def clusters(a: DataFrame, by: tuple[str, ...] = ("src", "ls")) -> DataFrame:
    """Per rule: alerts, distinct dedup sessions (fingerprint and tumbling bucket) and the share of duplicates."""
    bucket = F.floor(F.unix_seconds("ts") / CLUSTER_GAP_S)
    return a.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), F.count_distinct(*[F.col(c) for c in by], bucket).alias("clusters")).withColumn("dup_ratio", 1 - F.col("clusters") / F.col("total"))


def anchors(a: DataFrame, fields: tuple[str, ...] = ("src", "ls")) -> DataFrame:
    """One row per alert and anchor field: rule_id, path, value, ts, lvl."""
    items = F.array(*[F.struct(F.lit(f).alias("path"), F.col(f).alias("value")) for f in fields])
    return a.select("rule_id", "ts", "lvl", F.explode(items).alias("x")).select("rule_id", F.col("x.path").alias("path"), F.col("x.value").alias("value"), "ts", "lvl").filter(F.col("value").isNotNull())


def anchor_counts(a: DataFrame) -> DataFrame:
    """Exact heavy hitters: the HEAVY most frequent values of each rule and field, with share and first and last day."""
    totals = a.groupBy("rule_id").agg(F.count(F.lit(1)).alias("rule_total"))
    c = anchors(a).groupBy("rule_id", "path", "value").agg(F.count(F.lit(1)).alias("n"), F.min(day(F.col("ts"))).alias("first_day"), F.max(day(F.col("ts"))).alias("last_day"), F.count_distinct(day(F.col("ts"))).alias("days"))
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("rule_id", "path").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= HEAVY)
    return c.join(totals, "rule_id").withColumn("share", F.col("n") / F.col("rule_total"))


def host_pairs(a: DataFrame) -> DataFrame:
    """Counts of host and channel together."""
    return a.groupBy("rule_id", "src", "ls").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lvl") >= ANALYST).alias("analyst"))


def external_share(a: DataFrame, external: Column) -> DataFrame:
    """Share of a host's alerts that come from outside."""
    return a.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.count_if(external).alias("external")).withColumn("share", F.col("external") / F.col("n"))


def regularity(a: DataFrame, by: tuple[str, ...] = ("rule_id", "src")) -> DataFrame:
    """Share of the gaps between occurrences that lie within a bin of the most common one; null under MIN_GAPS gaps.

    Gaps of a second and more, in log bins 10 % wide; neighbouring bins come by an equi-join on the bin, made thrice.
    """
    s = F.unix_micros("ts") / 1e6
    gap = s - F.lag(s).over(Window.partitionBy(*by).orderBy("ts", "event_id"))
    g = a.select(*by, gap.alias("gap")).filter("gap >= 1")
    bins = g.groupBy(*by, F.floor(F.log("gap") / F.log(F.lit(GAP_WIDTH))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    near = bins.select(*by, F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"), "n").groupBy(*by, "bin").agg(F.sum("n").alias("three"))
    best = near.join(bins.select(*by, "bin"), [*by, "bin"], "left_semi").groupBy(*by).agg(F.max("three").alias("best"))
    total = bins.groupBy(*by).agg(F.sum("n").alias("gaps"))
    return total.join(best, [*by]).select(*by, "gaps", F.when(F.col("gaps") >= MIN_GAPS, F.least(F.lit(1.0), F.col("best") / F.col("gaps"))).alias("regularity"))


def beacons(a: DataFrame, by: tuple[str, ...] = ("rule_id", "src")) -> DataFrame:
    """Active hours, their span and mean run, and whether that looks like a beacon."""
    h = a.select(*by, hour(F.col("ts")).alias("h")).distinct()
    h = h.withColumn("island", F.col("h") - F.row_number().over(Window.partitionBy(*by).orderBy("h")))
    s = h.groupBy(*by).agg(F.count(F.lit(1)).alias("active"), (F.max("h") - F.min("h") + 1).alias("span"), F.count_distinct("island").alias("runs"))
    like = (F.col("active") >= BEACON_HOURS) & ((F.col("active") / F.col("span") >= BEACON_COVERAGE) | (F.col("active") / F.col("runs") >= BEACON_RUN))
    return s.withColumn("beacon_like", like)


def daily(a: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Counts of every day of the window, zeros included."""
    w = window_days(a)
    counts = a.groupBy(*by, day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    keys = counts.select(*by).distinct().join(F.broadcast(w)).withColumn("day", F.explode(F.sequence("d0", "d1"))).drop("d0", "d1", "n_days")
    return keys.join(counts, [*by, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def bursts(a: DataFrame, by: tuple[str, ...] = ("rule_id",)) -> DataFrame:
    """Peak day against the median of all days."""
    d = daily(a, by).groupBy(*by).agg(F.max("n").alias("peak"), F.percentile("n", 0.5).alias("median"), F.min_by("day", F.struct(-F.col("n"), "day")).alias("peak_day"))
    return d.withColumn("burst", F.col("peak") >= BURST * F.greatest("median", F.lit(1.0)))


def novelty(a: DataFrame, by: tuple[str, ...] = ("rule_id", "src")) -> DataFrame:
    """Share of days present, and whether the value was first seen in the leading part of the window."""
    w = a.agg(F.unix_seconds(F.min("ts")).alias("s0"), F.unix_seconds(F.max("ts")).alias("s1"), (F.max(day(F.col("ts"))) - F.min(day(F.col("ts"))) + 1).alias("n_days"))
    s = a.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.min("ts")).alias("first_s"), F.count_distinct(day(F.col("ts"))).alias("present"))
    s = s.join(F.broadcast(w))
    return s.select(*by, "n", "first_s", "present", (F.col("present") / F.col("n_days")).alias("persistence"), (F.col("first_s") > F.col("s0") + NOVELTY * (F.col("s1") - F.col("s0"))).alias("novel"))


def high_index(a: DataFrame) -> DataFrame:
    """High alerts per host and hour."""
    return a.filter(F.col("lvl") >= HIGH).groupBy(F.col("src").alias("key"), hour(F.col("ts")).alias("h")).agg(F.count(F.lit(1)).alias("n"))


def co_occurrence(a: DataFrame, hours: int = CO_WINDOW_H) -> DataFrame:
    """Per rule and host: high alerts of other rules on the host within ``hours`` of the rule's own active hours.

    Both sides are counts per hour, and the interval join has the host as an equal key and buckets of ``hours`` hours besides, so
    a busy host meets three buckets only.
    """
    own = a.filter(F.col("lvl") < HIGH).select("rule_id", "src", hour(F.col("ts")).alias("h")).distinct()
    other = a.filter(F.col("lvl") >= HIGH).groupBy(F.col("rule_id").alias("other"), F.col("src").alias("key"), hour(F.col("ts")).alias("hh")).agg(F.count(F.lit(1)).alias("n"))
    own = own.withColumn("b", F.explode(F.array(*[F.floor(F.col("h") / hours) + d for d in (-1, 0, 1)])))
    other = other.withColumn("bb", F.floor(F.col("hh") / hours))
    hit = own.join(other, (F.col("src") == F.col("key")) & (F.col("b") == F.col("bb")) & (F.col("other") != F.col("rule_id")) & (F.abs(F.col("hh") - F.col("h")) <= hours))
    per = hit.select("rule_id", "src", "other", "hh", "n").distinct().groupBy("rule_id", "src").agg(F.sum("n").alias("high_near"), F.count_distinct("other").alias("other_rules"))
    return own.select("rule_id", "src").distinct().join(per, ["rule_id", "src"], "left").select("rule_id", "src", F.coalesce("high_near", F.lit(0)).alias("high_near"), F.coalesce("other_rules", F.lit(0)).alias("other_rules"))


def candidates(a: DataFrame, field: str = "ls") -> DataFrame:
    """Conditions (rule, field = value) that explain at least MIN_SHARE and MIN_EVENTS of their rule, with the facts of the gates."""
    totals = a.groupBy("rule_id").agg(F.count(F.lit(1)).alias("rule_total"), F.count_if(F.col("lvl") >= HIGH).alias("rule_high"))
    c = a.groupBy("rule_id", F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lvl") >= ANALYST).alias("analyst"), F.count_if(F.col("lvl") >= HIGH).alias("high"), F.percentile("lvl", 0.5).alias("usual_lvl"))
    c = c.join(totals, "rule_id").filter((F.col("n") >= MIN_SHARE * F.col("rule_total")) & (F.col("n") >= MIN_EVENTS))
    keyed = a.drop("value").withColumnRenamed(field, "value")
    nov = novelty(keyed, ("rule_id", "value")).select("rule_id", "value", "persistence", "novel")
    burst = bursts(keyed, ("rule_id", "value")).select("rule_id", "value", "burst")
    return c.join(nov, ["rule_id", "value"]).join(burst, ["rule_id", "value"])


def gated(c: DataFrame, max_level: int = 11, min_days: int = 7, n_days: Column | None = None) -> DataFrame:
    """Verdict by the first gate that fails: level, then novelty, persistence, burst, then high alerts in scope."""
    level = F.when(F.col("usual_lvl") > max_level, "do_not_tune")
    hard = F.when(F.col("novel") | (F.col("persistence") < PERSISTENCE) | F.col("burst"), "investigate")
    hides = F.when(F.col("high") > 0, "investigate")
    learning = F.when(n_days < min_days, "learning") if n_days is not None else F.lit(None)
    return c.withColumn("share", F.col("n") / F.col("rule_total")).withColumn("verdict", F.coalesce(learning, level, hard, hides, F.lit("tune")))


def by_rule(suggestions: DataFrame, most: int = 100_000) -> DataFrame:
    """``suggestions``, for every task if they are ``most`` at most, as suggestions are; more of them are shuffled with the alerts."""
    s = checkpointed(suggestions)
    return F.broadcast(s) if s.limit(most + 1).count() <= most else s


def backtest(a: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Replay of the suggestions over all alerts: an alert is hidden if it meets every condition (relational division).

    ``suggestions`` is (fp, rule_id, conditions array<struct<field,value>>). It comes from at most a few per rule and joins by rule.
    """
    facts = a.select("rule_id", "ts", "lvl", "src", "event_id", F.map_from_arrays(F.array(F.lit("src"), F.lit("ls")), F.array("src", "ls")).alias("has"))
    hit = facts.join(by_rule(suggestions), "rule_id").filter(F.forall("conditions", lambda c: F.col("has")[c["field"]] == c["value"]))
    stats = hit.groupBy("fp").agg(F.count(F.lit(1)).alias("hidden"), F.count_if(F.col("lvl") >= ANALYST).alias("analyst_hidden"), F.count_if(F.col("lvl") >= HIGH).alias("high_hidden"), F.count_distinct("src").alias("hosts"), F.max("lvl").alias("max_lvl"), F.count_distinct(day(F.col("ts"))).alias("days"))
    return suggestions.select("fp", "rule_id").join(stats, "fp", "left").na.fill(0)


def time_saved(a: DataFrame, suggestions: DataFrame, minutes: tuple[float, float] = (1.0, 5.0)) -> DataFrame:
    """Distinct analyst-facing sessions that any suggestion hides, and the minutes a day that they stand for."""
    facts = a.filter(F.col("lvl") >= ANALYST).select("rule_id", "src", "ls", F.floor(F.unix_seconds("ts") / CLUSTER_GAP_S).alias("bucket"), F.map_from_arrays(F.array(F.lit("src"), F.lit("ls")), F.array("src", "ls")).alias("has"))
    hit = facts.join(by_rule(suggestions), "rule_id").filter(F.forall("conditions", lambda c: F.col("has")[c["field"]] == c["value"]))
    n = hit.agg(F.count_distinct("rule_id", "src", "ls", "bucket").alias("sessions")).join(F.broadcast(window_days(a).select("n_days")))
    return n.select("sessions", *[(F.col("sessions") * m / F.col("n_days")).alias(c) for c, m in zip(("minutes_low", "minutes_high"), minutes, strict=True)])


def examples(a: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """``k`` alerts of each rule, drawn by a seeded hash: the same ones on every run and for any partitioning."""
    w = Window.partitionBy("rule_id").orderBy(F.sha2(F.concat(F.lit("24301|"), F.col("event_id")), 256), "event_id")
    return a.select("rule_id", "event_id", F.row_number().over(w).alias("nth")).filter(F.col("nth") <= k)
