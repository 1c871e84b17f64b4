"""The hourly cube and the rhythm of its series: profiles, scale, dispersion, and the closed-form silence test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.cuts import checkpointed
from alertloom.operators.noise import hour
from alertloom.operators.order import least_from_above, numbered

BASELINE_H, WINDOW_H = 14 * 24, 24
PRIOR_H = 48
K_MIN, K_MAX = 0.5, 1000.0
TRIM = 0.1
ALARM_BUDGET = 0.05


def hourly_cube(a: DataFrame) -> DataFrame:
    """Counts per hour at five levels (tenant, log_source, agent, agent_log_source, rule) as grouping sets of one pass."""
    h, ls, src, rule = F.col("h"), F.col("ls"), F.col("src"), F.col("rule_id")
    t = a.select(hour(F.col("ts")).alias("h"), "ls", "src", "rule_id")
    c = t.groupingSets([[h], [h, ls], [h, src], [h, src, ls], [h, rule]], h, ls, src, rule)
    c = c.agg(F.grouping("ls").alias("g_ls"), F.grouping("src").alias("g_src"), F.grouping("rule_id").alias("g_rule"), F.count(F.lit(1)).alias("n"))
    level = F.when(F.col("g_rule") == 0, "rule").when((F.col("g_src") == 0) & (F.col("g_ls") == 0), "agent_log_source").when(F.col("g_src") == 0, "agent").when(F.col("g_ls") == 0, "log_source").otherwise("tenant")
    key1 = F.when(F.col("g_rule") == 0, F.col("rule_id")).when(F.col("g_src") == 0, F.col("src")).when(F.col("g_ls") == 0, F.col("ls"))
    c = c.select(level.alias("level"), key1.alias("key1"), F.when((F.col("g_src") == 0) & (F.col("g_ls") == 0), F.col("ls")).alias("key2"), "h", "n")
    # rows whose own key is missing have no place at their level
    return c.filter((F.col("level") == "tenant") | F.col("key1").isNotNull()).filter((F.col("level") != "agent_log_source") | F.col("key2").isNotNull())


def series(cube: DataFrame, level: str) -> DataFrame:
    """Zero-filled hourly counts of the keys of one level, from the first to the last hour of the whole cube."""
    c = cube.filter(F.col("level") == level)
    span = cube.agg(F.min("h").alias("h0"), F.max("h").alias("h1"))
    keys = c.select("key1", "key2").distinct().join(F.broadcast(span)).withColumn("h", F.explode(F.sequence("h0", "h1"))).select("key1", "key2", "h")
    c = c.select(F.col("key1").alias("a"), F.col("key2").alias("b"), F.col("h").alias("hh"), "n")
    same = F.col("key1").eqNullSafe(F.col("a")) & F.col("key2").eqNullSafe(F.col("b")) & (F.col("h") == F.col("hh"))
    return keys.join(c, same, "left").select("key1", "key2", "h", F.coalesce("n", F.lit(0)).alias("n"))


def baseline(s: DataFrame, end: int | None = None) -> DataFrame:
    """Rows of the baseline, [end - 14 days, end - 24 h), with ``slot``, the hour of the week in UTC (Monday 0)."""
    last = s.agg((F.max("h") + 1).alias("end"))
    d = s.join(F.broadcast(last)) if end is None else s.withColumn("end", F.lit(end))
    d = d.filter((F.col("h") >= F.col("end") - BASELINE_H) & (F.col("h") < F.col("end") - WINDOW_H)).drop("end")
    return d.withColumn("slot", F.pmod(F.col("h") + 72, F.lit(168)))


def profile(b: DataFrame) -> DataFrame:
    """Seasonal profile by hour of day, shrunk to the key's own mean and smoothed over neighbouring hours (1/4, 1/2, 1/4), of mean 1."""
    p = b.groupBy("key1", F.pmod("slot", F.lit(24)).alias("hod")).agg(F.sum("n").alias("s"), F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("key1")
    p = p.withColumn("mean", F.sum("s").over(w) / F.sum("m").over(w))
    p = p.withColumn("raw", (F.col("s") + PRIOR_H / 24.0 * F.col("mean")) / (F.col("m") + PRIOR_H / 24.0))
    ring = p.select("key1", "raw", "mean", F.explode(F.array(*[F.struct(F.pmod(F.col("hod") + d, F.lit(24)).alias("hod"), F.lit(wt).alias("wt")) for d, wt in ((-1, 0.25), (0, 0.5), (1, 0.25))])).alias("x"))
    smooth = ring.groupBy("key1", F.col("x.hod").alias("hod")).agg(F.sum(F.col("raw") * F.col("x.wt")).alias("v"))
    return smooth.withColumn("weight", F.when(F.sum("v").over(w) > 0, F.col("v") * 24 / F.sum("v").over(w)).otherwise(1.0)).select("key1", "hod", "weight")


def trimmed_scale(b: DataFrame) -> DataFrame:
    """Mean of the daily totals without the lowest and highest TRIM of the days."""
    d = b.groupBy("key1", F.floor(F.col("h") / 24).alias("day")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("key1")
    d = d.select("key1", "n", F.row_number().over(w.orderBy("n", "day")).alias("r"), F.count(F.lit(1)).over(w).alias("days"))
    cut = F.floor(F.col("days") * TRIM)
    return d.filter((F.col("r") > cut) & (F.col("r") <= F.col("days") - cut)).groupBy("key1", "days").agg(F.avg("n").alias("per_day"))


def dispersion(b: DataFrame, p: DataFrame) -> DataFrame:
    """Size k of a negative binomial by moments: sum of squared means over the sum of excess variance, within [K_MIN, K_MAX]."""
    mean = b.groupBy("key1").agg(F.avg("n").alias("mean"))
    d = b.withColumn("hod", F.pmod("slot", F.lit(24))).join(p, ["key1", "hod"]).join(mean, "key1").withColumn("mu", F.col("mean") * F.col("weight"))
    d = d.groupBy("key1", "mean").agg(F.sum(F.col("mu") * F.col("mu")).alias("m2"), F.sum((F.col("n") - F.col("mu")) * (F.col("n") - F.col("mu")) - F.col("n")).alias("excess"))
    k = F.when(F.col("excess") <= 0, K_MAX).otherwise(F.greatest(F.lit(K_MIN), F.least(F.lit(K_MAX), F.col("m2") / F.col("excess"))))
    return d.select("key1", "mean", k.alias("k"))


def silent_p0(s: DataFrame, p: DataFrame, k: DataFrame) -> DataFrame:
    """log P(no event) over the hours since a key's last event, and whether it is below the budgeted alarm level."""
    last = s.groupBy("key1").agg(F.max(F.when(F.col("n") > 0, F.col("h"))).alias("last_h"), F.max("h").alias("end_h"))
    gap = s.join(last, "key1").filter(F.col("h") > F.col("last_h")).withColumn("hod", F.pmod(F.col("h") + 72, F.lit(24)))
    gap = gap.join(p, ["key1", "hod"]).join(k, "key1").withColumn("mu", F.col("mean") * F.col("weight"))
    log_p = gap.groupBy("key1").agg(F.sum(-F.col("k") * F.log1p(F.col("mu") / F.col("k"))).alias("log_p0"))
    n = k.agg(F.count(F.lit(1)).alias("keys"))
    out = last.join(k.select("key1"), "key1").join(log_p, "key1", "left").withColumn("log_p0", F.coalesce("log_p0", F.lit(0.0))).join(F.broadcast(n))
    alpha = F.least(F.lit(0.5), F.lit(ALARM_BUDGET) / F.col("keys"))
    return out.select("key1", (F.col("end_h") - F.col("last_h")).alias("gap_h"), "log_p0", (F.col("log_p0") < F.log(alpha)).alias("silent"))


def q_values(p: DataFrame, key: str = "key1", log_p: str = "log_p0") -> DataFrame:
    """Benjamini-Hochberg: p n / rank, made monotone from the largest p down. Ranks and minima go by ranges of the order, so no task has
    all keys."""
    order = [F.col(log_p), F.col(key)]
    p = checkpointed(p.select(key, log_p, F.exp(log_p).alias("p")))
    d = numbered(p, order, "rank").join(F.broadcast(p.agg(F.count(F.lit(1)).alias("tests"))))
    d = least_from_above(d, order, F.col("p") * F.col("tests") / F.col("rank"), "least")
    return d.select(key, "p", "rank", F.least(F.lit(1.0), "least").alias("q"))


def precursors(a: DataFrame, latest: int = 64) -> DataFrame:
    """The latest high alerts of each host, which may explain a silence that follows them."""
    w = Window.partitionBy("src").orderBy(F.desc("ts"), "event_id")
    d = a.filter(F.col("lvl") >= 12).select("src", "rule_id", "event_id", "ts", F.row_number().over(w).alias("nth"))
    return d.filter(F.col("nth") <= latest).select("src", "rule_id", "event_id", F.unix_seconds("ts").alias("at_s"), "nth")


def busiest(onsets: DataFrame, seconds: int = 7200) -> DataFrame:
    """Largest number of onsets (key, at_s) within ``seconds`` of one of them, the frame going by time; the earliest wins ties.

    Counts per second come first, and a prefix sum per block of time stands in for one window over all rows.
    """
    per = onsets.groupBy("at_s").agg(F.count(F.lit(1)).alias("n")).withColumn("b", F.floor(F.col("at_s") / seconds))
    pairs = per.select("at_s", F.explode(F.array("b", F.col("b") + 1)).alias("b")).join(per.select("b", F.col("at_s").alias("t"), "n"), "b").filter((F.col("t") >= F.col("at_s")) & (F.col("t") <= F.col("at_s") + seconds))
    within = pairs.groupBy("at_s").agg(F.sum("n").alias("within"))
    return within.agg(F.max("within").alias("most"), F.min_by("at_s", F.struct(-F.col("within"), "at_s")).alias("from_s"))
