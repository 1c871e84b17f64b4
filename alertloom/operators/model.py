"""The rhythm of a source as one model, and the tests of silence, drops and declines against it.

Sums are rounded to nine places before they are held against a bound, so the order in which Spark adds them up decides nothing.

Local clock, spikes held down, duty, an hour-of-week profile shrunk to that of the peers, scale, hourly and daily dispersion, days off
and how they go on; then P0 of the gap since the last event, the lower tail of a drop's window and of what follows its change point, and
the lower tail of declining days. Counts are read once and sparse; a key has 168 slots, its days, and its last hours, never all hours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions import tails
from alertloom.functions.cuts import checkpointed
from alertloom.operators import habits, rhythm
from alertloom.operators.cube import K_MAX, K_MIN
from alertloom.operators.scopes import day_spread

#: Hours of the evaluation window; hours after the start within which a key counts as there from the start.
WINDOW_H, SLACK_H = 24, 24
# Pseudo-events of the peers' profile, days for an hour-of-week profile, events to shape the peers' and for a dispersion of
# one's own, pseudo-days of a weekday, share of a mean day that a day must expect for the scale, and the bounds of the daily variance.
SHRINK, WEEKLY_DAYS, PEER_EVENTS, OWN_EVENTS, WEEKDAY_DAYS, DAY_SHARE, TRIM, INFLATION, LEAST_DAYS = 48.0, 21, 24, 100, 2.0, 0.25, 0.1, 4.0, 2
#: Events that the profile counts for in the model by the key's own hours of the week.
SLOT_EVENTS = 1.0
# Hours of a gap at most, and the spread of days from which it is integrated over.
MOST_GAP_H, LEAST_SIGMA = 60 * 24, 0.05
# Nodes and weights of the Gauss-Hermite rule of ten, positive half, and quantiles and weights of a chi-square variance.
NODES = (0.342901327223705, 1.036610829789514, 1.756683649299882, 2.532731674232790, 3.436159118837738)
WEIGHTS = (0.610862633735326, 0.240138611082315, 0.033874394455481, 0.001343645746781, 0.000007640432855)
VARIANCES = ((0.02, 0.04), (0.12, 0.16), (0.3, 0.2), (0.5, 0.2), (0.7, 0.2), (0.9, 0.2))
# Least expected events of a drop's window and effective hours they spread over, hours of it at most, and ratio of a drop.
LEAST_EXPECTED, SPREAD_H, MOST_DROP_H, DROP_RATIO = 20.0, 6.0, 168, 0.3
# Spans and reference of a decline in days, least days and median of the reference, and the ratio of seven days.
SPANS, REFERENCE_DAYS, LEAST_REFERENCE, LEAST_MEDIAN, DECLINE_RATIO = (2, 3, 4, 5, 6, 7), 28, 7, 5.0, 0.5
BUDGET = 0.05


def _size(num: Column, den: Column) -> Column:
    """Size by moments, within its bounds; no excess variance is Poisson."""
    return F.when((den > 0) & (num > 0), F.greatest(F.lit(K_MIN), F.least(F.lit(K_MAX), num / den))).otherwise(F.lit(K_MAX))


def _over(*keys: str):
    return Window.partitionBy(*keys)


def _unit(c: Column, w) -> Column:
    """``c`` scaled to a mean of 1 over a window; all 1 where there is nothing."""
    return F.when(F.sum(c).over(w) > 0, c / F.avg(c).over(w)).otherwise(F.lit(1.0))


def calendar(spine: DataFrame, end: int) -> DataFrame:
    """(day, dow, first_h, base) of the whole local days of ``spine`` (h, slot, day, off, regular) before hour ``end``: not off, of 24 hours
    from 0 to 23. ``base`` days end before the window. A few hundred rows, however many keys there are."""
    d = spine.filter("regular and not off").groupBy("day").agg(F.min("h").alias("first_h"), F.max("h").alias("last_h"))
    return d.filter(F.col("last_h") < end).select("day", F.pmod(F.col("day") + 3, F.lit(7)).alias("dow"), "first_h", (F.col("last_h") < end - WINDOW_H).alias("base"))


def key_days(counts: DataFrame, spine: DataFrame, end: int) -> DataFrame:
    """(key, day, dow, base, n) of the whole days of each key since its start, zeros included; with first_h and last_h of the key."""
    start = spine.agg(F.min("h")).first()[0]
    span = counts.groupBy("key").agg(F.min("h").alias("key_first"), F.max("h").alias("key_last"), F.sum("n").alias("total"))
    cal = calendar(spine, end).agg(F.collect_list(F.struct("day", "dow", "first_h", "base")).alias("cal"))
    begins = F.when(F.col("key_first") <= start + SLACK_H, F.lit(start)).otherwise(F.col("key_first"))
    d = span.join(F.broadcast(cal)).select("key", "key_first", "key_last", F.explode(F.filter("cal", lambda c: c["first_h"] >= begins)).alias("c")).select("key", "key_first", "key_last", "c.day", "c.dow", "c.base")
    n = counts.join(F.broadcast(spine.select("h", "day")), "h").groupBy("key", "day").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("active"))
    return d.join(n, ["key", "day"], "left").na.fill(0, ["n", "active"])


def slots(counts: DataFrame, spine: DataFrame, days: DataFrame) -> DataFrame:
    """(key, slot, dow, hod, ex, c, q, n, n_days): per slot of the week how often it was seen, and sums of the counts and their squares, with the
    counts of spike days held down. 168 rows for each key of LEAST_DAYS base days and an event in them."""
    base = days.filter("base")
    spikes = rhythm.spike_factors(base.select("key", "day", "n")).filter("factor < 1").select("key", "day", "factor")
    x = counts.join(F.broadcast(spine.select("h", "slot", "day")), "h").join(base.select("key", "day"), ["key", "day"]).join(spikes, ["key", "day"], "left")
    x = x.withColumn("x", F.col("n") * F.coalesce("factor", F.lit(1.0)))
    own = x.groupBy("key", "slot").agg(F.sum("x").alias("c"), F.sum(F.col("x") * F.col("x")).alias("q"))
    known = base.groupBy("key").agg(F.count(F.lit(1)).alias("n_days"), F.array(*[F.count_if(F.col("dow") == d) for d in range(7)]).alias("seen")).filter(F.col("n_days") >= LEAST_DAYS)
    grid = known.select("key", "n_days", "seen", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(167).cast("long"))).alias("slot")).withColumn("dow", F.floor(F.col("slot") / 24))
    s = grid.select("key", "n_days", "slot", "dow", F.pmod("slot", F.lit(24)).alias("hod"), F.get("seen", F.col("dow").cast("int")).alias("ex")).join(own, ["key", "slot"], "left").na.fill(0.0, ["c", "q"])
    return s.withColumn("n", F.sum("c").over(_over("key"))).filter("n > 0")


def profile(s: DataFrame) -> DataFrame:
    """``s`` (slots) with shape_p0 and shape, of mean 1: the key's own rates shrunk to the peers' by n / (n + SHRINK); shape also smoothed over
    the hours beside. From WEEKLY_DAYS base days on by hour of the week, else hour of day times weekday."""
    k = _over("key")
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    s = s.withColumn("r", ratio("c", "ex")).withColumn("mean", F.avg("r").over(k)).withColumn("w", F.col("n") / (F.col("n") + SHRINK))
    h, d = _over("key", "hod"), _over("key", "dow")
    s = s.withColumn("hod_raw", F.coalesce(F.sum("c").over(h) / F.nullif(F.sum("ex").over(h), F.lit(0)), F.lit(0.0))).withColumn("dow_raw", F.coalesce(F.sum("c").over(d) / F.nullif(F.sum("ex").over(d), F.lit(0)), F.lit(0.0)))
    s = checkpointed(s.withColumn("hod_own", _unit(F.col("hod_raw"), k)).withColumn("dow_own", _unit(F.col("dow_raw"), k)))
    peers = s.filter((F.col("n") >= PEER_EVENTS) & (F.col("mean") > 0)).groupBy("slot").agg(F.avg(F.col("r") / F.col("mean")).alias("how"), F.avg("hod_own").alias("hod_p"), F.avg("dow_own").alias("dow_p"))
    one = Window.partitionBy(F.lit(0))  # 168 rows
    peers = peers.select("slot", _unit(F.coalesce("how", F.lit(0.0)), one).alias("how"), _unit(F.col("hod_p"), one).alias("hod_p"), _unit(F.col("dow_p"), one).alias("dow_p"))
    s = s.join(F.broadcast(peers), "slot", "left").na.fill(1.0, ["how", "hod_p", "dow_p"])
    weekly = F.when(F.col("r").isNotNull() & (F.col("mean") > 0), F.col("w") * F.col("r") / F.col("mean") + (1 - F.col("w")) * F.col("how")).otherwise(F.col("how"))
    weeks = F.col("n_days") / 7.0
    s = s.withColumn("w_dow", weeks / (weeks + WEEKDAY_DAYS)).withColumn("part", F.avg("dow_own").over(Window.partitionBy("key", F.col("dow") < 5)))
    by_hour = F.col("w") * F.col("hod_own") + (1 - F.col("w")) * F.col("hod_p")
    by_day = F.col("w") * (F.col("w_dow") * F.col("dow_own") + (1 - F.col("w_dow")) * F.col("part")) + (1 - F.col("w")) * F.col("dow_p")
    s = s.withColumn("weekly", F.col("n_days") >= WEEKLY_DAYS).withColumn("raw", F.when(F.col("weekly"), weekly).otherwise(by_hour * by_day))
    o = k.orderBy("slot")
    before = F.coalesce(F.lag("raw").over(o), F.max_by("raw", "slot").over(k))
    after = F.coalesce(F.lead("raw").over(o), F.min_by("raw", "slot").over(k))
    s = s.withColumn("smooth", 0.25 * before + 0.5 * F.col("raw") + 0.25 * after)
    return s.select("key", "slot", "dow", "ex", "c", "q", "n", "n_days", "w", "w_dow", "weekly", "r", _unit(F.col("raw"), k).alias("shape_p0"), _unit(F.col("smooth"), k).alias("shape"))


def _trimmed(d: DataFrame) -> DataFrame:
    """(key, scale): mean of x without the lowest and highest TRIM."""
    k = _over("key")
    d = d.select("key", "x", F.row_number().over(k.orderBy("x", "day")).alias("i"), F.count(F.lit(1)).over(k).alias("m"))
    cut = F.floor(F.col("m") * TRIM)
    return d.filter((F.col("i") > cut) & (F.col("i") <= F.col("m") - cut)).groupBy("key").agg(F.avg("x").alias("scale"))


def fit(counts: DataFrame, spine: DataFrame, end: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables (slots, keys, days) of the model of every key of ``counts`` (key, h, n > 0) before hour ``end``.

    slots: key, slot, rate (smoothed), rate_p0, rate_alt (null with a weekly profile), rate_low, of events an hour. keys: key, key_last, n_days,
    n, scale, k, day_sigma, k_day, n_eff, duty, pi_off, pi_low, occ. days: key, day, dow, base, n.
    """
    counts = counts.filter(F.col("h") < end)
    days = checkpointed(key_days(counts, spine, end))
    s = checkpointed(profile(slots(counts, spine, days)))
    daily = s.groupBy("key", "dow").agg(F.avg("shape").alias("f"), F.round(F.sum("r"), 9).alias("raw_day"))
    base = days.filter("base").join(daily, ["key", "dow"])
    fair = base.withColumn("fair", F.col("f") >= DAY_SHARE).withColumn("any", F.max("fair").over(_over("key"))).filter("fair or not any")
    scale = _trimmed(fair.withColumn("x", F.when(F.col("fair"), F.col("n") / F.col("f")).otherwise(F.col("n")))).filter("scale > 0")
    s = s.join(scale, "key").withColumn("rate", F.col("scale") / 24 * F.col("shape")).withColumn("rate_p0", F.col("scale") / 24 * F.col("shape_p0"))
    alt = F.when((F.col("ex") > 0) & (F.col("rate_p0") > 0), (F.col("c") + SLOT_EVENTS) / (F.col("ex") + SLOT_EVENTS / F.col("rate_p0"))).otherwise(0.0)
    s = s.withColumn("alt", alt)
    s = s.withColumn("rate_alt", F.when(~F.col("weekly") & (F.sum("alt").over(_over("key")) > 0), F.col("scale") / 24 * _unit(F.col("alt"), _over("key"))))
    s = checkpointed(s.withColumn("rate_low", F.least("rate_p0", "rate_alt")))
    # hourly size: own residuals about rate_p0, or all keys' excess within slots
    pool = s.filter((F.col("n") >= OWN_EVENTS) & (F.col("ex") >= 2)).agg(F.sum(F.col("ex") * F.col("r") * F.col("r")).alias("num"), F.sum((F.col("q") - F.col("c") * F.col("c") / F.col("ex")) * F.col("ex") / (F.col("ex") - 1) - F.col("c")).alias("den"))
    pool = pool.select(_size(F.coalesce("num", F.lit(0.0)), F.coalesce("den", F.lit(0.0))).alias("pooled"))
    square = F.col("rate_p0") * F.col("rate_p0")
    m = s.groupBy("key", "n", "n_days", "w", "w_dow", "weekly", "scale").agg(
        F.sum("ex").alias("hours"), F.sum(F.col("ex") * square).alias("num"), F.sum(F.col("q") - 2 * F.col("rate_p0") * F.col("c") + F.col("ex") * square).alias("rest"),
        F.sum(F.when(F.pmod("slot", F.lit(24)).between(*rhythm.BUSINESS_HOURS), F.col("c")).otherwise(0.0)).alias("business"),
    )
    free = 1 + F.col("w") * F.when(F.col("weekly"), 168.0).otherwise(31.0)
    own = _size(F.col("num"), F.col("rest") * F.col("hours") / F.greatest(F.lit(1.0), F.col("hours") - free) - F.col("n"))
    m = m.join(F.broadcast(pool)).withColumn("k", F.when(F.col("n") >= OWN_EVENTS, own).otherwise(F.col("pooled")))
    # daily spread
    e = base.join(scale, "key").withColumn("expected", F.col("scale") * F.col("f")).select("key", "day", "n", "expected")
    spread = day_spread(e.select("key", "expected", F.col("n").alias("total")), "key").withColumnRenamed("sigma", "log_sigma")
    sums = e.groupBy("key").agg(F.sum(F.col("expected") * F.col("expected")).alias("num_d"), F.sum((F.col("n") - F.col("expected")) * (F.col("n") - F.col("expected")) - F.col("n")).alias("den_d"))
    p_day = 1 + F.col("w") * (1 + 5 * F.when(F.col("weekly"), 1.0).otherwise(F.col("w_dow")))
    m = m.join(spread, "key").join(sums, "key").withColumn("inflate", F.least(F.lit(INFLATION), (1 + p_day / F.col("n_days")) / F.greatest(F.lit(0.25), 1 - p_day / F.col("n_days"))))
    m = m.withColumn("cv2", F.when(F.col("log_sigma") > 0, F.expm1(F.col("log_sigma") * F.col("log_sigma"))).otherwise(1 / _size(F.col("num_d"), F.col("den_d"))) * F.col("inflate"))
    m = m.withColumn("day_sigma", F.sqrt(F.log1p("cv2"))).withColumn("k_day", F.greatest(F.lit(K_MIN), F.least(F.lit(K_MAX), 1 / F.greatest(F.col("cv2"), F.lit(1 / K_MAX)))))
    m = m.withColumn("n_eff", F.col("n_days") / (1 / F.col("scale") + 1 / F.col("k_day"))).withColumn("occ", F.col("n_days") * 3.0 / F.when(F.col("weekly"), 7.0).otherwise(1.0))
    m = checkpointed(m)  # a row for a key; duty and days off read it again for each rate
    m = m.join(duty_and_days_off(base, m.select("key", "hours", "business", "n")), "key")
    ends = days.groupBy("key").agg(F.first("key_last").alias("key_last"))
    keys = checkpointed(m.join(ends, "key").select("key", "key_last", "n_days", "n", "scale", "k", "day_sigma", "k_day", "n_eff", "duty", "pi_off", "pi_low", "occ", "peers"))
    return s, keys, days


def duty_and_days_off(base: DataFrame, m: DataFrame) -> DataFrame:
    """(key, duty, pi_off, pi_low, peers): how often a key has no event, or few, on a day that should have ELIGIBLE of them; never where it is
    always on. Peers are the keys that work on weekends, those that don't, and those not seen on both."""
    part = lambda on: F.avg(F.when((F.col("dow") >= 5) == on, F.col("n")))
    due = F.col("raw_day") >= rhythm.ELIGIBLE
    d = base.groupBy("key").agg(
        F.count_if(due).alias("days"), F.count_if(due & (F.col("n") <= 0)).alias("off"), F.count_if(due & (F.col("n") < DROP_RATIO * F.col("raw_day"))).alias("low"),
        F.count_if(F.col("n") > 0).alias("active_days"), F.count(F.lit(1)).alias("all_days"), F.sum("active").alias("active"), part(False).alias("week"), part(True).alias("ends"),
    ).join(m, "key")
    works = F.when(F.col("week").isNull() | F.col("ends").isNull(), "unknown").when(F.col("ends") >= 0.1 * F.col("week"), "weekends").otherwise("weekdays")
    kind = F.when(F.col("active") >= rhythm.ALWAYS_ON * F.col("hours"), "always_on").when((F.col("active_days") >= rhythm.WORKING * F.col("all_days")) & (F.col("business") >= rhythm.BUSINESS * F.col("n")), "business_hours").otherwise("intermittent")
    d = d.withColumn("peers", works).withColumn("duty", kind).withColumn("tier", F.lit("standard"))
    d = checkpointed(d)
    rate = lambda c, name: habits.day_rates(d.select("key", "tier", "peers", F.col(c).alias("events"), "days"), ["tier", "peers"]).select("key", F.col("rate").alias(name))
    d = d.join(rate("off", "pi_off"), "key").join(rate("low", "pi_low"), "key")
    never = lambda c: F.when(F.col("duty") == "always_on", 0.0).otherwise(F.col(c))
    return d.select("key", "duty", never("pi_off").alias("pi_off"), never("pi_low").alias("pi_low"), "peers")


def stays(days: DataFrame, s: DataFrame, keys: DataFrame) -> DataFrame:
    """(peers, after, stay): how likely the peers stay off after so many days off, from their runs of days off."""
    raw = s.groupBy("key", "dow").agg(F.round(F.sum("r"), 9).alias("raw_day"))
    d = days.filter("base").join(raw, ["key", "dow"]).join(keys.select("key", "peers"), "key").select("key", "peers", "day", F.col("n").cast("double").alias("n"), F.col("raw_day").alias("expected"))
    runs = rhythm.days_off(d.select("key", "day", "n", "expected")).join(keys.select("key", "peers"), "key")
    due = d.filter(F.col("expected") >= rhythm.ELIGIBLE)
    rates = due.groupBy("peers").agg((F.count_if(F.col("n") <= 0) / F.count(F.lit(1))).alias("rate"))
    return habits.staying_off(runs, rates, "peers")


def _doubled() -> list[tuple[float, float]]:
    """Nodes of both signs with the logs of their weights."""
    return [(sign * math.sqrt(2.0) * x, math.log(w / math.sqrt(math.pi))) for x, w in zip(NODES, WEIGHTS, strict=True) for sign in (-1.0, 1.0)]


def silent(s: DataFrame, keys: DataFrame, spine: DataFrame, end: int, stay: DataFrame | None = None, theta: DataFrame | None = None) -> DataFrame:
    """(key, gap_h, expected, log_p0) of every key: the largest chance of no event since its last hour with one, over shifts of the profile by an
    hour either way and over both models, and over what is known of the scale.

    Hours of a day share a multiplier of spread day_sigma, over which the day is integrated; a whole day may be one off, by pi_off, or after
    others off by ``stay`` (peers, after, stay). ``theta`` (key, theta) is the part of its cost that an hour of a bursty source has.
    """
    first = F.greatest(F.col("key_last") + 1, F.lit(end - MOST_GAP_H))
    g = keys.filter(first < end).select("*", F.explode(F.sequence(first, F.lit(end - 1).cast("long"))).alias("h"))
    g = g.join(F.broadcast(spine.filter("not off").select("h", "slot", "day")), "h").withColumn("shift", F.explode(F.array(F.lit(0), F.lit(-1), F.lit(1))))
    g = g.withColumn("slot", F.pmod(F.col("slot") - F.col("shift"), F.lit(168)))
    g = g.join(theta, "key", "left") if theta is not None else g.withColumn("theta", F.lit(1.0))
    g = g.na.fill(1.0, ["theta"]).join(s.select("key", "slot", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("model"), F.col("rate_p0").alias("mu")), F.struct(F.lit(1).alias("model"), F.col("rate_alt").alias("mu"))), lambda x: x["mu"] > 0)).alias("m")), ["key", "slot"]).withColumn("mu", F.col("m.mu"))
    cost = lambda mu: F.sum(-F.col("theta") * F.col("k") * F.log1p(mu / F.col("k")))
    nodes = [(F.exp(F.col("day_sigma") * x - F.col("day_sigma") * F.col("day_sigma") / 2), w) for x, w in _doubled()]
    day = g.groupBy("key", "shift", F.col("m.model").alias("model"), "day", "k", "day_sigma", "n_eff", "occ", "pi_off", "peers", "theta", "key_last").agg(
        cost(F.col("mu")).alias("plain"), F.sum("mu").alias("lam"), *[(cost(F.col("mu") * m)).alias(f"node{i}") for i, (m, _) in enumerate(nodes)]
    )
    mixed = F.log(sum((F.exp(F.col(f"node{i}") + w) for i, (_, w) in enumerate(nodes)), F.lit(1e-305)))
    day = day.withColumn("cost", F.when(F.col("day_sigma") >= LEAST_SIGMA, F.least(F.lit(0.0), F.greatest(mixed, "plain"))).otherwise(F.col("plain")))
    # days off before: substantial days of the gap so far, but for the day that the gap begins in
    last_day = spine.select(F.col("h").alias("key_last"), F.col("day").alias("last_day"))
    day = day.join(F.broadcast(last_day), "key_last", "left").withColumn("later", ~F.coalesce(F.col("day") == F.col("last_day"), F.lit(False)))
    so_far = Window.partitionBy("key", "shift", "model").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    day = day.withColumn("before", F.coalesce(F.sum(F.when(F.col("later") & (F.round("lam", 9) >= rhythm.ELIGIBLE), 1).otherwise(0)).over(so_far), F.lit(0)))
    if stay is not None:
        day = day.withColumn("after", F.least(F.col("before"), F.lit(habits.CURVE_DAYS)).cast("long")).join(F.broadcast(stay), ["peers", "after"], "left")
    else:
        day = day.withColumn("stay", F.lit(None).cast("double"))
    q = F.when((F.col("before") > 0) & F.col("stay").isNotNull(), F.least(F.lit(0.999), F.greatest("pi_off", "stay"))).otherwise(F.col("pi_off"))
    day = day.withColumn("cost", F.when((F.col("pi_off") > 0) & F.col("later"), F.log(q + (1 - q) * F.exp("cost"))).otherwise(F.col("cost")))
    t = day.groupBy("key", "shift", "model", "n_eff", "occ", "theta").agg(F.greatest(F.lit(tails.LOG_FLOOR), F.sum("cost")).alias("log_nb"), F.sum("lam").alias("lam"))
    used = F.least(F.col("n_eff"), F.greatest(F.lit(1.0), F.col("lam") * F.col("occ")))
    t = t.withColumn("scaled", F.when(F.col("lam") > 0, -used * F.log1p(F.col("lam") * F.col("theta") / used)).otherwise(0.0))
    best = t.groupBy("key").agg(F.max(F.greatest("log_nb", "scaled")).alias("best"), F.max(F.when((F.col("shift") == 0) & (F.col("model") == 0), F.col("lam"))).alias("expected"))
    out = keys.select("key", (F.lit(end) - 1 - F.col("key_last")).alias("gap_h")).join(best, "key", "left")
    return out.select("key", "gap_h", F.coalesce("expected", F.lit(0.0)).alias("expected"), F.least(F.lit(0.0), F.coalesce("best", F.lit(0.0))).alias("log_p0"))


def lower_tail(d: DataFrame, by: list[str]) -> DataFrame:
    """(by, log_p) of rows (by, observed, mean, size, sigma, dof, pi, low_days): the chance of so few events.

    The window may have up to low_days empty days, each with chance pi; sigma is the spread of a multiplier of the mean, itself known from
    dof days. What is mixed becomes rows: days empty, variances, nodes; a row is one tail, summed up by ``by``, however large its count.
    """
    days = F.when((F.col("pi") > 0) & (F.col("low_days") > 0), F.col("low_days")).otherwise(0)
    d = d.withColumn("m", days).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m").cast("long"))))
    choose = tails.log_gamma(F.col("m") + 1.0) - tails.log_gamma(F.col("j") + 1.0) - tails.log_gamma(F.col("m") - F.col("j") + 1.0)
    d = d.withColumn("lw", F.when(F.col("m") > 0, choose + F.col("j") * F.log("pi") + (F.col("m") - F.col("j")) * F.log1p(-F.col("pi"))).otherwise(0.0))
    share = F.when(F.col("m") > 0, (F.col("m") - F.col("j")) / F.col("m")).otherwise(1.0)
    d = d.withColumn("mean", F.col("mean") * share).withColumn("size", F.when(share > 0, F.col("size") * share).otherwise(F.col("size")))
    wide = (F.col("sigma") >= LEAST_SIGMA) & (F.col("mean") > 0)

    def variance(p: float, w: float) -> Column:
        c = 2 / (9 * F.greatest(F.lit(1.0), F.col("dof")))
        chi = F.greatest(F.lit(1.0), F.col("dof")) * F.pow(F.greatest(F.lit(1e-6), 1 - c + tails.normal_quantile(p) * F.sqrt(c)), 3)
        return F.struct(F.lit(math.log(w)).alias("w"), (F.col("sigma") * F.sqrt(F.greatest(F.lit(1.0), F.col("dof")) / chi)).alias("sg"))

    once = F.array(F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sg")))
    several = F.when(F.col("dof") > 0, F.array(*[variance(p, w) for p, w in VARIANCES])).otherwise(F.array(F.struct(F.lit(0.0).alias("w"), F.col("sigma").alias("sg"))))
    d = d.withColumn("v", F.explode(F.when(wide, several).otherwise(once)))
    node = lambda x, w: F.struct(F.lit(x).alias("x"), F.lit(w).alias("w"))
    d = d.withColumn("g", F.explode(F.when(wide, F.array(*[node(x, w) for x, w in _doubled()])).otherwise(F.array(node(0.0, 0.0)))))
    mean = F.col("mean") * F.exp(F.col("v.sg") * F.col("g.x") - F.col("v.sg") * F.col("v.sg") / 2)
    d = d.withColumn("mu", mean).withColumn("log_p", tails.log_cdf(F.col("observed"), F.col("mu"), F.col("size")))
    return d.groupBy(*by).agg(F.least(F.lit(0.0), tails.log_sum(F.col("lw") + F.col("v.w") + F.col("g.w") + F.col("log_p"))).alias("log_p"))


def _combined(*sizes: Column) -> Column:
    """Size of several independent effects: relative variances add."""
    return 1 / sum((F.coalesce(1 / x, F.lit(0.0)) for x in sizes), F.lit(0.0))


def dropped(counts: DataFrame, s: DataFrame, keys: DataFrame, spine: DataFrame, end: int) -> DataFrame:
    """(key, hours, observed, expected, onset_h, effect, log_p) of every key that expects LEAST_EXPECTED events: its last hours, grown by days until
    enough is expected, against what is expected by the alignment, an hour either way, that expects least.

    The change point is the suffix whose lower rate is likeliest; what follows it is tested too, its chance times the hours it could have
    begun in. log_p is 0 where the effect is no drop.
    """
    tail = spine.filter((F.col("h") < end) & ~F.col("off")).orderBy(F.desc("h")).limit(MOST_DROP_H)
    tail = checkpointed(tail.select("h", "slot", "day", F.row_number().over(Window.orderBy(F.desc("h"))).alias("i")))  # a week of hours
    around = lambda k: F.pmod(F.col("slot") + k, F.lit(168))
    low = s.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "rate_low"))).alias("low"))
    t = keys.join(low, "key").join(F.broadcast(tail.agg(F.collect_list(F.struct("h", "slot", "day", "i")).alias("tail")))).select("key", "low", F.explode("tail").alias("x")).select("key", "low", "x.*")
    t = t.select("key", "h", "day", "i", *[F.element_at("low", around(k)).alias(f"m{j}") for j, k in enumerate((0, 1, -1))]).join(counts.select("key", "h", "n"), ["key", "h"], "left").na.fill(0, ["n"])
    back = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("*", *[F.sum(f"m{j}").over(back).alias(f"s{j}") for j in range(3)], *[F.sum(F.col(f"m{j}") * F.col(f"m{j}")).over(back).alias(f"q{j}") for j in range(3)], F.sum("n").over(back).alias("o"))
    enough = (F.col("s0") >= LEAST_EXPECTED) & (F.col("q0") > 0) & (F.col("s0") * F.col("s0") >= SPREAD_H * F.col("q0"))
    stop = F.min(F.when((F.col("i") >= WINDOW_H) & (F.col("i") % 24 == 0) & (enough | (F.col("i") >= MOST_DROP_H)), F.col("i"))).over(_over("key"))
    t = t.withColumn("hours", F.coalesce(stop, F.max("i").over(_over("key")))).filter(F.col("i") <= F.col("hours"))
    whole = F.col("i") == F.col("hours")
    pick = lambda name, c: F.max(F.when(whole, c)).over(_over("key")).alias(name)
    least = F.least("s0", "s1", "s2")
    which = F.when(F.col("s0") == least, 0).when(F.col("s1") == least, 1).otherwise(2)
    t = t.select("*", pick("which", which))
    at = lambda p: F.when(F.col("which") == 0, F.col(f"{p}0")).when(F.col("which") == 1, F.col(f"{p}1")).otherwise(F.col(f"{p}2"))
    t = t.withColumn("mu", at("m")).withColumn("e", at("s")).withColumn("sq", at("q"))
    ratio = F.col("o") / F.col("e")
    gain = F.when((F.col("e") > 0) & (F.col("o") < F.col("e")), F.when(F.col("o") > 0, F.col("o") * F.log(ratio)).otherwise(0.0) - F.col("e") * (ratio - 1))
    t = t.withColumn("gain", F.round(gain, 9))
    t = checkpointed(t.withColumn("cut", F.coalesce(F.max_by("i", F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("i")))).over(_over("key")), F.lit(1))))
    seg = F.col("i") == F.col("cut")
    part = F.least("s0", "s1", "s2")
    part_sq = F.when(F.col("s0") == part, F.col("q0")).when(F.col("s1") == part, F.col("q1")).otherwise(F.col("q2"))
    one = t.groupBy("key", "hours").agg(
        F.max(F.when(whole, F.col("o"))).alias("observed"), F.max(F.when(whole, F.col("e"))).alias("expected"), F.max(F.when(whole, F.col("sq"))).alias("sq"), F.max(F.when(seg, F.col("h"))).alias("onset_h"),
        F.max(F.when(seg, F.col("o"))).alias("seg_o"), F.max(F.when(seg, part)).alias("seg_e"), F.max(F.when(seg, part_sq)).alias("seg_sq"), F.first("cut").alias("cut"),
    ).filter(F.col("expected") >= LEAST_EXPECTED)
    cuts = (F.col("cut") < F.col("hours")) & (F.col("seg_e") >= LEAST_EXPECTED) & (F.col("seg_o") > 0)
    one = one.withColumn("by_part", cuts).withColumn("effect", F.least(F.col("observed") / F.col("expected"), F.when(cuts, F.col("seg_o") / F.col("seg_e"))))
    per_day = lambda upto: t.filter(F.col("i") <= F.col(upto)).groupBy("key", "day").agg(F.sum("mu").alias("e"))
    out = one.select("key", "hours", "observed", "expected", "onset_h", "effect", "by_part")
    tested = checkpointed(one.filter(F.col("effect") < DROP_RATIO).join(keys.select("key", "k", "k_day", "day_sigma", "n_eff", "pi_off", "pi_low", "n_days"), "key"))

    def rows(part: int, o: str, e: str, sq: str, hours: str, upto: str, which: DataFrame) -> DataFrame:
        size, days = F.col(e) * F.col(e) * F.col("k") / F.col(sq), F.greatest(F.lit(1.0), F.col(hours) / 24.0)
        due = per_day(upto).join(which.select("key", F.col(e).alias("all")), "key").filter(F.round("e", 9) >= F.round(F.greatest(F.lit(rhythm.ELIGIBLE), 0.1 * F.col("all")), 9)).groupBy("key").agg(F.count(F.lit(1)).alias("low_days"))
        wide = F.col("day_sigma") >= LEAST_SIGMA
        d = which.join(due, "key", "left").na.fill(0, ["low_days"])
        return d.select(
            "key", F.lit(part).alias("part"), F.col(o).alias("observed"), F.col(e).alias("mean"), F.when(wide, _combined(size, F.col("n_eff"))).otherwise(_combined(size, F.col("k_day") * days, F.col("n_eff"))).alias("size"),
            F.when(wide, F.sqrt(F.log1p(F.expm1(F.col("day_sigma") * F.col("day_sigma")) / days))).otherwise(0.0).alias("sigma"), (F.col("n_days") - 1.0).alias("dof"), F.greatest("pi_off", "pi_low").alias("pi"), "low_days", "hours",
        )

    both = rows(0, "observed", "expected", "sq", "hours", "hours", tested).unionByName(rows(1, "seg_o", "seg_e", "seg_sq", "cut", "cut", tested.filter("by_part")))
    p = lower_tail(both, ["key", "part", "hours"]).withColumn("log_p", F.least(F.lit(0.0), F.col("log_p") + F.when(F.col("part") == 1, F.log("hours")).otherwise(0.0)))
    return out.join(p.groupBy("key").agg(F.min("log_p").alias("log_p")), "key", "left").na.fill(0.0, ["log_p"]).drop("by_part")


def declined(days: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, span, ratio, log_p) of the span of last whole days that speaks most for a decline, of keys with enough of a reference before all spans.

    A day's expectation is its weekday's mean in the reference, drawn to that of weekdays or weekends; each day of the reference is
    predicted without itself for the spread. Spans share the level; the longest must have its median fall too.
    """
    last = F.max("day").over(_over("key"))
    d = days.withColumn("last", last).filter(F.col("day") > F.col("last") - REFERENCE_DAYS - SPANS[-1]).withColumn("ref", F.col("day") <= F.col("last") - SPANS[-1]).withColumn("workday", F.col("dow") < 5)
    ref = F.when(F.col("ref"), F.col("n").cast("double"))
    for name, by in (("k", ("key",)), ("g", ("key", "workday")), ("d", ("key", "dow"))):
        d = d.withColumn(f"s{name}", F.coalesce(F.sum(ref).over(_over(*by)), F.lit(0.0))).withColumn(f"n{name}", F.count(ref).over(_over(*by)))
    d = d.filter(F.col("nk") >= LEAST_REFERENCE)

    def expect(out: Column, one: Column) -> Column:
        base = F.when(F.col("ng") > one, (F.col("sg") - out) / (F.col("ng") - one)).otherwise((F.col("sk") - out) / F.greatest(F.lit(1), F.col("nk") - one))
        m = F.col("nd") - one
        return F.when(m <= 0, base).otherwise(m / (m + WEEKDAY_DAYS) * (F.col("sd") - out) / m + WEEKDAY_DAYS / (m + WEEKDAY_DAYS) * base)

    # read a dozen times below: at most REFERENCE_DAYS and a week of rows for a key
    d = checkpointed(d.withColumn("expected", F.when(F.col("ref"), expect(F.col("n"), F.lit(1))).otherwise(expect(F.lit(0.0), F.lit(0)))))
    past = d.filter("ref")
    f = past.groupBy("key").agg(F.percentile("n", 0.5).alias("usual"), F.count(F.lit(1)).alias("ref_days"), F.sum(F.col("expected") * F.col("expected")).alias("num"), F.sum((F.col("n") - F.col("expected")) * (F.col("n") - F.col("expected")) - F.col("n")).alias("den"))
    spread = day_spread(past.select("key", "expected", F.col("n").alias("total")), "key")
    f = f.join(spread, "key").withColumn("cv2", F.greatest(1 / _size(F.col("num"), F.col("den")), F.expm1(F.col("sigma") * F.col("sigma")))).filter(F.col("usual") >= LEAST_MEDIAN)
    r = d.filter("not ref").withColumn("span", F.explode(F.array(*map(F.lit, SPANS)))).filter(F.col("day") > F.col("last") - F.col("span"))
    r = r.groupBy("key", "span").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("observed"), F.sum("expected").alias("mean"), F.sum(F.col("expected") * F.col("expected")).alias("sq"), F.percentile("n", 0.5).alias("now"), F.collect_list("expected").alias("each"))
    seven = F.col("span") == SPANS[-1]
    r = r.filter(F.when(seven, F.col("days") >= 5).otherwise(F.col("days") >= F.greatest(F.lit(2), F.col("span") - 2)) & (F.col("mean") > 0)).join(f, "key").join(keys.select("key", "k", "pi_off", "pi_low"), "key")
    ratio = F.col("observed") / F.col("mean")
    r = r.withColumn("ratio", ratio).filter(F.when(seven, (ratio < DECLINE_RATIO) & (F.col("now") < DECLINE_RATIO * F.col("usual"))).otherwise(ratio < DROP_RATIO))
    rows = r.select(
        "key", "span", "ratio", "observed", "mean", (F.col("k") * 24.0 * F.col("days")).alias("size"), F.sqrt(F.log1p(F.col("sq") * F.col("cv2") / (F.col("mean") * F.col("mean")))).alias("sigma"), (F.col("ref_days") - 1.0).alias("dof"),
        F.greatest("pi_off", "pi_low").alias("pi"), F.size(F.filter("each", lambda e: F.round(e, 9) >= F.round(F.greatest(F.lit(rhythm.ELIGIBLE), 0.1 * F.col("mean")), 9))).cast("long").alias("low_days"),
    )
    p = lower_tail(rows, ["key", "span", "ratio"]).withColumn("log_p", F.least(F.lit(0.0), F.col("log_p") + math.log(len(SPANS))))
    return p.groupBy("key").agg(F.min_by(F.struct("span", "ratio", "log_p"), F.struct("log_p", "span")).alias("x")).select("key", "x.*")


def alarms(counts: DataFrame, spine: DataFrame, end: int, budget: float = BUDGET) -> DataFrame:
    """(key, gap_h, log_p0, drop_effect, drop_log_p, decline_ratio, decline_log_p, status) of every key with a model: silent, drop, decay or ok, at a
    level that shares ``budget`` false alarms among all keys. A key that has sent nothing for half of its drop's window, or since its change
    point, is silent rather than a drop."""
    s, keys, days = fit(counts, spine, end)
    g = silent(s, keys, spine, end, stays(days, s, keys))
    x = dropped(counts, s, keys, spine, end).withColumnsRenamed({"log_p": "drop_log_p", "effect": "drop_effect"})
    y = declined(days, keys).withColumnsRenamed({"log_p": "decline_log_p", "ratio": "decline_ratio"})
    level = keys.agg(F.log(F.least(F.lit(0.5), F.lit(budget) / F.greatest(F.lit(1), F.count(F.lit(1))))).alias("level"))
    # each part ends in a table of one row for a key: in one plan they take more memory of the driver than their rows do
    g, x, y = checkpointed(g), checkpointed(x), checkpointed(y)
    d = g.join(x, "key", "left").join(y, "key", "left").join(F.broadcast(level))
    quiet = F.coalesce((F.col("observed") <= 0) | (F.col("gap_h") >= F.col("hours") / 2) | (F.col("gap_h") >= 0.5 * (F.lit(end) - F.col("onset_h"))), F.lit(True))
    below = lambda c: F.coalesce(F.col(c) < F.col("level"), F.lit(False))
    status = F.when(below("log_p0") & (quiet | ~below("drop_log_p")), "silent").when(below("drop_log_p"), "drop").when(below("decline_log_p"), "decay").otherwise("ok")
    return d.select("key", "gap_h", "log_p0", "drop_effect", "drop_log_p", "decline_ratio", "decline_log_p", status.alias("status"))
