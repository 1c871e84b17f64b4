"""What a source usually does: its local clock, an hour-of-week model beside the profile, days off and how long they last, outages of many."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Events that the profile counts for in a slot of the week.
SLOT_EVENTS = 1.0
# Bounds of a prior's weight in days, days that a rate of a peer needs, peers needed, and the tail that makes a prior implausible.
WEIGHTS, PEER_DAYS, PEERS, TAIL = (2.0, 200.0), 5, 3, 0.01
# Days of the curve of staying off, and the runs that the value before counts for in each.
CURVE_DAYS, CURVE_RUNS = 14, 2.0
# Share of a parent's deficit that its children explain; an outage of all: seconds, share, and sources that are always on or any.
EXPLAINED, OUTAGE_S, OUTAGE_SHARE, OUTAGE_STEADY, OUTAGE_ANY = 0.7, 7200, 0.3, 3, 5

# What a quiet run must tell, runs needed beside one, half of the 90 % quantile of chi-square, and the least theta.
INFORMATIVE, RUNS, NEAR, LEAST_THETA = 0.5, 5, 1.355, 0.01
#: Values of theta that are looked at, from one in a million to 1 in steps of 0.34 %.
THETAS = np.exp(np.log(1e-6) * (1 - np.arange(4097) / 4096))


def clock(spark: SparkSession, first: int, last: int, zone: str, off: DataFrame) -> DataFrame:
    """One row per UTC hour in [first, last] (hours since 1970): slot of the local week (Monday 0 is 0), local day (days since 1970), whether
    ``off`` (day) holds that day, and whether the day is regular: whole, of 24 hours from 0 to 23.

    A year is 8,760 rows; Spark broadcasts it by its size. The middle of the hour tells, so zones off by half an hour have one answer.
    """
    local = F.from_utc_timestamp(F.timestamp_seconds(F.col("h") * 3600 + 1800), zone)
    d = spark.range(first, last + 1).select(F.col("id").alias("h")).withColumn("local", local)
    d = d.select("h", (F.weekday("local") * 24 + F.hour("local")).cast("long").alias("slot"), F.datediff(F.to_date("local"), F.lit("1970-01-01")).cast("long").alias("day"), F.hour("local").alias("hod"))
    days = d.groupBy("day").agg(((F.count(F.lit(1)) == 24) & (F.count_distinct("hod") == 24)).alias("regular"))
    return d.join(days, "day").join(off.select("day", F.lit(True).alias("off")).distinct(), "day", "left").select("h", "slot", "day", F.coalesce("off", F.lit(False)).alias("off"), "regular")


def alternate(b: DataFrame, weights: DataFrame) -> DataFrame:
    """(key1, slot, rate, alt, low) of a baseline (key1, h, n, slot) and its profile (key1, hod, weight): events an hour by the profile, by the
    key's own counts of that hour of the week with the profile as SLOT_EVENTS events before them, and the lower of both.

    A weekly job makes the profile expect it every day; the own counts don't, so taking the lower raises no alarm for that.
    """
    w = Window.partitionBy("key1")
    s = b.groupBy("key1", "slot").agg(F.sum("n").alias("c"), F.count(F.lit(1)).alias("m"))
    s = s.withColumn("mean", F.sum("c").over(w) / F.sum("m").over(w)).withColumn("hod", F.pmod("slot", F.lit(24)))
    s = s.join(weights, ["key1", "hod"]).withColumn("rate", F.col("mean") * F.col("weight"))
    own = F.when(F.col("rate") > 0, (F.col("c") + SLOT_EVENTS) / (F.col("m") + SLOT_EVENTS / F.col("rate"))).otherwise(0.0)
    s = s.withColumn("own", own).withColumn("alt", F.when(F.sum("own").over(w) > 0, F.col("mean") * F.col("own") * F.count(F.lit(1)).over(w) / F.sum("own").over(w)))
    return s.select("key1", "slot", "rate", "alt", F.least("rate", "alt").alias("low"))


def binomial_tail(events: Column, days: Column, rate: Column) -> Column:
    """P(at most ``events`` of ``days``) for a rate in (0, 1), term by term from none on."""
    step = lambda a, j: F.struct((a["t"] * (days - j + 1) / j * rate / (1 - rate)).alias("t"), (a["s"] + a["t"] * (days - j + 1) / j * rate / (1 - rate)).alias("s"))
    none = F.pow(1 - rate, days).cast("double")
    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), events), F.struct(none.alias("t"), none.alias("s")), step, lambda a: a["s"])
    return F.when(events <= 0, none).otherwise(tail)


def day_rates(days: DataFrame, peers: list[str]) -> DataFrame:
    """``days`` (key, tier, peers..., events, days) with ``rate``: how often a key has a day off, its own record and its peers' before it.

    The peers' weight comes from how much their rates differ beyond chance. A critical key, or one whose record its peers' rate makes
    unlikely, speaks for itself. Groups are aggregates, so their size is no matter.
    """
    total = days.groupBy(*peers).agg((F.sum("events") / F.nullif(F.sum("days"), F.lit(0))).alias("mean"))
    own = days.filter(F.col("days") >= PEER_DAYS).groupBy(*peers).agg(F.count(F.lit(1)).alias("m"), F.var_samp(F.col("events") / F.col("days")).alias("var"), F.avg(1 / F.col("days")).alias("inv"))
    p = total.join(own, peers, "left").withColumn("mean", F.coalesce("mean", F.lit(0.0))).withColumn("m", F.coalesce("m", F.lit(0)))
    between = F.col("var") - F.col("mean") * (1 - F.col("mean")) * F.col("inv")
    ratio = F.col("mean") * (1 - F.col("mean")) / between - 1
    weight = F.when((F.col("mean") <= 0) | (F.col("mean") >= 1), WEIGHTS[1]).when(F.col("m") < PEERS, WEIGHTS[0]).when(between <= 0, WEIGHTS[1]).otherwise(F.greatest(F.lit(WEIGHTS[0]), F.least(F.lit(WEIGHTS[1]), ratio)))
    d = days.join(p.select(*peers, "mean", weight.alias("weight")), peers)
    inside = (F.col("mean") > 0) & (F.col("mean") < 1) & (F.col("days") > 0)
    alone = (F.col("tier") == "critical") | (inside & (binomial_tail(F.col("events"), F.col("days"), F.col("mean")) < TAIL)) | ((F.col("mean") >= 1) & (F.col("events") < F.col("days")))
    mean, w = F.when(alone, 0.0).otherwise(F.col("mean")), F.when(alone, WEIGHTS[0]).otherwise(F.col("weight"))
    return d.withColumn("rate", (F.col("events") + w * mean) / (F.col("days") + w)).drop("mean", "weight")


def staying_off(runs: DataFrame, rates: DataFrame, group: str) -> DataFrame:
    """(group, after, stay): how likely one more day off is after 1 to CURVE_DAYS of them, from runs (group, length, censored).

    A run that still goes on counts only for the days it has shown. Each value starts from the one before and never falls below it; the first
    starts from the overall rate, which starts from ``rates`` (group, rate). Runs count by length first.
    """
    n = runs.groupBy(group, "length").agg(F.count(F.lit(1)).alias("all"), F.count_if(~F.col("censored")).alias("ended"))
    overall = n.groupBy(group).agg(F.sum((F.col("length") - 1) * F.col("all")).alias("on"), F.sum("ended").alias("over")).join(rates, group)
    overall = overall.select(group, ((F.col("on") + CURVE_RUNS * F.col("rate")) / (F.col("on") + F.col("over") + CURVE_RUNS)).alias("start"))
    at = F.explode(F.sequence(F.lit(1), F.lit(CURVE_DAYS))).alias("after")
    longer = F.when(F.col("length") > F.col("after"), F.col("all")).otherwise(0)
    points = n.select("*", at).groupBy(group, "after").agg(F.sum(longer).alias("more"), F.sum(longer + F.when(F.col("length") == F.col("after"), F.col("ended")).otherwise(0)).alias("risk"))
    line = points.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("after", "more", "risk"))).alias("line")).join(overall, group)
    # each value needs the one before: a fold over the CURVE_DAYS points that keeps what it has seen
    step = lambda a, x: F.array_append(a, F.greatest(F.element_at(a, -1), (x["more"] + CURVE_RUNS * F.element_at(a, -1)) / (x["risk"] + CURVE_RUNS)))
    return line.select(group, F.posexplode(F.aggregate("line", F.array("start"), step)).alias("after", "stay")).filter("after > 0").select(group, F.col("after").cast("long").alias("after"), "stay")


def outage(onsets: DataFrame, sources: int) -> DataFrame:
    """``onsets`` (key, at_s, steady) with ``outage``: whether a key fell quiet in the fullest OUTAGE_S seconds, if so many did that all failed.

    Counts per second come first; the window runs over the distinct seconds of each block of two spans, so no task sees the whole line.
    """
    n = onsets.groupBy("at_s").agg(F.count(F.lit(1)).alias("n"), F.count_if("steady").alias("steady"))
    # a span that starts at a second lies in that second's block or reaches into the next: rows go to their own and the block before
    block = F.floor(F.col("at_s") / OUTAGE_S)
    d = n.withColumn("own", block).select("*", F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("block"))
    w = Window.partitionBy("block").orderBy("at_s").rangeBetween(0, OUTAGE_S)
    spans = d.select("at_s", "own", "block", F.sum("n").over(w).alias("n"), F.sum("steady").over(w).alias("steady")).filter("own = block")
    full = spans.filter((F.col("n") >= OUTAGE_SHARE * sources) & ((F.col("steady") >= OUTAGE_STEADY) | (F.col("n") >= OUTAGE_ANY)))
    best = full.orderBy(F.desc("n"), "at_s").limit(1).select(F.col("at_s").alias("from_s"))
    d = onsets.join(F.broadcast(best), F.col("at_s").between(F.col("from_s"), F.col("from_s") + OUTAGE_S), "left")
    return d.select(*onsets.columns, F.col("from_s").isNotNull().alias("outage"))


def explained(parents: DataFrame, children: DataFrame) -> DataFrame:
    """Parents (parent, deficit) with the share of their deficit that anomalous children (parent, child, deficit) carry, and whether they
    explain it: at least EXPLAINED of it. A surplus of a child counts for nothing; a parent without a deficit isn't explained."""
    have = children.groupBy("parent").agg(F.sum(F.greatest(F.lit(0.0), F.col("deficit"))).alias("have"), F.count(F.lit(1)).alias("children"))
    d = parents.join(have, "parent", "left").na.fill(0, ["have", "children"])
    share = F.when(F.col("deficit") > 0, F.col("have") / F.col("deficit"))
    return d.select("parent", "deficit", "children", share.alias("share"), F.coalesce((F.col("children") > 0) & (share >= EXPLAINED), F.lit(False)).alias("explained"))


def quiet_costs(hours: DataFrame, within_day: bool = False) -> DataFrame:
    """Quiet runs of ``hours`` (key, h, n, cost, day) after a key's first event: (key, first, on, end): what it costs the model that a run went
    on after its first hour, and what it would have cost to go on once more, 0 for a run whose end isn't seen.

    With ``within_day`` a run is followed to the end of its first day only: whole days off have a model of their own.
    """
    w = Window.partitionBy("key").orderBy("h")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    d = hours.withColumn("events", F.count_if(F.col("n") > 0).over(past)).filter("events > 0")
    # all hours of a run share the number of events' hours before it, which is the hour before its first
    d = d.withColumn("end", F.when(F.col("n") > 0, F.col("cost"))).withColumn("end_day", F.when(F.col("n") > 0, F.col("day")))
    d = d.withColumn("next_end", F.lead("end").over(w)).withColumn("next_day", F.lead("end_day").over(w)).filter("n <= 0")
    r = Window.partitionBy("key", "events")
    d = d.withColumn("first", F.min("h").over(r)).withColumn("first_day", F.min("day").over(r))
    same = (F.col("day") == F.col("first_day")) if within_day else F.lit(True)
    ends = F.col("next_end").isNotNull() & ((F.col("next_day") == F.col("first_day")) if within_day else F.lit(True))
    return d.groupBy("key", "first").agg(F.sum(F.when((F.col("h") > F.col("first")) & same, F.col("cost")).otherwise(0.0)).alias("on"), F.max(F.when(ends, F.col("next_end")).otherwise(0.0)).alias("end"))


@F.pandas_udf(DoubleType())
def likely_theta(on: pd.Series, ends: pd.Series) -> pd.Series:
    """The largest theta of THETAS whose likelihood is near the best: exp(-theta * on) for going on, 1 - exp(-theta * end) for each end.

    The logarithm is concave, so halving finds the best place and then the last one near it.
    """

    def one(on: float, ends: np.ndarray) -> float:
        def ll(i: int) -> float:
            return -THETAS[i] * on + float(np.log(np.maximum(-np.expm1(-THETAS[i] * ends), 1e-300)).sum())

        top = len(THETAS) - 1
        best = bisect.bisect_left(range(top), True, key=lambda i: ll(i + 1) <= ll(i))
        peak = ll(best)
        if peak - ll(top) <= NEAR:
            return 1.0
        last = bisect.bisect_left(range(top + 1), True, lo=best, key=lambda i: peak - ll(i) > NEAR) - 1
        return max(LEAST_THETA, float(THETAS[last]))

    return pd.Series([one(a, np.asarray(b, float)) for a, b in zip(on, ends, strict=True)], dtype="float64")


def burstiness(quiet: DataFrame) -> DataFrame:
    """(key, runs, theta) of ``quiet`` (key, first, on, end): an hour more of silence is as likely as the model's chance to the power theta.

    Runs that the model expected less than INFORMATIVE in say nothing; RUNS and one more are needed, else there is no row and theta is 1. The
    longest tenth, one at least, count no longer than the next and without an end, so one outage is no habit. A key has at most as many runs
    as its baseline has hours.
    """
    w = Window.partitionBy("key")
    d = quiet.withColumn("on", F.round("on", 9)).filter(F.col("on") + F.col("end") >= INFORMATIVE)
    d = d.withColumn("runs", F.count(F.lit(1)).over(w)).filter(F.col("runs") > RUNS).withColumn("place", F.row_number().over(w.orderBy("on", "first")))
    kept = F.col("place") <= F.col("runs") - F.greatest(F.lit(1), F.floor(F.col("runs") / 10))
    d = d.withColumn("cap", F.max(F.when(kept, F.col("on"))).over(w)).withColumn("kept", kept)
    per = d.groupBy("key", "runs").agg(F.sum(F.least("on", "cap")).alias("on"), F.array_sort(F.collect_list(F.when(F.col("kept") & (F.col("end") > 0), F.col("end")))).alias("ends"))
    return per.select("key", "runs", likely_theta("on", "ends").alias("theta"))
