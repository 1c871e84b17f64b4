"""Days and hours of a series: sane times, spikes, duty, days off, quiet hours, and counts near an hour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The first and last second (exclusive) that an event's time can have: 2000-01-01 and 2100-01-01.
SANE = (946_684_800, 4_102_444_800)
# A spike is a day over so many times the median active day, judged from so many active days on.
SPIKE_FACTOR, SPIKE_DAYS = 3.0, 4
# Shares of active hours, of active days and of events in business hours (7 to 18) that make a duty class.
ALWAYS_ON, WORKING, BUSINESS, BUSINESS_HOURS = 0.9, 0.5, 0.7, (7, 18)
# A day should have events if so many are expected.
ELIGIBLE = 3.0
SPARK_DAYS, TOP = 28, 5


def in_window(ts: Column, since: int | None, until: int | None) -> Column:
    """in, early, late, insane or none: where a time lies towards [since, until); whoever counts tells the excluded from the kept."""
    s = F.unix_seconds(ts)
    state = F.when(s.isNull(), "none").when((s < SANE[0]) | (s >= SANE[1]), "insane")
    state = state.when(s < since, "early") if since is not None else state
    state = state.when(s >= until, "late") if until is not None else state
    return state.otherwise("in")


def spike_factors(days: DataFrame) -> DataFrame:
    """(key, day, n, factor) of ``days`` (key, day, n): 1, or for a spike the cap's share of it.

    A day above SPIKE_FACTOR medians of the active days is a spike unless another of the same weekday reaches half of it. The largest and
    second of a weekday tell that, so days aren't paired.
    """
    active = days.groupBy("key").agg(F.percentile(F.when(F.col("n") > 0, F.col("n")), 0.5).alias("median"), F.count_if(F.col("n") > 0).alias("active"))
    weekday = F.pmod(F.col("day") + 3, F.lit(7))
    top = days.withColumn("dow", weekday).groupBy("key", "dow").agg(F.max("n").alias("most"), F.max_by("day", F.struct("n", "day")).alias("at"))
    second = days.withColumn("dow", weekday).join(top.select("key", "dow", "at"), ["key", "dow"]).filter("day <> at").groupBy("key", "dow").agg(F.max("n").alias("next"))
    d = days.withColumn("dow", weekday).join(active, "key").join(top.select("key", "dow", "most", "at"), ["key", "dow"]).join(second, ["key", "dow"], "left")
    cap = SPIKE_FACTOR * F.col("median")
    other = F.when(F.col("day") == F.col("at"), F.col("next")).otherwise(F.col("most"))
    spike = (F.col("active") >= SPIKE_DAYS) & (F.col("n") > cap) & ~F.coalesce(other >= 0.5 * F.col("n"), F.lit(False))
    return d.select("key", "day", "n", F.when(spike, cap / F.col("n")).otherwise(1.0).alias("factor"))


def duty(hours: DataFrame) -> DataFrame:
    """(key, duty) of a dense series ``hours`` (key, h, n): always_on, business_hours or intermittent."""
    hod, day = F.pmod("h", F.lit(24)), F.floor(F.col("h") / 24)
    per_day = hours.groupBy("key", day.alias("day")).agg(F.sum("n").alias("n"), F.count_if(F.col("n") > 0).alias("active"), F.count(F.lit(1)).alias("hours"), F.sum(F.when(hod.between(*BUSINESS_HOURS), F.col("n")).otherwise(0)).alias("business"))
    s = per_day.groupBy("key").agg(F.sum("n").alias("n"), F.sum("active").alias("active"), F.sum("hours").alias("hours"), F.sum("business").alias("business"), F.count_if(F.col("n") > 0).alias("active_days"), F.count(F.lit(1)).alias("days"))
    kind = F.when(F.col("active") >= ALWAYS_ON * F.col("hours"), "always_on").when((F.col("active_days") >= WORKING * F.col("days")) & (F.col("business") >= BUSINESS * F.col("n")), "business_hours").otherwise("intermittent")
    return s.filter("n > 0").select("key", "n", "active", "hours", "active_days", "days", kind.alias("duty"))


def islands(rows: DataFrame, keys: list[str], at: str, on: Column) -> DataFrame:
    """Runs of consecutive rows of a key, ordered by ``at``, on which ``on`` holds: (keys, first, last, length, censored); a run up to a
    key's last row is censored."""
    w = Window.partitionBy(*keys).orderBy(at)
    d = rows.select(*keys, at, on.alias("on"), F.lead(F.lit(1)).over(w).isNull().alias("end"), F.row_number().over(w).alias("i"))
    d = d.filter("on").withColumn("island", F.col("i") - F.row_number().over(w))
    return d.groupBy(*keys, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("length"), F.bool_or("end").alias("censored")).drop("island")


def days_off(days: DataFrame) -> DataFrame:
    """Runs of eligible days without events of ``days`` (key, day, n, expected); a day is eligible if ELIGIBLE events are expected."""
    return islands(days.filter(F.col("expected") >= ELIGIBLE), ["key"], "day", F.col("n") <= 0)


def quiet_hours(hours: DataFrame) -> DataFrame:
    """Runs of hours without events within a day, after a key's first event, of a dense series (key, h, n)."""
    w = Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    d = hours.withColumn("seen", F.max(F.col("n") > 0).over(w)).filter("seen").withColumn("day", F.floor(F.col("h") / 24))
    return islands(d, ["key", "day"], "h", F.col("n") <= 0)


def near(counts: DataFrame, asked: DataFrame, hours: int) -> DataFrame:
    """``asked`` (key, h) with ``n``: the count of ``counts`` (key, h, n) of its key within ``hours`` of it.

    Both sides lie on one line of (key, h): prefix sums at the last hour in and at the last hour before give the count as a difference, so
    an hour asked for costs two rows, however wide the window.
    """
    points = counts.select("key", F.col("h").alias("at"), "n", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("h"))
    ends = asked.select("key", F.explode(F.array(F.struct((F.col("h") - hours - 1).alias("at"), F.lit(-1).alias("kind")), F.struct((F.col("h") + hours).alias("at"), F.lit(1).alias("kind")))).alias("x"), "h")
    line = points.unionByName(ends.select("key", "x.at", F.lit(0).cast("long").alias("n"), "x.kind", "h"))
    w = Window.partitionBy("key").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    upto = line.withColumn("upto", F.sum("n").over(w)).filter("kind <> 0")
    return upto.groupBy("key", "h").agg(F.sum(F.col("upto") * F.col("kind")).alias("n"))


def in_calendar(days: DataFrame, calendar: DataFrame) -> DataFrame:
    """``days`` with ``excluded``: whether a period of ``calendar`` (start_day, end_day, both included) holds the day.

    Periods become their days, once each: an equal join instead of a range.
    """
    out = calendar.select(F.explode(F.sequence("start_day", "end_day")).alias("day")).distinct().withColumn("excluded", F.lit(True))
    return days.join(out, "day", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def sparkline(days: DataFrame, last: int) -> DataFrame:
    """(key, line): the counts of the SPARK_DAYS days up to ``last``, zeros for days without rows."""
    d = days.filter((F.col("day") > last - SPARK_DAYS) & (F.col("day") <= last))
    held = F.map_from_entries(F.collect_list(F.struct("day", "n")))
    span = F.sequence(F.lit(last - SPARK_DAYS + 1).cast("long"), F.lit(last).cast("long"))
    return d.groupBy("key").agg(held.alias("held")).select("key", F.transform(span, lambda x: F.coalesce(F.element_at("held", x), F.lit(0))).alias("line"))


def top_share(counts: DataFrame, k: int = TOP) -> DataFrame:
    """One row: the share of all events that the ``k`` largest keys of ``counts`` (key, n) have."""
    top = counts.orderBy(F.desc("n"), "key").limit(k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("top"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("keys")).join(F.broadcast(top)).withColumn("share", F.when(F.col("n") > 0, F.col("top") / F.col("n")))
