"""Runs of a scheduled check: heartbeats, what is sent, what is sent again, and zones of samples without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators.incidents import rank

KEPT_S = 90 * 86400
# Kinds of notices, those that matter most first.
NOTICES = ("opened", "regressed", "escalated", "acceptance_expired", "flapping", "reminder", "resolved")
# Samples a source needs, the quantile they are judged at, steps of zones, the least difference, and the tolerance.
SAMPLES, ANCHOR, STEP_S, LEAST_S, TOLERANCE_S = 20, 0.01, 900, 1800, 120


def heartbeats(beats: DataFrame, kept_s: int = KEPT_S) -> DataFrame:
    """Per tenant: the last beat of ``beats`` (tenant, at_s, ok), the last good and the last bad one, and how many are kept.

    A beat goes once a later one of its tenant is more than ``kept_s`` after it.
    """
    last = beats.groupBy("tenant").agg(F.max("at_s").alias("last_s"))
    live = beats.join(last, "tenant").filter(F.col("at_s") >= F.col("last_s") - kept_s)
    when = lambda ok: F.max(F.when(F.col("ok") if ok else ~F.col("ok"), F.col("at_s")))
    return live.groupBy("tenant").agg(F.max("at_s").alias("last_s"), when(True).alias("ok_s"), when(False).alias("failed_s"), F.count(F.lit(1)).alias("kept"))


def sent(notices: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` gravest of ``notices`` (place, kind, severity; a message's own limit), to be told in the order of ``place``."""
    order = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, NOTICES)), F.col("kind")), F.lit(0)), F.lit(99))
    return notices.orderBy(F.desc(rank("severity")), order, "place").limit(limit).orderBy("place")


def handed_back(states: DataFrame, notices: DataFrame, undelivered: DataFrame) -> DataFrame:
    """``states`` (fp, phase, notified_s) after notices that did not arrive: what was known before them holds again.

    ``notices`` is (run, fp, at_s, was_phase, was_s), ``undelivered`` (run, fp), a null fp for all of a run. A finding that a later run told
    stays as it is. Doing it twice changes nothing.
    """
    whole = undelivered.filter("fp is null").select("run").distinct()
    lost = notices.join(whole, "run", "left_semi").unionByName(notices.join(undelivered.filter("fp is not null"), ["run", "fp"], "left_semi"))
    was = lost.groupBy(F.col("fp").alias("of"), "at_s").agg(F.max_by(F.struct("was_phase", "was_s"), "run").alias("was"))
    d = states.join(was, (F.col("fp") == F.col("of")) & (F.col("notified_s") == F.col("at_s")), "left")
    back = F.col("was").isNotNull()
    return d.select("fp", F.when(back, F.col("was.was_phase")).otherwise(F.col("phase")).alias("phase"), F.when(back, F.col("was.was_s")).otherwise(F.col("notified_s")).alias("notified_s"), back.alias("again"))


def zone_offset(anchor: Column, samples: Column) -> Column:
    """Seconds that samples without a zone are off: the quarter of an hour nearest to their first percentile, or 0 if it is small or far."""
    steps = F.bround(anchor / STEP_S) * STEP_S
    real = (samples >= SAMPLES) & (F.abs(steps) >= LEAST_S) & (F.abs(anchor - steps) <= TOLERANCE_S)
    return F.when(real, steps).otherwise(0.0)


def zoned_lags(lags: DataFrame) -> DataFrame:
    """``lags`` (source, lag_s, naive) with ``offset_s`` taken off those without a zone.

    The first percentile is exact: of counts by whole seconds, so a source of many samples is no group in memory.
    """
    d = lags.filter("naive").groupBy("source", "lag_s").agg(F.count(F.lit(1)).alias("n"))
    per = d.groupBy("source").agg(F.percentile("lag_s", F.lit(ANCHOR), F.col("n")).alias("anchor"), F.sum("n").alias("samples"))
    per = per.select("source", zone_offset(F.col("anchor"), F.col("samples")).alias("offset_s"))
    out = lags.join(per, "source", "left")
    return out.withColumn("offset_s", F.when(F.col("naive"), F.coalesce("offset_s", F.lit(0.0))).otherwise(0.0)).withColumn("lag_s", F.col("lag_s") - F.col("offset_s"))
