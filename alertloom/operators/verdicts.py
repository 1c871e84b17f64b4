"""Verdicts of analysts against alerts and candidate conditions, trust, and what a demotion would gain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions import context

# The level of a demoted alert, and the level from which analysts see one.
DEMOTED, TRIAGE = 3, 7
KINDS = ("tp", "fp", "btp")


def confirmed(fields: DataFrame, tps: DataFrame) -> DataFrame:
    """(event_id, tp) pairs: true positives ``tps`` (tp, field, value) that apply to events ``fields`` (event_id, field, value).

    Values meet trimmed and in lower case, fields under every name they may mean; a null never meets. Each true positive becomes one row a
    field, so that it is an equal join, and an event counts once for one.
    """
    said = tps.select("tp", F.explode(context.meant_fields(F.col("field"))).alias("field"), F.lower(F.trim("value")).alias("value")).distinct()
    held = fields.select("event_id", "field", F.lower(F.trim("value")).alias("value"))
    return held.join(said, ["field", "value"]).select("event_id", "tp").distinct()


def covered_verdicts(candidates: DataFrame, alerts: DataFrame, fields: list[str]) -> DataFrame:
    """Per candidate: the verdicts on alerts that hold all its conditions, and whether a true positive forbids it.

    ``candidates`` is (candidate, conditions: array of field and value), ``alerts`` (verdict and ``fields``). Alerts count first, by equal
    fields, so a candidate meets combinations of values, not alerts; it meets them at the condition that fewest alerts hold.
    """
    combos = alerts.groupBy(*fields).agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in KINDS])
    held = combos.withColumn("held", F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    sizes = held.select(F.explode("held").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("size"))
    at = candidates.filter(F.size("conditions") > 0).select("candidate", "conditions", F.explode("conditions").alias("at")).join(sizes, "at", "left")
    rare = at.groupBy("candidate").agg(F.any_value("conditions").alias("conditions"), F.min_by("at", F.struct(F.coalesce("size", F.lit(0)), "at")).alias("at"))
    met = held.select(*KINDS, "held", F.explode("held").alias("at")).join(rare, "at").filter(F.size(F.array_except("conditions", "held")) == 0)
    n = met.groupBy("candidate").agg(*[F.sum(v).alias(v) for v in KINDS])
    out = candidates.select("candidate").join(n, "candidate", "left").na.fill(0, list(KINDS))
    return out.withColumn("vetoed", F.col("tp") > 0)


def gain(top: Column, analyst: Column) -> Column:
    """Why a demotion would change nothing: demoted (all is that low already), unseen (no analyst sees them), or null: it would."""
    return F.when(top <= DEMOTED, "demoted").when(analyst == 0, "unseen")
