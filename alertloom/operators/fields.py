"""Field health: how often each field is there, and fields that vanished."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEFORE, AFTER, MIN_EVENTS = 0.95, 0.05, 100


def presence(events: DataFrame, fields: list[str], by: tuple[str, ...] = ("ls", "day")) -> DataFrame:
    """Per key and field: events, and events that have the field. One pass; counts combine before the shuffle."""
    wide = events.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), *[F.count(f).alias(f"has_{f}") for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"has_{f}").alias("present")) for f in fields])
    return wide.select(*by, "events", F.explode(pairs).alias("x")).select(*by, "events", F.col("x.field").alias("field"), F.col("x.present").alias("present"))


def lost(p: DataFrame) -> DataFrame:
    """Fields whose days end in a run of absence: at least BEFORE of the events before it, at most AFTER in it, MIN_EVENTS each side."""
    w = Window.partitionBy("ls", "field")
    d = p.withColumn("there", F.col("present") > AFTER * F.col("events"))
    d = d.withColumn("last_there", F.max(F.when(F.col("there"), F.col("day"))).over(w))
    side = d.groupBy("ls", "field", "last_there").agg(
        *[F.sum(F.when(F.col("day") <= F.col("last_there"), F.col(c)).otherwise(0)).alias(f"{c}_before") for c in ("events", "present")],
        *[F.sum(F.when(F.col("day") > F.col("last_there"), F.col(c)).otherwise(0)).alias(f"{c}_after") for c in ("events", "present")],
    )
    ok = (F.col("events_before") >= MIN_EVENTS) & (F.col("events_after") >= MIN_EVENTS) & (F.col("present_before") >= BEFORE * F.col("events_before")) & (F.col("present_after") <= AFTER * F.col("events_after"))
    return side.withColumn("lost", F.coalesce(ok, F.lit(False)))
