"""Side tables: analyst verdicts, agent inventories, and the dates in rotated paths."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import scalars as fn
from alertloom.sources import documents

# Headers and verdicts under their other names.
HEADERS = {"alert": "alert_id", "id": "alert_id", "event_id": "alert_id", "rule": "rule_id", "disposition": "verdict", "status": "verdict", "closed": "closed_at", "customer": "tenant"}
VERDICTS = {"true positive": "tp", "true_positive": "tp", "false positive": "fp", "false_positive": "fp", "benign": "btp", "benign true positive": "btp", "dup": "duplicate", "open": "untriaged", "": "untriaged"}
KNOWN = ("tp", "fp", "btp", "duplicate", "untriaged")
# Months as they stand in rotated paths.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ROTATED = re.compile(r"/(\d{4})/(" + "|".join(MONTHS) + r")/[^/]*-(\d{2})(?:-\d{3})?\.json(?:\.gz)?$")


def dispositions(spark: SparkSession, path: str, tenant: str | None = None) -> DataFrame:
    """alert_id, rule_id, field, value, verdict, closed_s, scope, bad of every row; a row without a known verdict or any scope is bad.

    Scope is alert, condition or rule, the narrowest that the row names. Rows of another tenant are left out, in any case of its name.
    """
    d = documents.csv(spark, path)
    d = d.toDF(*[HEADERS.get(c.lower(), c.lower()) for c in d.columns])
    for c in ("alert_id", "rule_id", "field", "value", "verdict", "closed_at", "tenant"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    v = F.lower(F.trim(F.coalesce("verdict", F.lit(""))))
    for a, b in VERDICTS.items():
        v = F.when(F.lower(F.trim(F.coalesce("verdict", F.lit("")))) == a, b).otherwise(v)
    scope = F.when(F.col("alert_id").isNotNull(), "alert").when(F.col("rule_id").isNotNull() & F.col("field").isNotNull() & F.col("value").isNotNull(), "condition").when(F.col("rule_id").isNotNull(), "rule")
    if tenant is not None:
        d = d.filter(F.col("tenant").isNull() | (F.lower("tenant") == tenant.lower()))
    return d.select("alert_id", "rule_id", "field", "value", v.alias("verdict"), F.unix_seconds(fn.any_time(F.col("closed_at"))).alias("closed_s"), scope.alias("scope"), (~v.isin(*KNOWN) | scope.isNull()).alias("bad"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """agent, name, status, keepalive_s, platform of an inventory file: a whole response, its data, or a bare list."""
    raw = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    items = F.coalesce(F.try_variant_get("v", "$.data.affected_items", "array<variant>"), F.try_variant_get("v", "$.affected_items", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))
    d = raw.select(F.explode(items).alias("x"))
    get = lambda p: fn.absent(F.try_variant_get("x", f"$.{p}", "string"))
    return d.select(get("id").alias("agent"), get("name").alias("name"), F.lower(get("status")).alias("status"), F.unix_seconds(fn.any_time(get("lastKeepAlive"))).alias("keepalive_s"), F.lower(get("os.platform")).alias("platform"))


def rotated_day(path: str) -> date | None:
    """The day that a rotated file's path names."""
    m = ROTATED.search(path)
    try:
        return date(int(m[1]), MONTHS.index(m[2]) + 1, int(m[3])) if m else None
    except ValueError:
        return None


def prune(paths: list[str], since: date | None, until: date | None, slack: int = 1) -> list[str]:
    """Paths whose day may lie within [since, until), ``slack`` days wider for unknown offsets; a plain file beats its compressed twin."""
    have = set(paths)
    keep = []
    for p in paths:
        day = rotated_day(p)
        out = day is not None and ((since is not None and day < since - timedelta(days=slack)) or (until is not None and day > until + timedelta(days=slack)))
        if not out and not (p.endswith(".gz") and p.removesuffix(".gz") in have):
            keep.append(p)
    return keep
