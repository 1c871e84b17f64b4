"""Queries over scopes of alerts, verdicts on rules, the order of rules, scans by rule and by window. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.cuts import lines_of
from alertloom.operators import cube, noise, rules, scopes
from alertloom.operators.alerts import alerts, r6, table
from alertloom.plans.cube_queries import _BASE, _CUBE, _SERIES, _fitted
from alertloom.plans.health_queries import _edges
from alertloom.plans.noise_queries import _CAND, WITH
from alertloom.sources import documents

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"{WITH} SELECT rule_id, src, ls, CASE WHEN k % 3 <> 0 THEN 'type' || (k % 5) END AS logon, count(*) AS n, count(*) FILTER (lvl >= 7) AS analyst FROM a WHERE src IS NOT NULL AND ls IS NOT NULL GROUP BY ALL")
def narrowest_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Host, channel and kind of logon, or host and channel where an alert names no logon."""
    logon = F.when(F.col("k") % 3 != 0, F.concat(F.lit("type"), F.col("k") % 5))
    return scopes.narrowest(alerts(spark, sf).withColumn("logon", logon), "src", "ls", "logon")


_STEADY = """w AS (SELECT min(s) AS s0, max(s) AS s1, min(d) AS d0, max(d) AS d1 FROM a), days AS (SELECT unnest(range(d0, d1 + 1)) AS d FROM w),
v AS (SELECT rule_id, ls AS value, count(*) AS n, count(DISTINCT d) AS present, min(s) AS first_s FROM a WHERE ls IS NOT NULL GROUP BY ALL),
pd AS (SELECT rule_id, ls AS value, d, count(*) AS n FROM a GROUP BY ALL),
sp AS (SELECT v.rule_id, v.value, max(coalesce(pd.n, 0)) AS peak, quantile_cont(coalesce(pd.n, 0), 0.5) AS mid FROM v CROSS JOIN days LEFT JOIN pd ON pd.rule_id = v.rule_id AND pd.value = v.value AND pd.d = days.d GROUP BY ALL),
st AS (SELECT rule_id, value, n, present, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, value) AS nth FROM v JOIN sp USING (rule_id, value), w
  WHERE n >= 10 AND first_s <= s0 + 0.25 * (s1 - s0) AND present >= 0.8 * (d1 - d0 + 1) AND peak < 5 * greatest(mid, 1) QUALIFY nth <= 10)"""


@query(f"{WITH}, {_STEADY} SELECT * FROM st")
def steady_values(spark: SparkSession, sf: str) -> DataFrame:
    return scopes.steady(alerts(spark, sf), "ls")


@query(f"{WITH}, {_STEADY} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, host) AS nth FROM (SELECT a.rule_id, src AS host, count(*) AS n FROM a JOIN st ON st.rule_id = a.rule_id AND st.value = ls WHERE src IS NOT NULL GROUP BY ALL)) WHERE nth <= 5")
def steady_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return scopes.steady_hosts(alerts(spark, sf), "src", "ls")


@query(f"""{WITH}, {_CAND}, rd AS (SELECT r.rule_id, days.day, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT rule_id FROM a) r CROSS JOIN days LEFT JOIN (SELECT rule_id, d, count(*) AS n FROM a GROUP BY ALL) c ON c.rule_id = r.rule_id AND c.d = days.day),
rb AS (SELECT rule_id, max(n) >= 5 * greatest(quantile_cont(n, 0.5), 1) AS burst FROM rd GROUP BY rule_id), lv AS (SELECT rule_id, quantile_cont(lvl, 0.5) AS level FROM a GROUP BY rule_id),
fo AS (SELECT rule_id, verdict FROM g UNION ALL SELECT rule_id, 'investigate' FROM rb WHERE burst),
fi AS (SELECT rule_id, min(list_position(['do_not_tune', 'investigate', 'fix_at_source', 'aggregate', 'tune', 'watch', 'learning'], verdict)) AS p FROM fo GROUP BY rule_id)
SELECT rule_id, CASE WHEN level > 11 THEN 'do_not_tune' ELSE coalesce(['do_not_tune', 'investigate', 'fix_at_source', 'aggregate', 'tune', 'watch', 'learning'][p], 'watch') END AS verdict FROM lv LEFT JOIN fi USING (rule_id) JOIN rb USING (rule_id)""")
def rule_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict on every rule: by its usual level, the verdicts on its channels and its own burst."""
    a = alerts(spark, sf)
    level = a.groupBy("rule_id").agg(F.percentile("lvl", 0.5).alias("level"))
    return scopes.rule_verdicts(level.join(noise.bursts(a).select("rule_id", "burst"), "rule_id"), noise.gated(noise.candidates(a)))


@query(f"""{WITH}, {_CUBE}, {_SERIES.replace('LEVEL', 'log_source')}, {_BASE}, dy AS (SELECT key1, h // 24 AS day, sum(n) AS total FROM b GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY key1 ORDER BY total, day) AS r, count(*) OVER (PARTITION BY key1) AS days FROM dy),
sc AS (SELECT key1, avg(total) AS expected FROM rk WHERE r > floor(days * 0.1) AND r <= days - floor(days * 0.1) GROUP BY key1),
x AS (SELECT key1, ln(total / expected) AS x, 1 / expected AS chance FROM dy JOIN sc USING (key1) WHERE expected >= 20 AND total > 0),
mi AS (SELECT key1, quantile_cont(x, 0.5) AS mid, quantile_cont(chance, 0.5) AS noise FROM x GROUP BY key1 HAVING count(*) >= 5),
wi AS (SELECT key1, 2.5::DOUBLE * 1.4826::DOUBLE * quantile_cont(abs(x - mid), 0.5) AS reach FROM x JOIN mi USING (key1) GROUP BY key1),
sg AS (SELECT key1, sqrt(greatest(0, var_samp(greatest(mid - reach, least(mid + reach, x))) - any_value(noise))) AS sigma FROM x JOIN mi USING (key1) JOIN wi USING (key1) GROUP BY key1)
SELECT key1, round(coalesce(sigma, 0), 6) AS sigma FROM (SELECT DISTINCT key1 FROM dy) LEFT JOIN sg USING (key1)""")
def day_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Spread of the days of each channel around its usual day."""
    b = _fitted(spark, sf, "log_source")[1]
    days = b.groupBy("key1", F.floor(F.col("h") / 24).alias("day")).agg(F.sum("n").alias("total"))
    days = days.join(cube.trimmed_scale(b).select("key1", F.col("per_day").alias("expected")), "key1")
    return scopes.day_spread(days).withColumn("sigma", r6(F.col("sigma")))


@query("""WITH r AS (SELECT p_partkey AS rule, CASE WHEN p_size % 15 = 0 THEN 99 ELSE p_size % 15 END * CASE WHEN p_size % 7 = 0 THEN 1 ELSE 100 END AS k FROM part),
e AS (SELECT DISTINCT p_partkey // 3 AS parent, p_partkey AS child FROM part WHERE p_size >= 10 AND p_partkey // 3 < p_partkey AND p_partkey // 3 IN (SELECT p_partkey FROM part))
SELECT parent, child AS rule, row_number() OVER (PARTITION BY parent ORDER BY k DESC, child) AS nth, count(*) OVER (PARTITION BY parent) - row_number() OVER (PARTITION BY parent ORDER BY k DESC, child) AS after FROM e JOIN r ON r.rule = child""")
def rule_trial_order(spark: SparkSession, sf: str) -> DataFrame:
    r, e = _edges(spark, sf)
    accuracy = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("rule"), F.when(F.col("p_size") % 7 == 0, 0).alias("accuracy"))
    return rules.trial_order(r.join(accuracy, "rule"), e)


@query(f"{WITH} SELECT event_id AS id, rule_id AS rule FROM a WHERE rule_id IN ('click', 'purchase') AND event_id % 11 <> 0")
def scan_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Events of two rules, from lines that name rules in other places too, cut lines and an escaped name among them."""
    e = alerts(spark, sf).select("event_id", "rule_id")
    other = F.when(F.col("event_id") % 2 == 0, "click").otherwise("x")
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.struct(F.col("rule_id").alias("id")).alias("rule"), other.alias("note")))
    escaped = F.replace(line, F.lit('"id":"c'), F.lit('"id":"\\u0063'))
    text = F.when(F.col("event_id") % 11 == 0, F.expr("substring(value, 1, length(value) - 1)")).when(F.col("event_id") % 3 == 0, escaped).otherwise(F.col("value"))
    path = lines_of(e.withColumn("value", line).withColumn("escaped", escaped).select(text.alias("value")))
    return documents.of_rules(spark, path, ["click", "purchase"]).select(F.try_variant_get("doc", "$.id", "long").alias("id"), "rule")


@query(f"""{WITH}, w AS (SELECT min(s) + (max(s) - min(s)) // 4 AS s0, min(s) + (max(s) - min(s)) // 4 * 3 AS s1 FROM a),
x AS (SELECT event_id, us, row_number() OVER (ORDER BY ts, event_id) AS nth, count(*) OVER () > 500 AS truncated FROM a, w WHERE us >= s0 * 1000000 AND us < s1 * 1000000) SELECT * FROM x WHERE nth <= 500""")
def events_within(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 events of the middle half of the time; the limit is the operator's own."""
    a = alerts(spark, sf)
    lo, hi = a.agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first()
    quarter = (hi - lo) // 4
    d = documents.within(a, F.timestamp_seconds(F.lit(lo + quarter)), F.timestamp_seconds(F.lit(lo + 3 * quarter)), 500)
    return d.select("event_id", F.unix_micros("ts").alias("us"), F.col("nth").cast("long").alias("nth"), "truncated")
