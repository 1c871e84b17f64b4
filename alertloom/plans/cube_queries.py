"""Queries over the hourly cube. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators import cube, silence
from alertloom.operators.alerts import alerts, r6
from alertloom.plans.noise_queries import WITH

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_CUBE = """cube AS (
  SELECT CASE WHEN grouping(rule_id) = 0 THEN 'rule' WHEN grouping(src) = 0 AND grouping(ls) = 0 THEN 'agent_log_source' WHEN grouping(src) = 0 THEN 'agent' WHEN grouping(ls) = 0 THEN 'log_source' ELSE 'tenant' END AS level,
    CASE WHEN grouping(rule_id) = 0 THEN rule_id WHEN grouping(src) = 0 THEN src WHEN grouping(ls) = 0 THEN ls END AS key1,
    CASE WHEN grouping(src) = 0 AND grouping(ls) = 0 THEN ls END AS key2, h, count(*) AS n
  FROM a GROUP BY GROUPING SETS ((h), (h, ls), (h, src), (h, src, ls), (h, rule_id)))"""


@query(f"{WITH}, {_CUBE} SELECT * FROM cube")
def hourly_cube(spark: SparkSession, sf: str) -> DataFrame:
    return cube.hourly_cube(alerts(spark, sf))


_SERIES = """span AS (SELECT min(h) AS h0, max(h) AS h1 FROM cube), hs AS (SELECT unnest(range(h0, h1 + 1)) AS h FROM span),
se AS (SELECT k.key1, hs.h, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT key1 FROM cube WHERE level = 'LEVEL') k CROSS JOIN hs LEFT JOIN cube c ON c.level = 'LEVEL' AND c.key1 = k.key1 AND c.h = hs.h)"""


@query(f"{WITH}, {_CUBE}, {_SERIES.replace('LEVEL', 'log_source')} SELECT key1, h, n FROM se")
def cube_dense_series(spark: SparkSession, sf: str) -> DataFrame:
    return cube.series(cube.hourly_cube(alerts(spark, sf)), "log_source").select("key1", "h", "n")


_BASE = "b AS (SELECT key1, h, n, (h + 72) % 168 AS slot FROM se, (SELECT max(h) + 1 AS e FROM se) WHERE h >= e - 336 AND h < e - 24)"
_PROFILE = """p0 AS (SELECT key1, slot % 24 AS hod, sum(n) AS s, count(*) AS m FROM b GROUP BY ALL), p1 AS (SELECT *, sum(s) OVER (PARTITION BY key1) / sum(m) OVER (PARTITION BY key1) AS mean FROM p0),
p2 AS (SELECT key1, hod, (s + 2.0::DOUBLE * mean) / (m + 2.0::DOUBLE) AS raw FROM p1),
p3 AS (SELECT x.key1, x.hod, sum(y.raw * CASE WHEN y.hod = x.hod THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END) AS v FROM p2 x JOIN p2 y ON x.key1 = y.key1 AND (y.hod - x.hod + 24) % 24 IN (0, 1, 23) GROUP BY ALL),
p AS (SELECT key1, hod, CASE WHEN sum(v) OVER (PARTITION BY key1) > 0 THEN v * 24 / sum(v) OVER (PARTITION BY key1) ELSE 1 END AS weight FROM p3)"""
_ALL = f"{WITH}, {_CUBE}, {_SERIES.replace('LEVEL', 'agent')}, {_BASE}, {_PROFILE}"
_DISP = """m AS (SELECT key1, avg(n) AS mean FROM b GROUP BY key1), dd AS (SELECT b.key1, mean, n, mean * weight AS mu FROM b JOIN p ON p.key1 = b.key1 AND p.hod = slot % 24 JOIN m ON m.key1 = b.key1),
de AS (SELECT key1, mean, sum(mu * mu) AS m2, sum((n - mu) * (n - mu) - n) AS excess FROM dd GROUP BY ALL),
k AS (SELECT key1, mean, CASE WHEN excess <= 0 THEN 1000.0::DOUBLE ELSE greatest(0.5::DOUBLE, least(1000.0::DOUBLE, m2 / excess)) END AS k FROM de)"""
_P0 = """l AS (SELECT key1, max(h) FILTER (n > 0) AS last_h, max(h) AS end_h FROM se GROUP BY key1),
gp AS (SELECT se.key1, sum(-k.k * ln(1 + mean * weight / k.k)) AS log_p0 FROM se JOIN l ON l.key1 = se.key1 AND se.h > last_h JOIN p ON p.key1 = se.key1 AND p.hod = (se.h + 72) % 24 JOIN k ON k.key1 = se.key1 GROUP BY se.key1),
t AS (SELECT l.key1, end_h - last_h AS gap_h, coalesce(log_p0, 0) AS log_p0, coalesce(log_p0, 0) < ln(least(0.5, 0.05::DOUBLE / (SELECT count(*) FROM k))) AS silent FROM l JOIN k ON k.key1 = l.key1 LEFT JOIN gp ON gp.key1 = l.key1)"""


def _fitted(spark: SparkSession, sf: str, level: str = "agent"):
    s = cube.series(cube.hourly_cube(alerts(spark, sf)), level)
    b = cube.baseline(s)
    return s, b, cube.profile(b)


@query(f"{_ALL} SELECT key1, hod, round(weight, 6) AS weight FROM p")
def seasonal_profile(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted(spark, sf)[2].withColumn("weight", r6(F.col("weight")))


@query(f"""{_ALL}, dy AS (SELECT key1, h // 24 AS day, sum(n) AS n FROM b GROUP BY ALL), r AS (SELECT key1, n, row_number() OVER (PARTITION BY key1 ORDER BY n, day) AS r, count(*) OVER (PARTITION BY key1) AS days FROM dy)
SELECT key1, days, round(avg(n), 6) AS per_day FROM r WHERE r > floor(days * 0.1) AND r <= days - floor(days * 0.1) GROUP BY ALL""")
def trimmed_scale(spark: SparkSession, sf: str) -> DataFrame:
    return cube.trimmed_scale(_fitted(spark, sf)[1]).withColumn("per_day", r6(F.col("per_day")))


@query(f"{_ALL}, {_DISP} SELECT key1, round(mean, 6) AS mean, round(k, 6) AS k FROM k")
def nb_dispersion(spark: SparkSession, sf: str) -> DataFrame:
    _, b, p = _fitted(spark, sf)
    return cube.dispersion(b, p).select("key1", r6(F.col("mean")).alias("mean"), r6(F.col("k")).alias("k"))


@query(f"{_ALL}, {_DISP}, {_P0} SELECT key1, gap_h, round(log_p0, 6) AS log_p0, silent FROM t")
def silent_p0_core(spark: SparkSession, sf: str) -> DataFrame:
    s, b, p = _fitted(spark, sf)
    return cube.silent_p0(s, p, cube.dispersion(b, p)).withColumn("log_p0", r6(F.col("log_p0")))


@query(f"""{_ALL}, {_DISP}, {_P0}, r AS (SELECT key1, exp(log_p0) AS p, log_p0, row_number() OVER (ORDER BY round(log_p0, 9), key1) AS rank, count(*) OVER () AS tests FROM t)
SELECT key1, round(p, 6) AS p, rank, round(least(1.0, min(p * tests / rank) OVER (ORDER BY rank DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_qvalues(spark: SparkSession, sf: str) -> DataFrame:
    s, b, p = _fitted(spark, sf)
    t = cube.silent_p0(s, p, cube.dispersion(b, p)).withColumn("log_p0", F.round("log_p0", 9))
    return cube.q_values(t).select("key1", r6(F.col("p")).alias("p"), "rank", r6(F.col("q")).alias("q"))


@query(f"{WITH}, r AS (SELECT src, rule_id, event_id, s AS at_s, row_number() OVER (PARTITION BY src ORDER BY ts DESC, event_id) AS nth FROM a WHERE lvl >= 12) SELECT * FROM r WHERE nth <= 64")
def cube_precursors(spark: SparkSession, sf: str) -> DataFrame:
    return cube.precursors(alerts(spark, sf))


@query(f"""{WITH}, o AS (SELECT s AS at_s FROM a WHERE lvl >= 12), x AS (SELECT at_s, count(*) OVER (ORDER BY at_s RANGE BETWEEN CURRENT ROW AND 7200 FOLLOWING) AS within FROM o)
SELECT max(within) AS most, arg_min(at_s, (-within, at_s)) AS from_s FROM x""")
def onset_cluster(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).filter("lvl >= 12").select(F.unix_seconds("ts").alias("at_s"))
    return cube.busiest(a)


@query(None)
def drop_decay_tests(spark: SparkSession, sf: str) -> DataFrame:
    s, b, p = _fitted(spark, sf)
    return silence.tests(s.select("key1", "h", "n"), p, cube.dispersion(b, p))
