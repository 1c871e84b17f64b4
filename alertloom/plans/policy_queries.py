"""Queries on tiers, tokens, acceptances, grouping, reminders and causes. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import globs, redact
from alertloom.functions import scalars as fn
from alertloom.operators import cube, policy
from alertloom.operators.alerts import alerts, table
from alertloom.plans.cube_queries import _ALL, _DISP, _P0, _fitted
from alertloom.plans.health_queries import _FIND, _RANK, _findings
from alertloom.plans.noise_queries import WITH

QUERIES: dict = {}
KEY = b"a key of the tests"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_inner, _outer = (p.hex() for p in redact.pads(KEY))


@query(f"SELECT c_custkey, 'user-' || substr(sha256(unhex('{_outer}') || unhex(sha256(unhex('{_inner}') || encode(lower(trim(c_name)))))), 1, 10) AS tok FROM customer")
def redact_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", redact.token(F.col("c_name"), "user", KEY).alias("tok"))


@query(f"{WITH}, t AS (SELECT DISTINCT src, CASE WHEN regexp_full_match(src, 'u[0-2]') OR regexp_full_match(src, 'u.*7') THEN 'critical' WHEN regexp_full_match(src, 'u1.') THEN 'low' ELSE 'standard' END AS tier FROM a) SELECT tier, count(*) AS hosts, min(src) AS lo FROM t GROUP BY tier")
def host_tiers(spark: SparkSession, sf: str) -> DataFrame:
    t = alerts(spark, sf).select("src").distinct().select("src", globs.tier(F.col("src"), ["U[0-2]", "u*7"], ["u1?"]).alias("tier"))
    return t.groupBy("tier").agg(F.count(F.lit(1)).alias("hosts"), F.min("src").alias("lo"))


@query("SELECT p_partkey, regexp_matches(lower(p_name), '^a|red|[0-9]$') AS hit, NOT regexp_matches(lower(p_name), 'e') AS none FROM part")
def rule_match_language(spark: SparkSession, sf: str) -> DataFrame:
    digits = "|".join(f"{d}$" for d in range(10))
    return table(spark, sf, "part").select("p_partkey", globs.os_match(F.col("p_name"), f"^A|red|{digits}").alias("hit"), globs.os_match(F.col("p_name"), "!E").alias("none"))


@query(f"""{WITH} SELECT h // 6 AS bucket, CASE WHEN k % 5 = 0 THEN NULL ELSE ls END AS ls, rule_id, count(*) AS n FROM a GROUP BY ALL""")
def composite_buckets(spark: SparkSession, sf: str) -> DataFrame:
    d = alerts(spark, sf).withColumn("ls", F.when(F.col("k") % 5 != 0, F.col("ls")))
    return d.groupBy(F.window("ts", "6 hours").alias("w"), "ls", "rule_id").agg(F.count(F.lit(1)).alias("n")).select((F.unix_seconds("w.start") / 21600).cast("long").alias("bucket"), "ls", "rule_id", "n")


_ACC = "(VALUES ('one-host', NULL, 'silence.%', 'u1%', NULL), ('old', NULL, '%', '%', 0), ('drops', NULL, 'silence.drop', '%3', 4102444800)) AS r(rule, of, kind_like, subject_like, until_s)"


@query(f"{_FIND} SELECT fp, kind, host AS subject, severity, min(rule) AS accepted_by FROM f LEFT JOIN (SELECT * FROM {_ACC} WHERE until_s IS NULL OR until_s >= 1700000000) x ON kind LIKE kind_like AND host LIKE subject_like GROUP BY ALL")
def accepted_findings(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame([("one-host", None, "silence.%", "u1%", None), ("old", None, "%", "%", 0), ("drops", None, "silence.drop", "%3", 4102444800)], "rule string, fp string, kind_like string, subject_like string, until_s long")
    return policy.accepted(_findings(spark, sf).withColumnRenamed("host", "subject"), rules, 1700000000)


@query(f"{_FIND} SELECT domain, severity, count(*) AS n FROM f WHERE {_RANK.format('f')} >= 4 GROUP BY ALL")
def severe_findings(spark: SparkSession, sf: str) -> DataFrame:
    return policy.at_least(_findings(spark, sf), "high").groupBy("domain", "severity").agg(F.count(F.lit(1)).alias("n"))


_ISS = f"{WITH}, i AS (SELECT DISTINCT src AS host, rule_id AS variant, CASE WHEN CAST(substr(src, 2) AS BIGINT) % 5 = 0 THEN 'critical' WHEN k % 2 = 0 THEN 'low' ELSE 'standard' END AS tier FROM a WHERE lvl = 13)"


@query(f"""{_ISS}, n AS (SELECT variant, tier, count(DISTINCT host) AS n FROM i GROUP BY ALL) SELECT variant, tier, NULL AS host, n FROM n WHERE n >= 5 AND tier <> 'critical'
UNION ALL SELECT DISTINCT variant, tier, host, 1 FROM i JOIN n USING (variant, tier) WHERE NOT (n >= 5 AND tier <> 'critical')""")
def grouped_issues(spark: SparkSession, sf: str) -> DataFrame:
    t = F.when(F.substring("src", 2, 20).cast("long") % 5 == 0, "critical").when(F.col("k") % 2 == 0, "low").otherwise("standard")
    i = alerts(spark, sf).filter("lvl = 13").select(F.col("src").alias("host"), F.col("rule_id").alias("variant"), t.alias("tier")).distinct()
    return policy.grouped(i)


@query(f"""{WITH}, st AS (SELECT src AS fp, d * 86400 AS at_s, max(lvl) >= 10 AS open FROM a GROUP BY src, d), x AS (SELECT *, open AND NOT coalesce(lag(open) OVER w, false) AS starts FROM st WINDOW w AS (PARTITION BY fp ORDER BY at_s)),
y AS (SELECT *, max(CASE WHEN starts THEN at_s END) OVER (PARTITION BY fp ORDER BY at_s ROWS UNBOUNDED PRECEDING) AS since FROM x), z AS (SELECT *, (at_s - since) // 259200 AS period FROM y WHERE open),
n AS (SELECT *, row_number() OVER (PARTITION BY fp, since, period ORDER BY at_s) AS nth FROM z) SELECT fp, at_s, since, period, CASE WHEN period = 0 THEN 'opened' ELSE 'reminder' END AS event FROM n WHERE nth = 1""")
def reminder_times(spark: SparkSession, sf: str) -> DataFrame:
    d = F.floor(F.unix_seconds("ts") / 86400) * 86400
    st = alerts(spark, sf).groupBy(F.col("src").alias("fp"), d.alias("at_s")).agg((F.max("lvl") >= 10).alias("open"))
    return policy.reminders(st, 259200)


@query(f"""{_ALL}, {_DISP}, n AS (SELECT count(*) AS keys FROM k), t AS (SELECT key1, CASE WHEN key1 LIKE '%7' THEN 'critical' ELSE 'low' END AS tier, CASE WHEN mean > 0 THEN ceil(-ln(least(0.5, 0.05::DOUBLE / keys)) / (k * ln(1 + mean / k)))::BIGINT END AS t_min FROM k, n)
SELECT key1, tier, t_min, coalesce(t_min <= CASE tier WHEN 'critical' THEN 4 ELSE 72 END, false) AS monitorable FROM t""")
def monitorability(spark: SparkSession, sf: str) -> DataFrame:
    _, b, p = _fitted(spark, sf)
    return policy.monitorable(cube.dispersion(b, p), F.when(F.col("key1").endswith("7"), "critical").otherwise("low"))


@query(f"""{WITH}, m AS (SELECT max(d) AS d1, min(d) AS d0 FROM a), g AS (SELECT src AS host, ls AS source, count(*) FILTER (d < d1 - 2) * 3.0::DOUBLE / any_value(d1 - 2 - d0) AS expected, count(*) FILTER (d >= d1 - 2) AS observed FROM a, m GROUP BY ALL),
x AS (SELECT *, greatest(0.0, expected - observed) AS missing FROM g), t AS (SELECT host, sum(missing ORDER BY source) AS total, arg_max(source, (missing, source)) AS source, max(missing) AS most FROM x GROUP BY host)
SELECT host, CASE WHEN most >= 0.7 * total THEN source END AS cause, round(total, 6) AS missing, round(most / total, 6) AS share FROM t WHERE total > 0""")
def single_cause(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).withColumn("d", F.floor(F.unix_seconds("ts") / 86400))
    m = a.agg(F.max("d").alias("d1"), F.min("d").alias("d0"))
    g = a.join(F.broadcast(m)).groupBy(F.col("src").alias("host"), F.col("ls").alias("source"), "d0", "d1").agg(F.count_if(F.col("d") < F.col("d1") - 2).alias("b"), F.count_if(F.col("d") >= F.col("d1") - 2).alias("observed"))
    return policy.single_cause(g.select("host", "source", (F.col("b") * 3.0 / (F.col("d1") - 2 - F.col("d0"))).alias("expected"), "observed"))


@query(f"""{_ALL}, {_DISP}, {_P0}, w AS (SELECT key1, CASE WHEN key1 LIKE '%7' THEN 'critical' WHEN key1 LIKE '%3' THEN 'low' ELSE 'standard' END AS tier, round(log_p0, 6) AS log_p0, silent FROM t)
SELECT * FROM w ORDER BY list_position(['critical', 'standard', 'low'], tier), log_p0, key1 LIMIT 20""")
def worst_sources(spark: SparkSession, sf: str) -> DataFrame:
    s, b, p = _fitted(spark, sf)
    t = cube.silent_p0(s, p, cube.dispersion(b, p)).withColumn("tier", F.when(F.col("key1").endswith("7"), "critical").when(F.col("key1").endswith("3"), "low").otherwise("standard"))
    return policy.worst_sources(t.select("key1", "tier", F.round("log_p0", 6).alias("log_p0"), "silent"), 20)


@query("SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) END AS host, length(url) AS n FROM pages")
def url_hosts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.when(u.rlike("^https?://"), F.lower(F.regexp_extract(u, "^https?://([^/:?#]+)", 1))).alias("host"), F.length(u).alias("n"))


@query(f"{WITH} SELECT event_id, 'rule:' || rule_id || '|ls:' || ls || '|src:' || src AS subject FROM a WHERE lvl = 13")
def subjects(spark: SparkSession, sf: str) -> DataFrame:
    item = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
    return alerts(spark, sf).filter("lvl = 13").select("event_id", fn.subject(F.col("rule_id"), F.array(item("src"), item("ls"))).alias("subject"))
