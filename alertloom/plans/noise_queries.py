"""Queries over the alert view: projection, noise, repetition, candidates and their replay. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import addresses
from alertloom.functions import scalars as fn
from alertloom.operators import noise
from alertloom.operators.alerts import alerts, r6

VIEW = """a AS (
  SELECT event_id, ts, event_type AS rule_id, 'u' || user_id AS src, 'ch' || (CAST(props->>'$.k' AS BIGINT) % 4) AS ls,
    CASE WHEN value < 2 THEN 2 WHEN value < 15 THEN 5 WHEN value < 60 THEN 7 WHEN value < 150 THEN 10 ELSE 13 END AS lvl,
    value, CAST(props->>'$.k' AS BIGINT) AS k, epoch_us(ts) AS us, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 3600000000 AS h, epoch_us(ts) // 86400000000 AS d
  FROM events)"""
WITH = f"WITH {VIEW}"
QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"{WITH} SELECT event_id, us, rule_id, src, ls, lvl FROM a")
def alert_projection(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).select("event_id", F.unix_micros("ts").alias("us"), "rule_id", "src", "ls", "lvl")


@query(f"{WITH} SELECT lvl, count(*) AS n, min(value) AS lo, max(value) AS hi, count(DISTINCT src) AS hosts FROM a GROUP BY lvl")
def severity_bands(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).groupBy("lvl").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count_distinct("src").alias("hosts"))


@query(f"{WITH} SELECT ls, k % 10 AS k10, count(*) AS n, sum(k)::BIGINT AS k_sum FROM a GROUP BY ALL")
def json_field_extract(spark: SparkSession, sf: str) -> DataFrame:
    return alerts(spark, sf).groupBy("ls", (F.col("k") % 10).alias("k10")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"))


_fp = "substr(sha256('v1' || chr(31) || 'acme' || chr(31) || 'noise.tune' || chr(31) || subject), 1, 20)"


@query(f"{WITH}, s AS (SELECT DISTINCT 'rule:' || rule_id || '|host:' || src || '|ls:' || ls AS subject FROM a) SELECT subject, {_fp} AS fp FROM s")
def finding_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).select("rule_id", "src", "ls").distinct()
    item = lambda k, v: F.struct(F.lit(k).alias("field"), F.col(v).alias("value"))
    s = a.select(fn.subject(F.col("rule_id"), F.array(item("ls", "ls"), item("host", "src"))).alias("subject"))
    return s.select("subject", fn.fingerprint(F.lit("acme"), F.lit("noise.tune"), F.col("subject")).alias("fp"))


@query(f"""{WITH}, t AS (SELECT event_id, us, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+02:00' WHEN 1 THEN (us // 1000)::VARCHAR WHEN 2 THEN s::VARCHAR ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS txt FROM a)
SELECT event_id, txt, CASE event_id % 4 WHEN 0 THEN us // 1000000 - 7200 ELSE us // 1000000 END AS at_s FROM t""")
def time_parse_variants(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).when(kind == 1, F.unix_millis("ts").cast("string")).when(kind == 2, F.unix_seconds("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return a.select("event_id", text.alias("txt")).select("event_id", "txt", F.unix_seconds(fn.any_time(F.col("txt"))).alias("at_s"))


@query(f"""{WITH}, l AS (SELECT (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt FROM a)
SELECT strftime(lt, '%Y-%m-%d') AS local_day, (isodow(lt) - 1) * 24 + hour(lt) AS how, count(*) AS n FROM l GROUP BY ALL""")
def local_day_hour_of_week(spark: SparkSession, sf: str) -> DataFrame:
    local = alerts(spark, sf).select(F.from_utc_timestamp("ts", "America/New_York").alias("lt"))
    return local.groupBy(F.date_format("lt", "yyyy-MM-dd").alias("local_day"), fn.hour_of_week(F.col("lt")).cast("long").alias("how")).agg(F.count(F.lit(1)).alias("n"))


_STATS = "SELECT rule_id, count(*) AS total, count(*) FILTER (lvl >= 7) AS analyst, count(*) FILTER (lvl >= 12) AS high, min(lvl) AS min_lvl, max(lvl) AS max_lvl, count(DISTINCT d) AS active_days, min(s) AS first_s, max(s) AS last_s FROM a GROUP BY rule_id"


@query(f"{WITH} {_STATS}")
def rule_noise_summary(spark: SparkSession, sf: str) -> DataFrame:
    return noise.rule_stats(alerts(spark, sf))


@query(f"{WITH}, st AS ({_STATS}), w AS (SELECT max(d) - min(d) + 1 AS n_days FROM a) SELECT st.*, n_days, round(total / n_days, 6) AS per_day FROM st, w WHERE total >= 50 AND total / n_days >= 5")
def noisy_rules(spark: SparkSession, sf: str) -> DataFrame:
    return noise.noisy_rules(alerts(spark, sf)).withColumn("per_day", r6(F.col("per_day")))


@query(f"""{WITH}, st AS ({_STATS}), r AS (SELECT rule_id, total, analyst, row_number() OVER (ORDER BY analyst DESC, total DESC, rule_id) AS by_analyst, row_number() OVER (ORDER BY total DESC, rule_id) AS by_total FROM st)
SELECT * FROM r WHERE by_analyst <= 25 OR by_total <= 25""")
def mining_order(spark: SparkSession, sf: str) -> DataFrame:
    return noise.mining_order(noise.rule_stats(alerts(spark, sf)))


@query(f"{WITH} SELECT rule_id, count(*) AS total, count(DISTINCT (src, ls, s // 900)) AS clusters, round(1 - count(DISTINCT (src, ls, s // 900)) / count(*), 6) AS dup_ratio FROM a GROUP BY rule_id")
def cluster_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return noise.clusters(alerts(spark, sf)).withColumn("dup_ratio", r6(F.col("dup_ratio")))


@query(None)
def approx_clusters(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    return a.groupBy("rule_id").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64("src", "ls", F.floor(F.unix_seconds("ts") / noise.CLUSTER_GAP_S)), 12)).alias("clusters"))


@query(None)
def approx_top_values(spark: SparkSession, sf: str) -> DataFrame:
    alerts(spark, sf).createOrReplaceTempView("top_values_input")
    return spark.sql("SELECT rule_id, x.item AS value, x.count AS n FROM (SELECT rule_id, explode(approx_top_k(src, 10)) AS x FROM top_values_input GROUP BY rule_id)")


@query(f"""{WITH}, x AS (SELECT rule_id, 'src' AS path, src AS value, d FROM a UNION ALL SELECT rule_id, 'ls', ls, d FROM a),
c AS (SELECT rule_id, path, value, count(*) AS n, min(d) AS first_day, max(d) AS last_day, count(DISTINCT d) AS days FROM x GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, path ORDER BY n DESC, value) AS rank FROM c), t AS (SELECT rule_id, count(*) AS rule_total FROM a GROUP BY rule_id)
SELECT rule_id, path, value, n, first_day, last_day, days, rank, rule_total, round(n / rule_total, 6) AS share FROM r JOIN t USING (rule_id) WHERE rank <= 64""")
def anchor_topk(spark: SparkSession, sf: str) -> DataFrame:
    return noise.anchor_counts(alerts(spark, sf)).withColumn("share", r6(F.col("share")))


@query(f"{WITH} SELECT rule_id, src, ls, count(*) AS n, count(*) FILTER (lvl >= 7) AS analyst FROM a GROUP BY ALL")
def host_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return noise.host_pairs(alerts(spark, sf))


_ip = "(CASE WHEN event_id % 4 = 3 THEN ['2001:db8::', 'fd12:0:0::', '::ffff:10.0.0.', '::FFFF:198.51.100.', '2001:db8::1::'][k % 5 + 1] || (event_id % 250) ELSE CASE WHEN k % 3 = 0 THEN '10.' ELSE '203.' END || (k % 200) || '.' || (event_id % 250) || '.' || (k % 7 * 50) END)"
_four = "((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(f"""{WITH}, i AS (SELECT src, event_id % 4 = 3 AS six, k, {_ip} AS ip FROM a), e AS (SELECT src, CASE WHEN six THEN k % 5 IN (0, 3) ELSE regexp_full_match(ip, '{_four}') AND NOT starts_with(ip, '10.') END AS external FROM i)
SELECT src, count(*) AS n, count(*) FILTER (external) AS external, round(count(*) FILTER (external) / count(*), 6) AS share FROM e GROUP BY src""")
def external_share(spark: SparkSession, sf: str) -> DataFrame:
    """Share of a host's alerts from outside, over both families of addresses, mapped, shortened and misspelt ones."""
    k, e = F.col("k"), F.col("event_id")
    six = F.concat(F.array(*map(F.lit, ("2001:db8::", "fd12:0:0::", "::ffff:10.0.0.", "::FFFF:198.51.100.", "2001:db8::1::")))[(k % 5).cast("int")], e % 250)
    four = F.concat(F.when(k % 3 == 0, "10.").otherwise("203."), k % 200, F.lit("."), e % 250, F.lit("."), k % 7 * 50)
    a = alerts(spark, sf).withColumn("ip", F.when(e % 4 == 3, six).otherwise(four))
    return noise.external_share(a, addresses.kind(F.col("ip")) == "external").withColumn("share", r6(F.col("share")))


@query(f"""{WITH}, g AS (SELECT rule_id, src, us / 1e6 - lag(us / 1e6) OVER (PARTITION BY rule_id, src ORDER BY ts, event_id) AS gap FROM a),
b AS (SELECT rule_id, src, floor(ln(gap) / ln(1.1))::BIGINT AS bin, count(*) AS n FROM g WHERE gap >= 1 GROUP BY ALL),
w AS (SELECT x.rule_id, x.src, x.bin, sum(y.n) AS three FROM b x JOIN b y ON x.rule_id = y.rule_id AND x.src = y.src AND y.bin BETWEEN x.bin - 1 AND x.bin + 1 GROUP BY ALL),
t AS (SELECT rule_id, src, sum(n)::BIGINT AS gaps FROM b GROUP BY ALL)
SELECT rule_id, src, any_value(gaps) AS gaps, CASE WHEN any_value(gaps) >= 10 THEN round(least(1.0, max(three) / any_value(gaps)), 6) END AS regularity FROM w JOIN t USING (rule_id, src) GROUP BY rule_id, src""")
def interarrival_regularity(spark: SparkSession, sf: str) -> DataFrame:
    return noise.regularity(alerts(spark, sf)).withColumn("regularity", r6(F.col("regularity")))


@query(f"""{WITH}, hs AS (SELECT DISTINCT rule_id, src, h FROM a), i AS (SELECT *, h - row_number() OVER (PARTITION BY rule_id, src ORDER BY h) AS island FROM hs),
s AS (SELECT rule_id, src, count(*) AS active, max(h) - min(h) + 1 AS span, count(DISTINCT island) AS runs FROM i GROUP BY ALL)
SELECT *, active >= 12 AND (active / span >= 0.75 OR active / runs >= 4) AS beacon_like FROM s""")
def beacon_hours(spark: SparkSession, sf: str) -> DataFrame:
    return noise.beacons(alerts(spark, sf))


@query(f"""{WITH}, w AS (SELECT min(d) AS d0, max(d) AS d1 FROM a), days AS (SELECT unnest(range(d0, d1 + 1)) AS day FROM w), keys AS (SELECT DISTINCT rule_id FROM a), c AS (SELECT rule_id, d, count(*) AS n FROM a GROUP BY ALL),
z AS (SELECT keys.rule_id, day, coalesce(n, 0) AS n FROM keys CROSS JOIN days LEFT JOIN c ON c.rule_id = keys.rule_id AND c.d = day)
SELECT rule_id, max(n) AS peak, quantile_cont(n, 0.5)::DOUBLE AS median, arg_min(day, (-n, day)) AS peak_day, max(n) >= 5 * greatest(quantile_cont(n, 0.5), 1) AS burst FROM z GROUP BY rule_id""")
def burst_days(spark: SparkSession, sf: str) -> DataFrame:
    return noise.bursts(alerts(spark, sf))


@query(f"""{WITH}, w AS (SELECT min(s) AS s0, max(s) AS s1, max(d) - min(d) + 1 AS n_days FROM a), g AS (SELECT rule_id, src, count(*) AS n, min(s) AS first_s, count(DISTINCT d) AS present FROM a GROUP BY ALL)
SELECT rule_id, src, n, first_s, present, round(present / n_days, 6) AS persistence, first_s > s0 + 0.25 * (s1 - s0) AS novel FROM g, w""")
def novelty_persistence(spark: SparkSession, sf: str) -> DataFrame:
    return noise.novelty(alerts(spark, sf)).withColumn("persistence", r6(F.col("persistence")))


@query(f"""{WITH}, own AS (SELECT DISTINCT rule_id, src, h FROM a WHERE lvl < 12), o AS (SELECT rule_id AS other, src, h, count(*) AS n FROM a WHERE lvl >= 12 GROUP BY ALL),
hit AS (SELECT DISTINCT own.rule_id, own.src, other, o.h, n FROM own JOIN o ON own.src = o.src AND other <> own.rule_id AND abs(o.h - own.h) <= 24),
per AS (SELECT rule_id, src, sum(n)::BIGINT AS high_near, count(DISTINCT other) AS other_rules FROM hit GROUP BY ALL)
SELECT rule_id, src, coalesce(high_near, 0) AS high_near, coalesce(other_rules, 0) AS other_rules FROM (SELECT DISTINCT rule_id, src FROM own) LEFT JOIN per USING (rule_id, src)""")
def high_alert_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return noise.co_occurrence(alerts(spark, sf))


_CAND = """t AS (SELECT rule_id, count(*) AS rule_total, count(*) FILTER (lvl >= 12) AS rule_high FROM a GROUP BY rule_id),
c0 AS (SELECT rule_id, ls AS value, count(*) AS n, count(*) FILTER (lvl >= 7) AS analyst, count(*) FILTER (lvl >= 12) AS high, quantile_cont(lvl, 0.5)::DOUBLE AS usual_lvl FROM a GROUP BY ALL),
c AS (SELECT * FROM c0 JOIN t USING (rule_id) WHERE n >= 0.2 * rule_total AND n >= 10),
w AS (SELECT min(s) AS s0, max(s) AS s1, min(d) AS d0, max(d) AS d1, max(d) - min(d) + 1 AS n_days FROM a),
nv AS (SELECT rule_id, ls AS value, count(DISTINCT d) / any_value(n_days) AS persistence, min(s) > any_value(s0) + 0.25 * (any_value(s1) - any_value(s0)) AS novel FROM a, w GROUP BY ALL),
dz AS (SELECT rule_id, ls AS value, d, count(*) AS n FROM a GROUP BY ALL), days AS (SELECT unnest(range(d0, d1 + 1)) AS day FROM w),
z AS (SELECT k.rule_id, k.value, day, coalesce(dz.n, 0) AS n FROM (SELECT DISTINCT rule_id, value FROM dz) k CROSS JOIN days LEFT JOIN dz ON dz.rule_id = k.rule_id AND dz.value = k.value AND dz.d = day),
bu AS (SELECT rule_id, value, max(n) >= 5 * greatest(quantile_cont(n, 0.5), 1) AS burst FROM z GROUP BY ALL),
g AS (SELECT c.*, persistence, novel, burst, n / rule_total AS share, CASE WHEN usual_lvl > 11 THEN 'do_not_tune' WHEN novel OR persistence < 0.8 OR burst THEN 'investigate' WHEN high > 0 THEN 'investigate' ELSE 'tune' END AS verdict
  FROM c JOIN nv USING (rule_id, value) JOIN bu USING (rule_id, value))"""


@query(f"{WITH}, {_CAND} SELECT rule_id, value, n, analyst, high, usual_lvl, rule_total, rule_high, round(persistence, 6) AS persistence, novel, burst, round(share, 6) AS share, verdict FROM g")
def candidate_gates(spark: SparkSession, sf: str) -> DataFrame:
    d = noise.gated(noise.candidates(alerts(spark, sf)))
    return d.withColumns({"persistence": r6(F.col("persistence")), "share": r6(F.col("share"))})


def _suggestions(a: DataFrame) -> DataFrame:
    """Each candidate alone, and with its rule's most frequent host."""
    top = noise.anchor_counts(a).filter("path = 'src' and rank = 1").select("rule_id", F.col("value").alias("host"))
    c = noise.candidates(a).select("rule_id", "value").join(top, "rule_id")
    item = lambda f, v: F.struct(F.lit(f).alias("field"), F.col(v).alias("value"))
    return c.select("rule_id", F.explode(F.array(F.array(item("ls", "value")), F.array(item("ls", "value"), item("src", "host")))).alias("conditions")).withColumn("fp", fn.subject(F.col("rule_id"), F.col("conditions")))


_SUGG = f"""{_CAND}, hosts AS (SELECT rule_id, arg_min(src, (-n, src)) AS host FROM (SELECT rule_id, src, count(*) AS n FROM a GROUP BY ALL) GROUP BY rule_id),
sg AS (SELECT 'rule:' || rule_id || '|ls:' || value AS fp, rule_id, value, NULL AS host FROM c UNION ALL SELECT 'rule:' || rule_id || '|ls:' || value || '|src:' || host, rule_id, value, host FROM c JOIN hosts USING (rule_id))"""


@query(f"""{WITH}, {_SUGG}, hit AS (SELECT fp, a.* FROM a JOIN sg ON a.rule_id = sg.rule_id AND a.ls = sg.value AND (sg.host IS NULL OR a.src = sg.host)),
st AS (SELECT fp, count(*) AS hidden, count(*) FILTER (lvl >= 7) AS analyst_hidden, count(*) FILTER (lvl >= 12) AS high_hidden, count(DISTINCT src) AS hosts, max(lvl) AS max_lvl, count(DISTINCT d) AS days FROM hit GROUP BY fp)
SELECT sg.fp, sg.rule_id, coalesce(hidden, 0) AS hidden, coalesce(analyst_hidden, 0) AS analyst_hidden, coalesce(high_hidden, 0) AS high_hidden, coalesce(hosts, 0) AS hosts, coalesce(max_lvl, 0) AS max_lvl, coalesce(days, 0) AS days FROM sg LEFT JOIN st USING (fp)""")
def replay_backtest(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    return noise.backtest(a, _suggestions(a))


@query(f"""{WITH}, {_SUGG}, hit AS (SELECT DISTINCT a.rule_id, a.src, a.ls, a.s // 900 AS b FROM a JOIN sg ON a.rule_id = sg.rule_id AND a.ls = sg.value AND (sg.host IS NULL OR a.src = sg.host) WHERE lvl >= 7)
SELECT count(*) AS sessions, round(count(*) / any_value(n_days), 6) AS minutes_low, round(count(*) * 5 / any_value(n_days), 6) AS minutes_high FROM hit, (SELECT n_days FROM w)""")
def time_saved(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    d = noise.time_saved(a, _suggestions(a))
    return d.select("sessions", r6(F.col("minutes_low")).alias("minutes_low"), r6(F.col("minutes_high")).alias("minutes_high"))


@query(f"{WITH}, r AS (SELECT rule_id, event_id, row_number() OVER (PARTITION BY rule_id ORDER BY sha256('24301|' || event_id), event_id) AS nth FROM a) SELECT * FROM r WHERE nth <= 3")
def rule_examples(spark: SparkSession, sf: str) -> DataFrame:
    return noise.examples(alerts(spark, sf))
