"""Queries on what fields say, verdicts, and the runs of a scheduled check. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import context
from alertloom.operators import runs, verdicts
from alertloom.operators.alerts import alerts, r6, table
from alertloom.plans.noise_queries import WITH

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _pick(xs: list, i: Column) -> Column:
    return F.array(*[F.lit(x).cast("string") for x in xs])[i.cast("int")]


@query("""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 5 THEN '10 parsecs' WHEN 6 THEN 'm' ELSE (o_custkey % 400)::VARCHAR || CASE o_orderkey % 7 WHEN 0 THEN 's' WHEN 1 THEN '.5 M' WHEN 2 THEN 'h ' WHEN 3 THEN 'd' ELSE 'W' END END AS text FROM orders),
s AS (SELECT o_orderkey, text, (regexp_extract(text, '^[0-9.]+')::DOUBLE * CASE lower(right(trim(text), 1)) WHEN 's' THEN 1 WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 604800 END) AS sec FROM t WHERE o_orderkey % 7 < 5 UNION ALL SELECT o_orderkey, text, NULL FROM t WHERE o_orderkey % 7 >= 5)
SELECT o_orderkey, sec, (sec::BIGINT // 900) * 900 AS floored, CASE WHEN sec IS NULL THEN NULL WHEN sec < 60 THEN floor(sec)::BIGINT || 's' WHEN sec < 86400 THEN trim(CASE WHEN sec >= 3600 THEN floor(sec / 3600)::BIGINT || 'h' ELSE '' END || CASE WHEN sec::BIGINT % 3600 >= 60 THEN ' ' || (sec::BIGINT % 3600 // 60) || 'm' ELSE '' END)
  ELSE floor(sec / 86400)::BIGINT || 'd' || CASE WHEN sec::BIGINT % 86400 >= 3600 THEN ' ' || (sec::BIGINT % 86400 // 3600) || 'h' ELSE '' END END AS words,
  strftime(make_timestamp(1700000000000000 + sec::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM s""")
def durations(spark: SparkSession, sf: str) -> DataFrame:
    """Durations as text, their seconds, steps, words and a time that long after another."""
    i = F.col("o_orderkey") % 7
    text = F.when(i == 5, "10 parsecs").when(i == 6, "m").otherwise(F.concat((F.col("o_custkey") % 400).cast("string"), _pick(["s", ".5 M", "h ", "d", "W"], i)))
    s = table(spark, sf, "orders").select("o_orderkey", context.duration_s(text).alias("sec"))
    return s.select("o_orderkey", "sec", context.floor_to(F.col("sec").cast("long"), 900).alias("floored"), context.humanized(F.col("sec")).alias("words"), context.iso(F.timestamp_seconds(F.col("sec").cast("long") + 1_700_000_000)).alias("at"))


@query(f"""{WITH}, x AS (SELECT event_id, ['True Positive', ' fp', 'benign-positive', 'closed by me', 'AutoClosed', 'Dup'][event_id % 6 + 1] AS said FROM a)
SELECT CASE WHEN event_id % 5 = 4 THEN NULL ELSE CASE event_id % 6 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' WHEN 2 THEN 'btp' WHEN 4 THEN 'untriaged' WHEN 5 THEN 'duplicate' END END AS verdict, count(*) AS n FROM x GROUP BY ALL""")
def document_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts that alert documents carry: dotted, nested, under the older name, or none."""
    said = _pick(["True Positive", " fp", "benign-positive", "closed by me", "AutoClosed", "Dup"], F.col("event_id") % 6)
    shapes = ['{"kibana.alert.workflow_reason":"%s"}', '{"kibana":{"alert":{"workflow_reason":"%s"}}}', '{"signal":{"workflow_reason":"%s"}}', '{"kibana.alert.workflow_reason":7,"signal.workflow_reason":"%s"}', '{"other":"%s"}']
    doc = F.replace(_pick(shapes, F.col("event_id") % 5), F.lit("%s"), said)
    return alerts(spark, sf).select(context.document_verdict(doc).alias("verdict")).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH} SELECT rule_id, count(*) FILTER (event_id % 5 = 0 OR event_id % 4 = 1) AS failure, count(*) FILTER (event_id % 5 = 1 AND event_id % 10 <> 4 OR event_id % 11 IN (2, 3)) AS fim, count(*) FILTER (event_id % 5 = 2) AS check,
count(*) FILTER (event_id % 5 = 3 OR event_id % 7 = 0 OR event_id % 7 IN (1, 2) AND event_id % 3 = 0 OR event_id % 13 = 0) AS process, count(*) AS n FROM a GROUP BY rule_id""")
def context_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of alerts by rule: from groups, outcomes, and codes with their provider or channel."""
    groups = F.array(F.lit("windows"), _pick(["Authentication_Failed", "syscheck", "sca", "audit_command", "web"], F.col("event_id") % 5))
    code = _pick(["4688", "1", " 1", "4624", None, "11", "3"], F.col("event_id") % 7)
    provider = F.when(F.col("event_id") % 2 == 0, "Microsoft-Windows-Sysmon").otherwise(None)
    channel = F.when(F.col("event_id") % 2 == 0, None).otherwise("Microsoft-Windows-Sysmon/Operational")
    d = alerts(spark, sf).select("rule_id", context.contexts(F.when(F.col("event_id") % 10 != 4, groups), code, F.when(F.col("event_id") % 3 == 0, provider), F.when(F.col("event_id") % 3 == 0, channel), F.when(F.col("event_id") % 4 == 1, "Failure"), _pick([None, "system", "file_integrity", "FIM-x", *[None] * 7], F.col("event_id") % 11), F.when(F.col("event_id") % 13 < 2, F.array(F.lit("host"), F.lit("Process"))), F.when(F.col("event_id") % 13 == 0, F.array(F.lit("start"))).otherwise(F.array(F.lit("end")))).alias("c"))
    return d.groupBy("rule_id").agg(*[F.count_if(F.col(f"c.{k}")).alias(k) for k in ("failure", "fim", "check", "process")], F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}, x AS (SELECT event_id % 10 AS i, user_id FROM events)
SELECT CASE WHEN i IN (0, 1, 8, 9) THEN 'ip' WHEN i IN (2, 3) THEN 'user' ELSE 'host' END AS kind, CASE WHEN i IN (0, 1) THEN '203.0.113.' || user_id % 9 WHEN i IN (2, 3) THEN 'ann' || user_id % 9 WHEN i = 4 THEN '10.0.0.' || user_id % 9 WHEN i > 7 THEN '2001:db8::1:' || user_id % 9 ELSE 'srv-' || user_id % 9 END AS key, count(*) AS n
FROM x WHERE i NOT IN (6, 7) GROUP BY ALL""")
def link_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Entities that link alerts, spelled in one way; generic ones link none."""
    e = table(spark, sf, "events")
    i, m = F.col("event_id") % 10, (F.col("user_id") % 9).cast("string")
    role = _pick(["src_ip", "src_ip", "user", "user", "host", "host", "user", "src_ip", "peer_ip", "source"], i)
    ends = _pick(["", "", "", "@corp.example", "", ".corp.example", "", "", "", ""], i)
    value = F.when(i == 6, "NT AUTHORITY\\SYSTEM").when(i == 7, " ::1").otherwise(F.concat(_pick(["203.0.113.", "::FFFF:203.0.113.", "CORP\\Ann", "ann", "10.0.0.", "SRV-", "", "", "2001:0DB8:0:0:0::1:", "2001:db8:0:0:0:0:1:000"], i), m, ends))
    d = e.select(context.link_kind(role, value).alias("kind"), value.alias("value")).filter("kind is not null")
    return d.select("kind", context.link_key(F.col("kind"), F.col("value")).alias("key")).groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s_suppkey, s_suppkey % 6 IN (0, 1) AND s_suppkey % 4 = 0 OR s_suppkey % 6 IN (2, 3) AND s_suppkey % 4 = 1 OR s_suppkey % 6 = 5 AND s_suppkey % 4 IN (1, 2) AS trusted FROM supplier""")
def trusted_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Trusted entities under any name of their field."""
    s = F.col("s_suppkey")
    field = _pick(["user", "data.srcuser", "source.ip", "srcip", "agent.name", "custom.field"], s % 6)
    value = _pick(["SVC-backup", "10.9.8.7", "printer", None], s % 4)
    return table(spark, sf, "supplier").select("s_suppkey", context.trusted(field, value, {"user.name": ["svc-*"], "data.srcip": ["10.9.?.7"], "custom.field": ["P*", "10.*"]}).alias("trusted"))


@query("""SELECT p_partkey % 8 AS i, count(*) AS n FROM part WHERE p_partkey % 8 IN (1, 3, 6) GROUP BY ALL""")
def parsed_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that the health of a log counts: not those that the alert system writes."""
    i = F.col("p_partkey") % 8
    name = _pick(["rule.level", "data.srcip", "@timestamp", "event.code", "agent.name", "kibana.alert.uuid", "identity", "_index"], i)
    return table(spark, sf, "part").filter(context.parsed_field(name)).groupBy(i.cast("long").alias("i")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}, x AS (SELECT event_id, timezone('Europe/Madrid', timezone('UTC', ts)) AS lt, ts + (k - 50) * INTERVAL 2 HOUR AS written FROM a),
y AS (SELECT event_id, written, strftime(lt, '%b %-d %H:%M:%S') AS text, year(timezone('Europe/Madrid', timezone('UTC', written))) AS y FROM x),
z AS (SELECT event_id, written, timezone('UTC', timezone('Europe/Madrid', try_strptime(y || ' ' || text, '%Y %b %-d %H:%M:%S'))) AS now, timezone('UTC', timezone('Europe/Madrid', try_strptime((y - 1) || ' ' || text, '%Y %b %-d %H:%M:%S'))) AS before FROM y)
SELECT event_id, epoch(CASE WHEN now IS NULL OR epoch_us(now) // 1000000 > epoch_us(written) // 1000000 + 172800 THEN coalesce(before, now) ELSE now END)::BIGINT AS at_s FROM z""")
def yearless_times(spark: SparkSession, sf: str) -> DataFrame:
    """Times without year or zone, read by the time their file was written."""
    written = (F.col("ts") + F.make_dt_interval(hours=((F.col("k") - 50) * 2).cast("int"))).alias("written")
    text = F.date_format(F.from_utc_timestamp("ts", "Europe/Madrid"), "MMM d HH:mm:ss")
    d = alerts(spark, sf).select("event_id", text.alias("text"), written)
    return d.select("event_id", F.unix_seconds(context.yearless(F.col("text"), F.col("written"), "Europe/Madrid")).alias("at_s"))


_TP = "[('t1', 'user', ' ANN3'), ('t2', 'Host', 'u7'), ('t3', 'srcip', '10.0.0.2'), ('t4', 'agent.name', 'U9 ')]"


@query(f"""{WITH} SELECT event_id, 't1' AS tp FROM a WHERE k % 10 = 3 UNION ALL SELECT event_id, 't2' FROM a WHERE src = 'u7' UNION ALL SELECT event_id, 't3' FROM a WHERE event_id % 16 = 2 UNION ALL SELECT event_id, 't4' FROM a WHERE src = 'u9'""")
def confirmed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events that true positives of a field apply to, under any name that the field may have."""
    a = alerts(spark, sf)
    f = a.select("event_id", F.explode(F.array(F.struct(F.lit("data.dstuser").alias("field"), F.concat(F.lit("Ann"), F.col("k") % 10).alias("value")), F.struct(F.lit("agent.name").alias("field"), F.col("src").alias("value")), F.struct(F.lit("data.srcip").alias("field"), F.concat(F.lit("10.0.0."), F.col("event_id") % 16).alias("value")))).alias("x")).select("event_id", "x.*")
    return verdicts.confirmed(f, spark.createDataFrame([("t1", "user", " ANN3"), ("t2", "Host", "u7"), ("t3", "srcip", "10.0.0.2"), ("t4", "agent.name", "U9 ")], "tp string, field string, value string"))


@query(f"""{WITH}, v AS (SELECT rule_id, src, ls, CASE WHEN event_id % 40 = 0 THEN 'tp' WHEN event_id % 2 = 0 THEN 'fp' ELSE 'btp' END AS verdict FROM a WHERE event_id % 3 = 0),
c AS (SELECT DISTINCT rule_id, ls, NULL AS src FROM a UNION ALL SELECT DISTINCT rule_id, ls, src FROM a WHERE src < 'u13')
SELECT c.rule_id || '|' || c.ls || coalesce('|' || c.src, '') AS candidate, count(v.verdict) FILTER (verdict = 'tp') AS tp, count(v.verdict) FILTER (verdict = 'fp') AS fp, count(v.verdict) FILTER (verdict = 'btp') AS btp, count(v.verdict) FILTER (verdict = 'tp') > 0 AS vetoed
FROM c LEFT JOIN v ON v.rule_id = c.rule_id AND v.ls = c.ls AND (c.src IS NULL OR v.src = c.src) GROUP BY c.rule_id, c.ls, c.src""")
def covered_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts on the alerts that a candidate's conditions would cover."""
    a = alerts(spark, sf)
    v = a.filter(F.col("event_id") % 3 == 0).select("rule_id", "src", "ls", F.when(F.col("event_id") % 40 == 0, "tp").when(F.col("event_id") % 2 == 0, "fp").otherwise("btp").alias("verdict"))
    cond = lambda *fs: F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fs])
    two = a.select("rule_id", "ls").distinct().select(F.concat_ws("|", "rule_id", "ls").alias("candidate"), cond("rule_id", "ls").alias("conditions"))
    three = a.filter("src < 'u13'").select("rule_id", "ls", "src").distinct().select(F.concat_ws("|", "rule_id", "ls", "src").alias("candidate"), cond("rule_id", "ls", "src").alias("conditions"))
    return verdicts.covered_verdicts(two.unionByName(three), v, ["rule_id", "src", "ls"])


@query(f"""{WITH}, c AS (SELECT rule_id, src, max(lvl) AS top, count(*) FILTER (lvl >= 7) AS analyst FROM a WHERE lvl < 10 GROUP BY ALL)
SELECT rule_id, src, CASE WHEN top <= 3 THEN 'demoted' WHEN analyst = 0 THEN 'unseen' END AS reason FROM c""")
def nothing_to_gain(spark: SparkSession, sf: str) -> DataFrame:
    c = alerts(spark, sf).filter("lvl < 10").groupBy("rule_id", "src").agg(F.max("lvl").alias("top"), F.count_if(F.col("lvl") >= 7).alias("analyst"))
    return c.select("rule_id", "src", verdicts.gain(F.col("top"), F.col("analyst")).alias("reason"))


@query(f"""{WITH}, b AS (SELECT src AS tenant, s, k % 9 > 0 AS ok, max(s) OVER (PARTITION BY src) AS last_s FROM a)
SELECT tenant, max(s) AS last_s, max(s) FILTER (ok) AS ok_s, max(s) FILTER (NOT ok) AS failed_s, count(*) AS kept FROM b WHERE s >= last_s - 864000 GROUP BY tenant""")
def run_heartbeats(spark: SparkSession, sf: str) -> DataFrame:
    """The state of a schedule by the beats of its last ten days."""
    return runs.heartbeats(alerts(spark, sf).select(F.col("src").alias("tenant"), F.unix_seconds("ts").alias("at_s"), (F.col("k") % 9 > 0).alias("ok")), 864_000)


_KIND = "['reminder', 'opened', 'resolved', 'escalated', 'other'][event_id % 5 + 1]"
_SEV = "CASE WHEN lvl >= 13 THEN 5 WHEN lvl >= 10 THEN 4 WHEN lvl >= 7 THEN 3 WHEN lvl >= 5 THEN 2 ELSE 1 END"


@query(f"""{WITH}, n AS (SELECT event_id AS place, {_KIND} AS kind, {_SEV} AS r FROM a)
SELECT place, kind FROM n ORDER BY r DESC, CASE kind WHEN 'opened' THEN 1 WHEN 'escalated' THEN 3 WHEN 'reminder' THEN 6 WHEN 'resolved' THEN 7 ELSE 99 END, place LIMIT 50""")
def notices_sent(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty notices that a message has room for."""
    sev = F.when(F.col("lvl") >= 13, "critical").when(F.col("lvl") >= 10, "high").when(F.col("lvl") >= 7, "medium").when(F.col("lvl") >= 5, "low").otherwise("info")
    d = alerts(spark, sf).select(F.col("event_id").alias("place"), _pick(["reminder", "opened", "resolved", "escalated", "other"], F.col("event_id") % 5).alias("kind"), sev.alias("severity"))
    return runs.sent(d, 50).select("place", "kind")


@query(f"""{WITH}, n AS (SELECT rule_id || src AS fp, d AS run, max(s) AS at_s, 'p' || max(k) % 3 AS phase FROM a GROUP BY ALL), w AS (SELECT *, lag(phase) OVER (PARTITION BY fp ORDER BY run) AS was_phase, lag(at_s) OVER (PARTITION BY fp ORDER BY run) AS was_s, max(run) OVER (PARTITION BY fp) AS last FROM n)
SELECT fp, CASE WHEN lost THEN was_phase ELSE phase END AS phase, CASE WHEN lost THEN was_s ELSE at_s END AS notified_s, lost AS again FROM (SELECT *, run % 5 = 0 OR run % 5 = 1 AND fp < 'k' AS lost FROM w WHERE run = last)""")
def redelivery(spark: SparkSession, sf: str) -> DataFrame:
    """What is known of findings after some notices did not arrive: all of some runs, single ones of others."""
    from pyspark.sql import Window

    a = alerts(spark, sf)
    n = a.groupBy(F.concat("rule_id", "src").alias("fp"), F.floor(F.unix_seconds("ts") / 86400).alias("run")).agg(F.unix_seconds(F.max("ts")).alias("at_s"), F.concat(F.lit("p"), F.max("k") % 3).alias("phase"))
    w = Window.partitionBy("fp").orderBy("run")
    n = n.withColumn("was_phase", F.lag("phase").over(w)).withColumn("was_s", F.lag("at_s").over(w))
    states = n.groupBy("fp").agg(F.max_by("phase", "run").alias("phase"), F.max("at_s").alias("notified_s"))
    lost = n.filter("run % 5 = 0").select("run", F.lit(None).cast("string").alias("fp")).unionByName(n.filter("run % 5 = 1 and fp < 'k'").select("run", "fp"))
    return runs.handed_back(states, n.select("run", "fp", "at_s", "was_phase", "was_s"), lost)


_LAG = "[2, 3600, 1234, -7200][k % 4 + 1] + event_id % 97 + CASE WHEN event_id % 10 = 0 THEN 40000 ELSE 0 END"


@query(f"""{WITH}, l AS (SELECT ls, {_LAG} AS lag_s, event_id % 3 > 0 AS naive FROM a), q AS (SELECT ls, quantile_cont(lag_s, 0.01) AS anchor, count(*) AS m FROM l WHERE naive GROUP BY ls),
o AS (SELECT ls, CASE WHEN m >= 20 AND abs(round_even(anchor / 900, 0) * 900) >= 1800 AND abs(anchor - round_even(anchor / 900, 0) * 900) <= 120 THEN round_even(anchor / 900, 0) * 900 ELSE 0 END AS off FROM q)
SELECT ls AS source, naive, count(*) AS n, max(CASE WHEN naive THEN off ELSE 0 END)::DOUBLE AS offset_s, round(avg(lag_s - CASE WHEN naive THEN off ELSE 0 END), 6) AS lag FROM l JOIN o USING (ls) GROUP BY ALL""")
def zoned_lags(spark: SparkSession, sf: str) -> DataFrame:
    """Lags of samples without a zone, less the zone they must have been in."""
    lag = (F.array(*map(F.lit, (2, 3600, 1234, -7200)))[(F.col("k") % 4).cast("int")] + F.col("event_id") % 97 + F.when(F.col("event_id") % 10 == 0, 40000).otherwise(0)).cast("long")
    d = runs.zoned_lags(alerts(spark, sf).select(F.col("ls").alias("source"), lag.alias("lag_s"), (F.col("event_id") % 3 > 0).alias("naive")))
    return d.groupBy("source", "naive").agg(F.count(F.lit(1)).alias("n"), F.max("offset_s").alias("offset_s"), r6(F.avg("lag_s")).alias("lag"))
