"""Queries over days, hours and kinds of values, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.operators import kinds, rhythm
from alertloom.operators.alerts import alerts, r6, rounded, table
from alertloom.operators.incidents import rank
from alertloom.operators.noise import day, hour
from alertloom.operators.order import means, numbered
from alertloom.plans.noise_queries import WITH

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _days(a: DataFrame, key: str) -> DataFrame:
    """Dense daily counts (key, day, n) over the whole window."""
    span = a.agg(F.min(day(F.col("ts"))).alias("d0"), F.max(day(F.col("ts"))).alias("d1"))
    n = a.groupBy(F.col(key).alias("key"), day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    keys = n.select("key").distinct().join(F.broadcast(span)).select("key", F.explode(F.sequence("d0", "d1")).alias("day"))
    return keys.join(n, ["key", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _hours(a: DataFrame, key: str) -> DataFrame:
    span = a.agg(F.min(hour(F.col("ts"))).alias("h0"), F.max(hour(F.col("ts"))).alias("h1"))
    n = a.groupBy(F.col(key).alias("key"), hour(F.col("ts")).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    keys = n.select("key").distinct().join(F.broadcast(span)).select("key", F.explode(F.sequence("h0", "h1")).alias("h"))
    return keys.join(n, ["key", "h"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _dense(key: str, unit: str) -> str:
    return f"""c AS (SELECT {key} AS key, {unit} AS t, count(*) AS n FROM a GROUP BY ALL), span AS (SELECT min({unit}) AS t0, max({unit}) AS t1 FROM a),
z AS (SELECT k.key, t.t, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT key FROM c) k CROSS JOIN (SELECT unnest(range(t0, t1 + 1)) AS t FROM span) t LEFT JOIN c ON c.key = k.key AND c.t = t.t)"""


_AT = "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 5000000000 ELSE s END"


@query(f"""{WITH}, w AS (SELECT min(s) + 86400 AS lo, max(s) - 86400 AS hi FROM a), x AS (SELECT {_AT} AS s2, event_id FROM a)
SELECT CASE WHEN s2 IS NULL THEN 'none' WHEN s2 < 946684800 OR s2 >= 4102444800 THEN 'insane' WHEN s2 < lo THEN 'early' WHEN s2 >= hi THEN 'late' ELSE 'in' END AS state, count(*) AS n, max(s2) AS newest FROM x, w GROUP BY state""")
def window_states(spark: SparkSession, sf: str) -> DataFrame:
    """Events inside a window and those excluded from it, counted by reason."""
    a = alerts(spark, sf)
    lo, hi = a.agg(F.min(F.unix_seconds("ts")) + 86400, F.max(F.unix_seconds("ts")) - 86400).first()
    i = F.col("event_id") % 9
    ts = F.timestamp_seconds(F.when(i == 0, None).when(i == 1, 0).when(i == 2, 5_000_000_000).otherwise(F.unix_seconds("ts")))
    return a.select(ts.alias("t")).groupBy(rhythm.in_window(F.col("t"), lo, hi).alias("state")).agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.max("t")).alias("newest"))


@query(f"""{WITH}, {_dense("src", "d")}, m AS (SELECT key, quantile_cont(n, 0.5) FILTER (n > 0) AS median, count(*) FILTER (n > 0) AS active FROM z GROUP BY key)
SELECT z.key, z.t AS day, z.n, round(CASE WHEN active >= 4 AND z.n > 3 * median AND NOT EXISTS (SELECT 1 FROM z o WHERE o.key = z.key AND o.t <> z.t AND (o.t - z.t) % 7 = 0 AND o.n >= 0.5 * z.n) THEN 3 * median / z.n ELSE 1 END, 6) AS factor FROM z JOIN m USING (key)""")
def spike_days(spark: SparkSession, sf: str) -> DataFrame:
    return rhythm.spike_factors(_days(alerts(spark, sf), "src")).withColumn("factor", r6(F.col("factor")))


@query(f"""{WITH}, {_dense("src", "h")}, y AS (SELECT key, t // 24 AS day, sum(n) AS n, count(*) FILTER (n > 0) AS active, count(*) AS hours, coalesce(sum(n) FILTER (t % 24 BETWEEN 7 AND 18), 0) AS business FROM z GROUP BY ALL),
x AS (SELECT key, sum(n)::BIGINT AS n, sum(active)::BIGINT AS active, sum(hours)::BIGINT AS hours, sum(business) AS business, count(*) FILTER (n > 0) AS active_days, count(*) AS days FROM y GROUP BY key)
SELECT key, n, active, hours, active_days, days, CASE WHEN active >= 0.9 * hours THEN 'always_on' WHEN active_days >= 0.5 * days AND business >= 0.7 * n THEN 'business_hours' ELSE 'intermittent' END AS duty FROM x WHERE n > 0""")
def duty_class(spark: SparkSession, sf: str) -> DataFrame:
    return rhythm.duty(_hours(alerts(spark, sf), "src"))


@query(f"""{WITH}, {_dense("src", "d")}, e AS (SELECT z.key, z.t, z.n, avg(n) OVER (PARTITION BY key) * 3 AS expected FROM z), el AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i, max(t) OVER (PARTITION BY key) AS last_t FROM e WHERE expected >= 3),
o AS (SELECT *, i - row_number() OVER (PARTITION BY key ORDER BY t) AS island FROM el WHERE n <= 0)
SELECT key, min(t) AS first, max(t) AS last, count(*) AS length, bool_or(t = last_t) AS censored FROM o GROUP BY key, island""")
def day_off_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = _days(alerts(spark, sf), "src").withColumn("expected", F.avg("n").over(Window.partitionBy("key")) * 3)
    return rhythm.days_off(d)


@query(f"""{WITH}, {_dense("rule_id", "h")}, f AS (SELECT *, t // 24 AS day, max(n > 0) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS seen FROM z), g AS (SELECT *, row_number() OVER (PARTITION BY key, day ORDER BY t) AS i, max(t) OVER (PARTITION BY key, day) AS last_t FROM f WHERE seen),
o AS (SELECT *, i - row_number() OVER (PARTITION BY key, day ORDER BY t) AS island FROM g WHERE n <= 0)
SELECT key, day, min(t) AS first, max(t) AS last, count(*) AS length, bool_or(t = last_t) AS censored FROM o GROUP BY key, day, island""")
def quiet_hour_runs(spark: SparkSession, sf: str) -> DataFrame:
    return rhythm.quiet_hours(_hours(alerts(spark, sf), "rule_id"))


@query(f"""{WITH}, c AS (SELECT src AS key, h, count(*) AS n FROM a WHERE lvl >= 10 GROUP BY ALL), q AS (SELECT DISTINCT src AS key, h FROM a)
SELECT q.key, q.h, coalesce(sum(c.n), 0)::BIGINT AS n FROM q LEFT JOIN c ON c.key = q.key AND c.h BETWEEN q.h - 24 AND q.h + 24 GROUP BY q.key, q.h""")
def high_alerts_near(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).select(F.col("src").alias("key"), hour(F.col("ts")).alias("h"), "lvl")
    return rhythm.near(a.filter("lvl >= 10").groupBy("key", "h").agg(F.count(F.lit(1)).alias("n")), a.select("key", "h").distinct(), 24)


@query(f"""{WITH}, w AS (SELECT min(d) AS d0 FROM a), c AS (SELECT d AS day, count(*) AS n FROM a GROUP BY d)
SELECT day, n, day - d0 BETWEEN 2 AND 4 OR day - d0 BETWEEN 4 AND 9 OR day - d0 = 20 AS excluded FROM c, w""")
def calendar_days(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    first = a.agg(F.min(day(F.col("ts")))).first()[0]
    periods = spark.createDataFrame([(first + lo, first + hi) for lo, hi in ((2, 4), (4, 9), (20, 20))], "start_day long, end_day long")
    return rhythm.in_calendar(a.groupBy(day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n")), periods)


@query(f"""{WITH}, w AS (SELECT max(d) AS d1 FROM a), c AS (SELECT rule_id AS key, d, count(*) AS n FROM a GROUP BY ALL), days AS (SELECT unnest(range(d1 - 27, d1 + 1)) AS d FROM w)
SELECT k.key, string_agg(coalesce(c.n, 0)::VARCHAR, ',' ORDER BY days.d) AS line FROM (SELECT DISTINCT key FROM c, w WHERE d > d1 - 28) k CROSS JOIN days LEFT JOIN c ON c.key = k.key AND c.d = days.d GROUP BY k.key""")
def sparklines(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    last = a.agg(F.max(day(F.col("ts")))).first()[0]
    d = a.groupBy(F.col("rule_id").alias("key"), day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return rhythm.sparkline(d, last).select("key", F.array_join(F.col("line").cast("array<string>"), ",").alias("line"))


@query(f"""{WITH}, c AS (SELECT src, count(*) AS n FROM a GROUP BY src), t AS (SELECT sum(n)::BIGINT AS top FROM (SELECT n FROM c ORDER BY n DESC, src LIMIT 5))
SELECT sum(n)::BIGINT AS n, count(*) AS keys, any_value(top) AS top, round(any_value(top) / sum(n), 6) AS share FROM c, t""")
def top_five_share(spark: SparkSession, sf: str) -> DataFrame:
    return rhythm.top_share(alerts(spark, sf).groupBy(F.col("src").alias("key")).agg(F.count(F.lit(1)).alias("n"))).withColumn("share", r6(F.col("share")))


_CODES = "['1102', '104', '4719', '4', ' 16 ', '4624'][event_id % 6 + 1]"
_CHANNELS = "['Security', 'Microsoft-Windows-Sysmon/Operational', 'System', ''][event_id // 6 % 4 + 1]"
_RULE = "['202', '204', '506', '5710', '504'][event_id % 5 + 1]"


_AUDIT = "CASE event_id % 7 WHEN 3 THEN 'daemon_end ' WHEN 5 THEN 'SYSCALL' WHEN 6 THEN 'CONFIG_CHANGE' END"
_NAMED = "CASE WHEN event_id % 3 = 0 THEN 'x: Agent stopped: ''0' || (10 + user_id) || '-u' || (user_id + 1) || '-any''.' WHEN event_id % 3 = 1 THEN 'ossec: Agent disconnected: ''u' || user_id || '->10.0.0.1''.' END"


@query(f"""{WITH}, x AS (SELECT a.src, s, user_id, a.event_id, trim({_CODES.replace("event_id", "a.event_id")}) AS code, lower({_CHANNELS.replace("event_id", "a.event_id")}) AS ch, CASE WHEN a.event_id % 11 < 6 THEN {_RULE.replace("event_id", "a.event_id")} ELSE '80700' END AS rule, CASE WHEN k % 2 = 0 THEN 'windows' ELSE 'linux' END AS os,
  a.event_id % 13 = 4 AS audited, {_AUDIT.replace("event_id", "a.event_id")} AS audit, {_NAMED.replace("event_id", "a.event_id")} AS said, a.event_id % 2 = 0 AS manager FROM a JOIN events e ON e.event_id = a.event_id),
p AS (SELECT *, coalesce(CASE WHEN contains(ch, 'sysmon') THEN CASE code WHEN '4' THEN 'sysmon_4' WHEN '16' THEN 'sysmon_16' END
  WHEN code IN ('1102', '4719') AND (contains(ch, 'security') OR ch = '' AND os = 'windows') THEN 'win_' || code WHEN code = '104' AND contains(ch, 'system') AND NOT contains(ch, 'security') THEN 'win_104' END,
  CASE WHEN rule NOT IN ('5710', '80700') THEN 'wazuh_' || rule END, CASE WHEN audited THEN 'auditd_config' END, CASE upper(trim(audit)) WHEN 'DAEMON_END' THEN 'auditd_stop' WHEN 'CONFIG_CHANGE' THEN 'auditd_config' END) AS name FROM x),
h AS (SELECT src AS host, name AS code, s FROM p WHERE name IS NOT NULL
  UNION ALL SELECT 'u' || (user_id + 1), name, s FROM p WHERE event_id % 3 = 0 AND (name = 'wazuh_504' OR name = 'wazuh_506' AND manager))
SELECT host, code, count(*) AS n, max(s) AS last_s FROM h GROUP BY ALL""")
def precursor_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Events that often precede a silence, by code and channel, rule, group or audit record, also of hosts that a message names."""
    i = F.col("event_id")
    pick = lambda xs, n: F.array(*[F.lit(x) for x in xs])[n.cast("int")]
    user = F.substring("src", 2, 9).cast("long")
    said = F.when(i % 3 == 0, F.concat(F.lit("x: Agent stopped: '0"), user + 10, F.lit("-u"), user + 1, F.lit("-any'."))).when(i % 3 == 1, F.concat(F.lit("ossec: Agent disconnected: '"), "src", F.lit("->10.0.0.1'.")))
    a = alerts(spark, sf).select(
        "src", "ts", pick(["1102", "104", "4719", "4", " 16 ", "4624"], i % 6).alias("code"), pick(["Security", "Microsoft-Windows-Sysmon/Operational", "System", ""], F.floor(i / 6) % 4).alias("ch"),
        F.when(i % 11 < 6, pick(["202", "204", "506", "5710", "504"], i % 5)).otherwise("80700").alias("rule"), F.when(F.col("k") % 2 == 0, "windows").otherwise("linux").alias("os"),
        F.when(i % 13 == 4, F.array(F.lit("audit"), F.lit("audit_configuration"))).alias("groups"), pick([None, None, None, "daemon_end ", None, "SYSCALL", "CONFIG_CHANGE"], i % 7).alias("audit"), said.alias("said"), F.when(i % 2 == 0, "000").otherwise("007").alias("id"),
    )
    name = kinds.precursor(*map(F.col, ("code", "ch", "rule", "os", "groups", "audit")))
    p = a.withColumn("name", name).filter("name is not null")
    p = p.select(F.explode(kinds.precursor_hosts(*map(F.col, ("src", "name", "id", "said")))).alias("host"), F.col("name").alias("code"), "ts")
    return p.groupBy("host", "code").agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.max("ts")).alias("last_s"))


@query(f"""{WITH}, x AS (SELECT src, s, {_RULE} AS rule FROM a) SELECT src AS host, count(*) AS n, count(*) FILTER (rule = '204') AS losing, max(s) AS last_s FROM x WHERE rule IN ('202', '204') GROUP BY src""")
def flooded_agents(spark: SparkSession, sf: str) -> DataFrame:
    rule = F.array(*[F.lit(x) for x in ("202", "204", "506", "5710", "504")])[(F.col("event_id") % 5).cast("int")]
    return kinds.flooding(alerts(spark, sf).select(F.col("src").alias("host"), F.unix_seconds("ts").alias("at_s"), rule.alias("rule")))


_OS = (" Windows Server 2022", "Ubuntu", "macOS", "firewall", None, None, None, "plan9", "rocky", "Kali", "raspbian", "ol", "Arch", "gentoo", "oracle", "win64", "Darwin ", "switch", "Red Hat Linux 9")
_OS_PATHS = ("/x", None, None, None, "C:\\x", "/Library/x", None, None, None, None, None, None, None, None, None, None, None, None, None)


@query(f"""SELECT p_partkey, ['windows', 'linux', 'darwin', 'network', 'windows', 'darwin', 'linux', NULL, 'linux', 'linux', 'linux', 'linux', 'linux', 'linux', 'linux', 'windows', 'darwin', 'network', 'linux'][p_partkey % {len(_OS)} + 1] AS platform FROM part""")
def platform_inference(spark: SparkSession, sf: str) -> DataFrame:
    i = (F.col("p_partkey") % len(_OS)).cast("int")
    pick = lambda xs: F.array(*[F.lit(x).cast("string") for x in xs])[i]
    channels = [None, None, None, None, "journald", None, "/var/log/x", "other", *[None] * 11]
    return table(spark, sf, "part").select("p_partkey", kinds.platform(pick(_OS), pick(_OS_PATHS), pick(channels)).alias("platform"))


@query("""SELECT c_custkey, CASE c_custkey % 10 WHEN 0 THEN 'alone' WHEN 1 THEN 'alone' WHEN 2 THEN 'attacker' WHEN 3 THEN 'paired' WHEN 4 THEN 'attacker' WHEN 5 THEN 'paired' WHEN 6 THEN 'never' WHEN 7 THEN 'paired' WHEN 8 THEN 'attacker' ELSE 'attacker' END AS kind FROM customer""")
def value_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How a value may stand in a condition, by its field's role."""
    i = (F.col("c_custkey") % 10).cast("int")
    pick = lambda *xs: F.array(*[F.lit(x) for x in xs])[i]
    role = pick("host", "src_ip", "src_ip", "user", "user", "user", "process", "process", "process", "file")
    value = pick("web-1", "10.1.2.3", "203.0.113.9", "CORP\\svc-backup", "alice", "DC01$", "C:\\Windows\\System32\\PowerShell.exe", "/usr/sbin/sshd", "/tmp/sshd", "/etc/passwd")
    return table(spark, sf, "customer").select("c_custkey", kinds.value_kind(role, value, ["svc*"], ["powershell.exe", "cmd.exe"]).alias("kind"))


@query(f"""{WITH}, v AS (SELECT rule_id, CASE WHEN event_id % 3 > 0 THEN 'ls' END AS field, CASE WHEN event_id % 3 > 0 THEN ls END AS value, CASE WHEN event_id % 50 = 0 THEN 'tp' WHEN event_id % 2 = 0 THEN 'fp' ELSE 'btp' END AS verdict FROM a WHERE lvl >= 7 AND (rule_id < 'd' OR event_id % 3 > 0)),
own AS (SELECT rule_id, field, value, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'btp') AS btp FROM v WHERE field IS NOT NULL GROUP BY ALL),
wide AS (SELECT rule_id, count(*) FILTER (verdict = 'tp') AS rule_tp FROM v WHERE field IS NULL GROUP BY rule_id)
SELECT s.rule_id, 'ls' AS field, s.ls AS value, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(btp, 0) AS btp, coalesce(rule_tp, 0) AS rule_tp, coalesce(tp, 0) > 0 OR coalesce(rule_tp, 0) > 0 AS vetoed
FROM (SELECT DISTINCT rule_id, ls FROM a) s LEFT JOIN own ON own.rule_id = s.rule_id AND own.value = s.ls LEFT JOIN wide ON wide.rule_id = s.rule_id""")
def scope_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    i = F.col("event_id")
    v = a.filter((F.col("lvl") >= 7) & ((F.col("rule_id") < "d") | (i % 3 > 0)))
    v = v.select("rule_id", F.when(i % 3 > 0, "ls").alias("field"), F.when(i % 3 > 0, F.col("ls")).alias("value"), F.when(i % 50 == 0, "tp").when(i % 2 == 0, "fp").otherwise("btp").alias("verdict"))
    return kinds.scope_verdicts(a.select("rule_id", F.lit("ls").alias("field"), F.col("ls").alias("value")).distinct(), v)


@query(f"""{WITH}, f AS (SELECT rule_id AS kind, src AS subject, max(lvl) AS lvl, round(avg(value), 3) AS score FROM a GROUP BY ALL), g AS (SELECT *, CASE WHEN lvl >= 13 THEN 5 WHEN lvl >= 10 THEN 4 WHEN lvl >= 7 THEN 3 WHEN lvl >= 5 THEN 2 ELSE 1 END AS r FROM f)
SELECT kind, subject, count(*) OVER w AS place FROM g WINDOW w AS (ORDER BY r DESC, score DESC, kind, subject ROWS UNBOUNDED PRECEDING)""")
def sorted_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Findings in the order of a report: gravest, then highest score, kind and subject. Places come from a sort by ranges and the ranges'
    sizes, not from one window over all. Scores are means in the order of the events, rounded as the SQL rounds them."""
    a = alerts(spark, sf).select(F.col("rule_id").alias("kind"), F.col("src").alias("subject"), "event_id", "ts", "value", "lvl")
    a = means(a, ["kind", "subject"], ["event_id", "ts", "value"], "value", "mean", F.max("lvl").alias("lvl")).withColumn("score", rounded(F.col("mean"), 3))
    name = F.when(F.col("lvl") >= 13, "critical").when(F.col("lvl") >= 10, "high").when(F.col("lvl") >= 7, "medium").when(F.col("lvl") >= 5, "low").otherwise("info")
    f = a.withColumn("severity", name).withColumn("r", rank("severity"))
    return numbered(f, [F.desc("r"), F.desc("score"), F.asc_nulls_last("kind"), F.asc_nulls_last("subject")], "place").select("kind", "subject", "place")
