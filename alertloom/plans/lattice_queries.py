"""Conditions over the anchor fields of alert documents: the lattice of candidates, the chosen ones, and their verdicts. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators import lattice
from alertloom.operators.alerts import alerts, r6
from alertloom.plans.noise_queries import WITH

QUERIES: dict = {}
TRUSTED = {"user": ["CORP\\svc_backup"], "data.srcip": ["10.0.0.*"]}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """The events as alert documents: a map of fields over two hosts, a relaying manager, addresses, accounts, processes and files."""
    k, i = F.col("k"), F.col("event_id")
    relayed = k % 10 == 7
    fields = {
        "agent.id": F.when(relayed, "000").otherwise("001"),
        "agent.name": F.when(relayed, "manager").otherwise(F.concat(F.lit("srv-"), k % 2)),
        "predecoder.hostname": F.when(k % 20 == 7, "relay-1").when(k % 10 == 2, "SRV-0"),
        "location": F.when(relayed, "10.9.0.1").when(k % 3 == 0, "EventChannel").otherwise("/var/log/app.log"),
        "data.srcip": F.when(k % 4 == 1, "203.0.113.9").when(k % 4 != 3, "10.0.0.5"),
        "data.win.eventdata.targetUserName": F.when(k % 5 < 3, "CORP\\svc_backup").when(k % 5 == 3, F.concat(F.lit("SRV-"), k % 2, F.lit("$"))).otherwise("ann"),
        "data.win.eventdata.logonType": F.when(k % 5 < 3, "4"),
        "data.win.eventdata.image": F.when(k % 3 == 0, "C:\\Windows\\System32\\cmd.exe").when(k % 3 == 1, "C:\\Program Files\\Agent\\agent.exe"),
        "data.dstuser": F.when(k % 2 == 0, "svc_web").otherwise("-"),
        "syscheck.path": F.when((F.col("rule_id") == "view") & (k % 2 == 1), "/etc/passwd"),
        "data.url": F.concat(F.lit("/x/"), i % 2),
        "data.other": F.lit("no anchor"),
    }
    entries = F.array(*[F.struct(F.lit(p).alias("key"), F.when(v.isNotNull(), F.array(v)).alias("value")) for p, v in fields.items()])
    whole = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    lvl = F.when((F.col("rule_id") == "error") & (F.col("lvl") >= 12) & (k == 97), 12).otherwise(F.least("lvl", F.lit(10)))
    flags = [(F.col("rule_id") == "click").alias("failure"), (F.col("rule_id") == "view").alias("fim"), F.lit(False).alias("check"), (F.col("rule_id") == "purchase").alias("process")]
    return alerts(spark, sf).select("event_id", "rule_id", "ts", lvl.alias("lvl"), whole.alias("fields"), *flags)


def _verdicts(spark: SparkSession, sf: str) -> DataFrame:
    said = F.when(F.col("event_id") % 160 == 0, "tp").when(F.col("event_id") % 2 == 0, "fp").otherwise("btp")
    return alerts(spark, sf).filter((F.col("event_id") % 4 == 0) & (F.col("rule_id") != "view")).select("event_id", F.when((said == "tp") & (F.col("rule_id") != "signup"), "fp").otherwise(said).alias("verdict"))


def _tactics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("signup", ["Credential-Access"]), ("click", ["discovery"]), ("error", ["Lateral_Movement", "x"])], "rule_id string, tactics array<string>")


_FIELDS = f"""{WITH}, f AS (SELECT event_id, rule_id, ts, s, d, CASE WHEN rule_id = 'error' AND lvl >= 12 AND k = 97 THEN 12 ELSE least(lvl, 10) END AS lvl, k, k % 10 = 7 AS relayed,
  CASE WHEN k % 10 = 7 THEN 'manager' ELSE 'srv-' || k % 2 END AS agent, CASE WHEN k % 20 = 7 THEN 'relay-1' WHEN k % 10 = 2 THEN 'SRV-0' END AS pre, CASE WHEN k % 10 = 7 THEN '10.9.0.1' WHEN k % 3 = 0 THEN 'EventChannel' ELSE '/var/log/app.log' END AS loc FROM a),
h AS (SELECT *, CASE WHEN NOT relayed THEN 'agent.name' WHEN pre IS NOT NULL THEN 'predecoder.hostname' ELSE 'location' END AS hp, CASE WHEN NOT relayed THEN agent ELSE coalesce(pre, loc) END AS hv FROM f),
v AS (SELECT h.*, path, role, value FROM h, LATERAL (VALUES
  ('agent.name', 'host', CASE WHEN hp = 'agent.name' THEN agent END), ('predecoder.hostname', 'host', CASE WHEN hp = 'predecoder.hostname' OR lower(pre) <> lower(hv) THEN pre END),
  ('location', 'source', CASE WHEN loc <> 'EventChannel' THEN loc END), ('data.srcip', 'src_ip', CASE WHEN k % 4 = 1 THEN '203.0.113.9' WHEN k % 4 <> 3 THEN '10.0.0.5' END),
  ('data.win.eventdata.targetUserName', 'user', CASE WHEN k % 5 < 3 THEN 'CORP\\svc_backup' WHEN k % 5 = 3 THEN 'SRV-' || k % 2 || '$' ELSE 'ann' END),
  ('data.win.eventdata.image', 'process', CASE WHEN k % 3 = 0 THEN 'C:\\Windows\\System32\\cmd.exe' WHEN k % 3 = 1 THEN 'C:\\Program Files\\Agent\\agent.exe' END),
  ('data.dstuser', 'user', CASE WHEN k % 2 = 0 THEN 'svc_web' END), ('syscheck.path', 'file', CASE WHEN rule_id = 'view' AND k % 2 = 1 THEN '/etc/passwd' END), ('data.url', 'attacker', '/x/' || event_id % 2)) AS t(path, role, value) WHERE value IS NOT NULL),
i AS (SELECT rule_id, event_id, d, s, lvl, [path || ':' || value] AS c, NULL::VARCHAR AS other, NULL::VARCHAR AS hs, 1 AS size FROM v WHERE role <> 'attacker'
  UNION ALL SELECT rule_id, event_id, d, s, lvl, list_sort([hp || ':' || hv, path || ':' || value] || CASE WHEN path LIKE '%targetUserName' AND k % 5 < 3 THEN ['data.win.eventdata.logonType:4'] ELSE []::VARCHAR[] END), path, hp || ':' || hv, CASE WHEN path LIKE '%targetUserName' AND k % 5 < 3 THEN 3 ELSE 2 END FROM v WHERE path <> hp),
sup AS (SELECT rule_id, c, other, hs, size, sum(n)::BIGINT AS n, min(lo) AS first_s, count(*) AS present, max(n) AS peak, list_sort(list(n)) AS counts FROM (SELECT rule_id, c, other, hs, size, d, count(*) AS n, min(s) AS lo FROM i GROUP BY ALL) GROUP BY ALL),
r AS (SELECT rule_id, count(*) AS total, max(lvl) AS top, rule_id = 'click' AS failure, rule_id = 'view' AS fim, rule_id = 'purchase' AS process FROM f GROUP BY rule_id),
ses AS (SELECT rule_id, count(DISTINCT (b, p)) AS sessions FROM (SELECT rule_id, event_id, s // 900 AS b, list_sort(list(path || '=' || value)) AS p FROM v GROUP BY ALL) GROUP BY rule_id),
kind(c, alone, attacker, external, trusted, host_like, never, chosen) AS (VALUES
  ('agent.name:srv-0', true, false, false, false, true, false, false), ('agent.name:srv-1', true, false, false, false, true, false, false), ('predecoder.hostname:relay-1', true, false, false, false, true, false, false), ('predecoder.hostname:SRV-0', true, false, false, false, true, false, false),
  ('location:10.9.0.1', true, false, false, false, true, false, false), ('location:/var/log/app.log', false, false, false, false, false, false, false), ('data.srcip:203.0.113.9', false, true, true, false, false, false, false), ('data.srcip:10.0.0.5', true, false, false, true, false, false, false),
  ('data.win.eventdata.targetUserName:CORP\\svc_backup', false, false, false, true, false, false, false), ('data.win.eventdata.targetUserName:SRV-0$', false, false, false, false, false, false, true), ('data.win.eventdata.targetUserName:SRV-1$', false, false, false, false, false, false, true), ('data.win.eventdata.targetUserName:ann', false, true, false, false, false, false, true),
  ('data.win.eventdata.image:C:\\Windows\\System32\\cmd.exe', false, true, false, false, false, true, false), ('data.win.eventdata.image:C:\\Program Files\\Agent\\agent.exe', false, false, false, false, false, false, false), ('data.dstuser:svc_web', false, false, false, true, false, false, true),
  ('syscheck.path:/etc/passwd', true, false, false, false, false, false, false), ('data.url:/x/0', false, true, false, false, false, false, false), ('data.url:/x/1', false, true, false, false, false, false, false), ('data.win.eventdata.logonType:4', false, false, false, false, false, false, false)),
kr AS (SELECT rule_id, c AS one, seed, alone, attacker OR seed AS attacker, external, trusted AND NOT seed AS trusted, host_like, never, chosen AND NOT seed AS chosen
  FROM (SELECT kind.*, rule_id, failure AND (c LIKE '%targetUserName:%' OR c LIKE 'data.dstuser:%') AS seed FROM kind, r)),
b AS (SELECT sup.*, total, top, fim, process, coalesce(other LIKE '%targetUserName' AND list_contains(c, 'data.win.eventdata.targetUserName:' || upper(split_part(hs, ':', 2)) || '$'), false) AS own FROM sup JOIN r USING (rule_id) WHERE n >= 0.2 * total AND n >= 10),
w AS (SELECT b.rule_id, b.c, bool_or(never) AS never, bool_or((attacker OR external) AND NOT mine) AS risky, bool_or(trusted AND NOT mine) AS trusted, bool_or(external) AS external, bool_or((attacker OR chosen) AND NOT external AND NOT mine) AS picked,
    bool_and(alone) AS alone, bool_or(host_like) AS host_like, bool_or(attacker AND NOT mine) FILTER (b.one LIKE other || ':%') AS other_attacker, bool_or(alone) FILTER (b.one = hs) AS at_alone
  FROM (SELECT b.*, u.one, own AND u.one LIKE '%targetUserName:%' AS mine FROM b, unnest(b.c) AS u(one)) b JOIN kr ON kr.rule_id = b.rule_id AND kr.one = b.one GROUP BY b.rule_id, b.c),
x AS (SELECT b.*, w.* EXCLUDE (rule_id, c) FROM b JOIN w ON w.rule_id = b.rule_id AND w.c = b.c),
pin AS (SELECT DISTINCT rule_id, split_part(hs, ':', 1) AS hp, other FROM sup WHERE size = 3),
hosts AS (SELECT rule_id, c[1] AS hs, n AS host_n FROM x WHERE size = 1 AND host_like),
pr AS (SELECT x.*, host_n, own OR other = 'location' AS weak FROM x LEFT JOIN hosts ON hosts.rule_id = x.rule_id AND hosts.hs = x.hs
  WHERE size > 1 AND at_alone AND NOT never AND (size = 3 OR NOT EXISTS (SELECT 1 FROM pin WHERE pin.rule_id = x.rule_id AND pin.other = x.other AND pin.hp = split_part(x.hs, ':', 1)))),
pk AS (SELECT * FROM pr WHERE NOT weak OR host_n IS NULL OR n < 0.8 * host_n),
nar AS (SELECT rule_id, hs, max(covered) AS covered, bool_or(stable) AS stable FROM (SELECT rule_id, hs, other, sum(n) AS covered, bool_or(NOT other_attacker) AS stable FROM pk WHERE NOT weak GROUP BY ALL) GROUP BY ALL),
sg AS (SELECT x.*, CASE WHEN host_like THEN c[1] END AS host, CASE WHEN host_like THEN n ELSE total END AS container FROM x LEFT JOIN nar ON nar.rule_id = x.rule_id AND nar.hs = x.c[1] WHERE size = 1 AND alone AND NOT never AND NOT (host_like AND (coalesce(covered >= 0.8 * n, false) OR coalesce(stable, false)))),
lat AS (SELECT rule_id, c, n, first_s, present, peak, counts, total, top, fim, process, risky, trusted, external, picked, host, container, CASE WHEN risky THEN 0 WHEN trusted THEN 2 ELSE 1 END AS strength, 'rule:' || rule_id || '|' || array_to_string(list_sort(list_transform(c, lambda e: replace(e, '\\', '\\\\'))), '|') AS subject
  FROM (SELECT rule_id, c, n, first_s, present, peak, counts, total, top, fim, process, risky, trusted, external, picked, host, container FROM sg UNION ALL SELECT rule_id, c, n, first_s, present, peak, counts, total, top, fim, process, risky, trusted, external, picked, hs, coalesce(host_n, 0) FROM pk))"""
_SELECTED = f"""{_FIELDS.replace("WITH ", "WITH RECURSIVE ", 1)}, o AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY -(20 * n // total), -strength, -len(c), -n, subject) AS nth_all FROM lat),
cf AS (SELECT x.rule_id, x.nth_all, list(y.nth_all) FILTER (y.nth_all IS NOT NULL) AS against FROM o x LEFT JOIN o y ON y.rule_id = x.rule_id AND y.nth_all < x.nth_all AND (list_has_all(x.c, y.c) OR list_has_all(y.c, x.c)
  OR x.n + y.n - CASE WHEN x.host = y.host AND least(x.container, y.container) > 0 THEN least(x.container, y.container) ELSE x.total END >= 0.8 * x.n) GROUP BY ALL),
pick AS (SELECT rule_id, 0::BIGINT AS hs, []::BIGINT[] AS kept FROM r UNION ALL SELECT pick.rule_id, hs + 1, CASE WHEN len(kept) >= 5 OR len(list_intersect(kept, coalesce(against, []))) > 0 THEN kept ELSE list_append(kept, hs + 1) END FROM pick JOIN cf ON cf.rule_id = pick.rule_id AND cf.nth_all = hs + 1),
chosen AS (SELECT o.*, list_position(kept, nth_all)::BIGINT AS nth FROM o JOIN (SELECT rule_id, arg_max(kept, hs) AS kept FROM pick GROUP BY rule_id) USING (rule_id) WHERE list_contains(kept, nth_all))"""
_JUDGED = f"""{_SELECTED}, win AS (SELECT min(s) AS s0, max(s) AS s1, min(d) AS d0, max(d) - min(d) + 1 AS n_days FROM a),
day AS (SELECT DISTINCT chosen.rule_id, subject, d FROM chosen JOIN i ON i.rule_id = chosen.rule_id AND i.c = chosen.c),
lk AS (SELECT *, CASE role WHEN 'host' THEN 'host' WHEN 'src_ip' THEN 'ip' WHEN 'user' THEN 'user' WHEN 'source' THEN CASE WHEN value = '10.9.0.1' THEN 'ip' END END AS link, CASE role WHEN 'user' THEN split_part(lower(value), '\\', -1) ELSE lower(value) END AS key FROM v),
hi AS (SELECT link, key, h, count(*) AS n FROM (SELECT DISTINCT event_id, link, key, s // 3600 AS h FROM lk WHERE lvl >= 12 AND link IS NOT NULL) GROUP BY ALL),
en AS (SELECT DISTINCT chosen.rule_id, subject, link, key FROM chosen, unnest(chosen.c) AS u(one) JOIN (SELECT DISTINCT path || ':' || value AS one, link, key FROM lk WHERE link IS NOT NULL) m ON m.one = u.one),
co AS (SELECT rule_id, subject, sum(n)::BIGINT AS co_hits FROM (SELECT DISTINCT en.rule_id, en.subject, link, key, h, n FROM en JOIN hi USING (link, key) JOIN day ON day.rule_id = en.rule_id AND day.subject = en.subject AND day.d BETWEEN (h * 3600 - 86400) // 86400 AND (h * 3600 + 3599 + 86400) // 86400) GROUP BY ALL),
ah AS (SELECT DISTINCT rule_id, c, s // 3600 AS h FROM i WHERE size < 3 AND list_contains(c, 'data.srcip:203.0.113.9')),
bt AS (SELECT rule_id, c FROM (SELECT rule_id, c, h, h - row_number() OVER (PARTITION BY rule_id, c ORDER BY h) AS isl FROM ah) GROUP BY ALL HAVING count(*) >= 12 AND (count(*) / (max(h) - min(h) + 1) >= 0.75 OR count(*) / count(DISTINCT isl) >= 4)),
ex AS (SELECT rule_id, hp || ':' || hv AS host, count(*) AS outside FROM h WHERE k % 4 = 1 GROUP BY ALL),
ve AS (SELECT event_id, CASE WHEN event_id % 160 = 0 AND rule_id = 'signup' THEN 'tp' WHEN event_id % 2 = 0 THEN 'fp' ELSE 'btp' END AS verdict FROM a WHERE event_id % 4 = 0 AND rule_id <> 'view'),
sa AS (SELECT chosen.rule_id, subject, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp FROM chosen JOIN i ON i.rule_id = chosen.rule_id AND i.c = chosen.c JOIN ve USING (event_id) GROUP BY ALL),
fa AS (SELECT chosen.*, sessions, n_days, first_s > s0 + 0.25 * (s1 - s0) AS novel, present / n_days AS persistence, list_concat(list_transform(range(n_days - present), lambda z: 0), counts) AS all_days, coalesce(co_hits, 0) AS co_hits,
    EXISTS (SELECT 1 FROM bt WHERE bt.rule_id = chosen.rule_id AND len(list_intersect(bt.c, chosen.c)) > 0) AS beacon, coalesce(len(chosen.c) = 1 AND outside >= 0.5 * n, false) AS exposed, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp
  FROM chosen JOIN ses USING (rule_id) LEFT JOIN co USING (rule_id, subject) LEFT JOIN ex USING (rule_id, host) LEFT JOIN sa USING (rule_id, subject), win),
ga AS (SELECT *, tp + fp >= 10 AND tp = 0 AND (fp / (tp + fp) + 2.7055434540954146 / (2 * (tp + fp)) - 1.6448536269514722 * sqrt(fp / (tp + fp) * (1 - fp / (tp + fp)) / (tp + fp) + 2.7055434540954146 / (4.0 * (tp + fp) * (tp + fp)))) / (1 + 2.7055434540954146 / (tp + fp)) >= 0.8 AS proven FROM fa),
fl AS (SELECT *, list_filter([CASE WHEN top > 11 THEN 'level' END, CASE WHEN rule_id = 'click' THEN 'tp_rule_wide' END, CASE WHEN tp > 0 THEN 'tp' END, CASE WHEN novel THEN 'novelty' END, CASE WHEN persistence < 0.8 THEN 'persistence' END,
    CASE WHEN peak >= 5 * greatest(1.0, list_median(all_days)) THEN 'burst' END, CASE WHEN co_hits > 0 THEN 'co_occurrence' END, CASE WHEN beacon THEN 'beacon' END, CASE WHEN (rule_id IN ('signup', 'error', 'purchase')) AND NOT (NOT risky AND trusted AND proven) THEN 'sensitive' END,
    CASE WHEN picked AND NOT proven THEN 'attacker_field' END, CASE WHEN external OR exposed THEN 'external' END, CASE WHEN fim THEN 'fim' END], lambda z: z IS NOT NULL) AS failed FROM ga)"""


@query(f"{_FIELDS} SELECT rule_id, subject, n, strength, container, present, peak FROM lat")
def candidates_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes of each rule over twelve fields: single hosts, host and value, and with a companion."""
    return lattice.candidates(documents(spark, sf), "wazuh4", TRUSTED)[0].select("rule_id", "subject", "n", "strength", "container", "present", "peak")


@query(f"{_SELECTED} SELECT rule_id, subject, n, nth FROM chosen")
def chosen_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """The few scopes of a rule that add something to those before."""
    return lattice.selected(lattice.candidates(documents(spark, sf), "wazuh4", TRUSTED)[0]).select("rule_id", "subject", "n", F.col("nth").cast("long").alias("nth"))


@query(f"""{_JUDGED} SELECT rule_id, subject, nth, n, co_hits, tp, fp, round(persistence, 6) AS persistence, array_to_string(failed, ',') AS failed, CASE WHEN len(list_intersect(failed, ['level', 'tp', 'tp_rule_wide'])) > 0 THEN 'do_not_tune' WHEN len(list_intersect(failed, ['novelty', 'persistence', 'burst', 'co_occurrence', 'beacon'])) > 0 THEN 'investigate'
  WHEN len(list_intersect(failed, ['fim', 'check', 'external'])) > 0 THEN 'fix_at_source' WHEN list_contains(failed, 'sensitive') THEN CASE WHEN 1 - sessions / total >= 0.9 THEN 'aggregate' ELSE 'investigate' END WHEN list_contains(failed, 'attacker_field') THEN 'investigate' ELSE 'tune' END AS verdict FROM fl""")
def scope_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Facts on the chosen scopes and the gates that they fail: history, high alerts nearby, beacons, verdicts, tactics, exposure."""
    wide = spark.createDataFrame([("click", "tp"), ("error", "fp")], "rule_id string, verdict string")
    d = lattice.judged(documents(spark, sf), "wazuh4", _tactics(spark), _verdicts(spark, sf), wide, TRUSTED)
    return d.select("rule_id", "subject", F.col("nth").cast("long").alias("nth"), "n", "co_hits", "tp", "fp", r6(F.col("persistence")).alias("persistence"), F.array_join("failed", ",").alias("failed"), "verdict")
