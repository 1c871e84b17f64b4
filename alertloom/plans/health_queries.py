"""Queries on field health, coverage, labels, the pipeline, the rule graph, incidents and lifecycles. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import scalars as fn
from alertloom.operators import causes, coverage, fields, incidents, labels, pipeline, rules
from alertloom.operators.alerts import alerts, r6, table
from alertloom.plans.noise_queries import WITH
from alertloom.streaming import lifecycle

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query("SELECT source, count(*) AS n, count(*) FILTER (t IS NULL) AS absent, count(DISTINCT t) AS kinds FROM (SELECT source, CASE WHEN trim(x) IN ('', '-', 'null', 'NULL', '(NULL)', 'None', 'N/A', 'n/a', 'unknown') THEN NULL ELSE x END AS t FROM (SELECT source, CASE doc_id % 5 WHEN 0 THEN ' N/A ' WHEN 1 THEN '-' WHEN 2 THEN '' ELSE lang END AS x FROM documents)) GROUP BY source")
def empty_token_nullify(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("doc_id") % 5
    x = F.when(m == 0, " N/A ").when(m == 1, "-").when(m == 2, "").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("source", fn.absent(x).alias("t")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("t").isNull()).alias("absent"), F.count_distinct("t").alias("kinds"))


@query(f"SELECT doc_id, sha256(regexp_replace(substr(text, 1, 2048), '{fn.VOLATILE}', '#', 'g')) AS norm FROM documents")
def free_text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(fn.free_text(F.col("text")), 256).alias("norm"))


@query(r"""SELECT page_id, sha256(t) AS masked, (length(t) - length(replace(t, '[url]', ''))) // 5 AS urls, (length(t) - length(replace(t, '[email]', ''))) // 7 AS emails FROM (
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, 'https?://[^ \n\t"''<>]+', '[url]', 'g'), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b', '[ip]', 'g') AS t FROM pages)""")
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pages").select("page_id", fn.redacted(F.col("html")).alias("t"))
    count = lambda s: ((F.length("t") - F.length(F.replace("t", F.lit(s), F.lit("")))) / len(s)).cast("long")
    return t.select("page_id", F.sha2("t", 256).alias("masked"), count("[url]").alias("urls"), count("[email]").alias("emails"))


_V = """v AS (SELECT documents.doc_id, source, lang, n_chars, CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'tp' WHEN quality = 1 THEN 'fp' ELSE 'btp' END AS verdict FROM documents LEFT JOIN labels l ON l.doc_id = documents.doc_id)"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, "tp").when(F.col("quality") == 1, "fp").when(F.col("quality").isNotNull(), "btp")
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "source", "lang", "n_chars", verdict.alias("verdict"))


@query(f"""WITH {_V}, x AS (SELECT source AS alert_id, verdict, n_chars AS closed_s, doc_id AS line FROM v WHERE verdict IS NOT NULL)
SELECT alert_id, arg_max(verdict, (CASE WHEN verdict = 'tp' THEN 1 ELSE 0 END, closed_s, line)) AS verdict, count(*) AS n_verdicts FROM x GROUP BY alert_id""")
def label_join_latest(spark: SparkSession, sf: str) -> DataFrame:
    d = _labelled(spark, sf).filter("verdict is not null").select(F.col("source").alias("alert_id"), "verdict", F.col("n_chars").alias("closed_s"), F.col("doc_id").alias("line"))
    return labels.latest(d)


_Z = 1.6448536269514722


@query(f"""WITH {_V}, g AS (SELECT source, count(*) FILTER (verdict = 'tp') AS tp, count(*) FILTER (verdict = 'fp') AS fp, count(*) FILTER (verdict = 'btp') AS btp, count(*) FILTER (verdict IS NULL) AS unlabelled FROM v GROUP BY source),
p AS (SELECT *, (tp + fp + btp)::DOUBLE AS n, (fp + btp)::DOUBLE / nullif(tp + fp + btp, 0) AS p FROM g)
SELECT source, tp, fp, btp, unlabelled, CASE WHEN n >= 10 THEN round(greatest(0.0, (p + {_Z}::DOUBLE * {_Z}::DOUBLE / (2 * n) - {_Z}::DOUBLE * sqrt(p * (1 - p) / n + {_Z}::DOUBLE * {_Z}::DOUBLE / (4 * n * n))) / (1 + {_Z}::DOUBLE * {_Z}::DOUBLE / n)), 6) END AS fp_lower FROM p""")
def fp_wilson(spark: SparkSession, sf: str) -> DataFrame:
    return labels.evidence(_labelled(spark, sf), "source").withColumn("fp_lower", r6(F.col("fp_lower")))


_FIELDS = "f AS (SELECT ls, d AS day, CASE WHEN NOT (ls = 'ch1' AND d >= (SELECT max(d) - 9 FROM a)) THEN k END AS k, CASE WHEN lvl >= 5 THEN rule_id END AS big, src FROM a)"
_PRES = f"""{_FIELDS}, w AS (SELECT ls, day, count(*) AS events, count(k) AS hk, count(big) AS hb, count(src) AS hs FROM f GROUP BY ALL),
pr AS (SELECT ls, day, events, 'k' AS field, hk AS present FROM w UNION ALL SELECT ls, day, events, 'big', hb FROM w UNION ALL SELECT ls, day, events, 'src', hs FROM w)"""


def _present(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).withColumn("day", F.floor(F.unix_seconds("ts") / 86400))
    last = a.agg((F.max("day") - 9).alias("from_day"))
    gone = (F.col("ls") == "ch1") & (F.col("day") >= F.col("from_day"))
    e = a.join(F.broadcast(last)).select("ls", "day", F.when(~gone, F.col("k")).alias("k"), F.when(F.col("lvl") >= 5, F.col("rule_id")).alias("big"), "src")
    return fields.presence(e, ["k", "big", "src"])


@query(f"{WITH}, {_PRES} SELECT * FROM pr")
def field_presence(spark: SparkSession, sf: str) -> DataFrame:
    return _present(spark, sf)


@query(f"""{WITH}, {_PRES}, l AS (SELECT ls, field, max(day) FILTER (present > 0.05 * events) AS last_there FROM pr GROUP BY ALL),
sd AS (SELECT pr.ls, pr.field, last_there, coalesce(sum(events) FILTER (day <= last_there), 0)::BIGINT AS events_before, coalesce(sum(present) FILTER (day <= last_there), 0)::BIGINT AS present_before,
  coalesce(sum(events) FILTER (day > last_there), 0)::BIGINT AS events_after, coalesce(sum(present) FILTER (day > last_there), 0)::BIGINT AS present_after FROM pr JOIN l ON l.ls = pr.ls AND l.field = pr.field GROUP BY ALL)
SELECT *, coalesce(events_before >= 100 AND events_after >= 100 AND present_before >= 0.95 * events_before AND present_after <= 0.05 * events_after, false) AS lost FROM sd""")
def field_lost(spark: SparkSession, sf: str) -> DataFrame:
    return fields.lost(_present(spark, sf))


_HAVE = "have AS (SELECT DISTINCT 'c' || o_custkey AS host, o_orderpriority AS source FROM orders), peers AS (SELECT DISTINCT c_nationkey AS grp, 'c' || c_custkey AS host FROM customer)"


def _have(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    have = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("host"), F.col("o_orderpriority").alias("source")).distinct()
    return have, table(spark, sf, "customer").select(F.col("c_nationkey").alias("grp"), F.concat(F.lit("c"), "c_custkey").alias("host")).distinct()


@query(f"""WITH {_HAVE}, z AS (SELECT grp, count(DISTINCT host) AS hosts FROM peers GROUP BY grp), st AS (SELECT grp, source, count(DISTINCT host) AS n FROM peers JOIN have USING (host) GROUP BY ALL),
ex AS (SELECT grp, source, n, hosts FROM st JOIN z USING (grp) WHERE hosts >= 5 AND n / (hosts - 1) >= 0.85)
SELECT grp, host, source, n, hosts FROM peers JOIN ex USING (grp) WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.host = peers.host AND h.source = ex.source)""")
def peer_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.peer_gaps(*_have(spark, sf), share=0.85)


_NOW = "(SELECT epoch_us(max(o_orderdate)) // 1000000 FROM orders)"


@query(f"""WITH c(contract, platform, name_like, source) AS (VALUES ('urgent', 'BUILDING', '%', '1-URGENT'), ('any-1', 'MACHINERY', 'c1%', '5-LOW'), ('gone', 'BUILDING', 'c2%', 'none')),
h AS (SELECT 'c' || c_custkey AS host, c_mktsegment AS platform FROM customer), s AS (SELECT 'c' || o_custkey AS host, o_orderpriority AS source, count(*) AS n, max(epoch_us(o_orderdate) // 1000000) AS last_s FROM orders GROUP BY ALL)
SELECT contract, h.host, c.source, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN {_NOW} - last_s > 31536000 THEN 'silent' WHEN n < 3 THEN 'low' ELSE 'present' END AS state
FROM h JOIN c ON h.platform = c.platform AND h.host LIKE c.name_like LEFT JOIN s ON s.host = h.host AND s.source = c.source""")
def contract_state(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("host"), F.col("o_orderpriority").alias("source"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s"))
    now = o.agg(F.max("s")).first()[0] or 0
    contracts = spark.createDataFrame([("urgent", "BUILDING", "%", "1-URGENT"), ("any-1", "MACHINERY", "c1%", "5-LOW"), ("gone", "BUILDING", "c2%", "none")], "contract string, platform string, name_like string, source string")
    hosts = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("host"), F.col("c_mktsegment").alias("platform"))
    return coverage.contract_states(contracts, hosts, o.groupBy("host", "source").agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("last_s")), now, 31536000, 3)


_INV = """l0 AS (SELECT DISTINCT CASE o_custkey % 3 WHEN 0 THEN 'H' || o_custkey || '.corp.example' WHEN 1 THEN 'h' || o_custkey ELSE 'H' || o_custkey END AS host FROM orders),
r0 AS (SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'h' || c_custkey WHEN 1 THEN 'H' || c_custkey ELSE 'h' || c_custkey || '.lan' END AS agent FROM customer)"""


def _pass(n: int, k: str, how: str) -> str:
    key = lambda c: k.replace("X", c)
    return f"""a{n} AS (SELECT host, {key("host")} AS k, count(*) OVER (PARTITION BY {key("host")}) AS c FROM l{n}), b{n} AS (SELECT agent, {key("agent")} AS k, count(*) OVER (PARTITION BY {key("agent")}) AS c FROM r{n}),
m{n} AS (SELECT host, agent, '{how}' AS how FROM a{n} JOIN b{n} USING (k) WHERE a{n}.c = 1 AND b{n}.c = 1), l{n + 1} AS (SELECT * FROM l{n} WHERE host NOT IN (SELECT host FROM m{n})), r{n + 1} AS (SELECT * FROM r{n} WHERE agent NOT IN (SELECT agent FROM m{n}))"""


@query(f"""WITH {_INV}, {_pass(0, "X", "exact")}, {_pass(1, "lower(X)", "case")}, {_pass(2, "split_part(lower(X), '.', 1)", "short")}
SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT host, NULL, 'data_only' FROM l3 UNION ALL SELECT NULL, agent, 'inventory_only' FROM r3""")
def host_inventory_join(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_custkey"), F.col("c_custkey")
    seen = table(spark, sf, "orders").select(F.when(o % 3 == 0, F.concat(F.lit("H"), o, F.lit(".corp.example"))).when(o % 3 == 1, F.concat(F.lit("h"), o)).otherwise(F.concat(F.lit("H"), o)).alias("host"))
    inv = table(spark, sf, "customer").select(F.when(c % 4 == 0, F.concat(F.lit("h"), c)).when(c % 4 == 1, F.concat(F.lit("H"), c)).otherwise(F.concat(F.lit("h"), c, F.lit(".lan"))).alias("agent"))
    return coverage.match_inventory(seen, inv)


@query("""WITH e AS (SELECT o_custkey, count(*) AS n, max(epoch_us(o_orderdate) // 1000000) AS ks FROM orders GROUP BY o_custkey), now AS (SELECT max(ks) AS now FROM e),
g AS (SELECT 'c' || c_custkey AS agent, CASE WHEN c_acctbal < 0 THEN 'pending' ELSE 'active' END AS status, ks AS keepalive_s, coalesce(n, 0) AS events FROM customer LEFT JOIN e ON o_custkey = c_custkey)
SELECT agent, status, keepalive_s, events, CASE WHEN keepalive_s IS NULL THEN 'never_connected' WHEN now - keepalive_s > 63072000 THEN 'stale' WHEN now - keepalive_s > 15768000 THEN 'disconnected' WHEN status = 'pending' THEN 'pending' WHEN events = 0 THEN 'no_data' ELSE 'ok' END AS state FROM g, now""")
def agent_health(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.unix_seconds(F.max("o_orderdate").cast("timestamp")).alias("ks"))
    now = e.agg(F.max("ks")).first()[0] or 0
    g = table(spark, sf, "customer").join(e, F.col("o_custkey") == F.col("c_custkey"), "left")
    g = g.select(F.concat(F.lit("c"), "c_custkey").alias("agent"), F.when(F.col("c_acctbal") < 0, "pending").otherwise("active").alias("status"), F.col("ks").alias("keepalive_s"), F.coalesce("n", F.lit(0)).alias("events"))
    return coverage.agent_states(g, now, 15768000, 63072000)


@query(f"{WITH} SELECT src AS host, count(*) FILTER (ls = 'ch0') AS ch0, count(*) FILTER (ls = 'ch1') AS ch1, count(*) FILTER (ls = 'ch2') AS ch2, count(*) FILTER (ls = 'ch3') AS ch3 FROM a GROUP BY src")
def coverage_matrix(spark: SparkSession, sf: str) -> DataFrame:
    have = alerts(spark, sf).groupBy(F.col("src").alias("host"), F.col("ls").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return coverage.matrix(have, ["ch0", "ch1", "ch2", "ch3"])


@query(f"{WITH}, c AS (SELECT src AS host, rule_id AS platform, count(*) AS n FROM a GROUP BY ALL) SELECT host, arg_min(platform, (-n, platform)) AS platform, sum(n)::BIGINT AS n FROM c GROUP BY host")
def usual_platform(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.usual_platform(alerts(spark, sf).select(F.col("src").alias("host"), F.col("rule_id").alias("platform")))


@query(f"""{WITH}, g AS (SELECT src, rule_id, count(*) AS n, min(s) AS f, max(s) AS l FROM a GROUP BY ALL), now AS (SELECT max(s) AS now FROM a)
SELECT src, rule_id, n, now - l AS gap_s, round(n * (now - l) / greatest(l - f, 1), 6) AS due, n >= 5 AND now - l >= 259200 AND n * (now - l) / greatest(l - f, 1) >= 5 AS stopped FROM g, now""")
def event_type_stopped(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    now = a.agg(F.unix_seconds(F.max("ts"))).first()[0] or 0
    return coverage.event_type_gaps(a, now, 259200, 5)


_LAG = "lag AS (SELECT l_returnflag AS source, (epoch_us(l_shipdate) - epoch_us(o_orderdate)) // 86400000000 AS lag_s FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""WITH {_LAG}, q AS (SELECT source, count(*) AS n, min(lag_s) AS lo, quantile_cont(lag_s, 0.25)::DOUBLE AS p25, quantile_cont(lag_s, 0.5)::DOUBLE AS p50, quantile_cont(lag_s, 0.75)::DOUBLE AS p75, quantile_cont(lag_s, 0.95)::DOUBLE AS p95 FROM lag GROUP BY source)
SELECT source, n, lo, round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p95, 6) AS p95, CASE WHEN p50 < -300 THEN 'ahead' WHEN abs(p50 - round(p50 / 900) * 900) <= 60 AND abs(round(p50 / 900) * 900) >= 1800 AND p75 - p25 <= 120 THEN 'zone_offset' WHEN p95 > 900 THEN 'late' ELSE 'ok' END AS state FROM q""")
def lag_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    d = table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    d = d.select(F.col("l_returnflag").alias("source"), F.floor((us("l_shipdate") - us("o_orderdate")) / 86400000000).alias("lag_s"))
    q = pipeline.lag_quantiles(d, "source", "lag_s")
    return q.withColumns({c: r6(F.col(c)) for c in ("p25", "p50", "p75", "p95")})


@query(f"""{WITH}, m AS (SELECT max(s) - 86400 AS now FROM a) SELECT count(*) AS events, count(*) FILTER (value > 400) AS malformed, count(*) FILTER (k % 7 = 0) AS no_time, count(*) FILTER (k % 7 <> 0 AND s > now) AS future,
min(s) FILTER (k % 7 <> 0 AND s <= now) AS start_s, max(s) FILTER (k % 7 <> 0 AND s <= now) AS end_s FROM a, m""")
def quality_row(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).withColumn("s", F.unix_seconds("ts"))
    now = a.agg((F.max("s") - 86400).alias("now"))
    return pipeline.quality(a.join(F.broadcast(now)), F.when(F.col("k") % 7 != 0, F.col("s")), F.col("now"), F.col("value") > 400)


_EDGES = "e AS (SELECT DISTINCT p_partkey // 3 AS parent, p_partkey AS child FROM part WHERE p_partkey // 3 <> p_partkey AND p_size >= 10)"


def _edges(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf, "part")
    r = p.select(F.col("p_partkey").cast("long").alias("rule"), F.col("p_partkey").alias("position"), (F.col("p_size") % 15).alias("level"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).otherwise("").alias("conditions"), F.when(F.col("p_size") % 3 != 0, F.col("p_name")).alias("description"))
    e = p.filter("p_size >= 10").select(F.floor(F.col("p_partkey") / 3).alias("parent"), F.col("p_partkey").cast("long").alias("child")).filter("parent <> child").distinct()
    return r, e


@query(f"""WITH RECURSIVE {_EDGES}, ok AS (SELECT parent, child FROM e WHERE parent IN (SELECT p_partkey FROM part) AND parent < child),
t(root, rule, level) AS (SELECT parent, child, 1 FROM ok UNION ALL SELECT root, child, level + 1 FROM t JOIN ok ON ok.parent = t.rule WHERE level < 64)
SELECT root, rule, min(level) AS level FROM t GROUP BY ALL""")
def rule_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return rules.descendants(*_edges(spark, sf))


@query(f"""WITH {_EDGES}, r AS (SELECT p_partkey AS rule, p_size % 15 AS level, CASE WHEN p_size % 5 <> 0 THEN p_brand ELSE '' END AS conditions, CASE WHEN p_size % 3 <> 0 THEN p_name END AS description FROM part),
top AS (SELECT child AS rule, max(level) AS pl, count(*) FILTER (level IS NULL) AS missing FROM e LEFT JOIN r ON r.rule = e.parent GROUP BY child), below AS (SELECT parent AS rule, count(*) AS dep FROM e GROUP BY parent),
tw AS (SELECT conditions, count(*) AS twins FROM r WHERE level <= 1 GROUP BY conditions),
x AS (SELECT r.rule, list_filter([CASE WHEN r.conditions = '' THEN 'whole_rule' END, CASE WHEN pl >= 10 THEN 'high_parent' END, CASE WHEN dep > 0 THEN 'breaks_correlation' END, CASE WHEN missing > 0 THEN 'missing_parent' END,
  CASE WHEN coalesce(description, '') = '' THEN 'no_description' END, CASE WHEN twins > 1 AND r.conditions <> '' THEN 'duplicate' END], lambda v: v IS NOT NULL) AS i
  FROM r LEFT JOIN top ON top.rule = r.rule LEFT JOIN below ON below.rule = r.rule LEFT JOIN tw ON tw.conditions = r.conditions WHERE r.level <= 1)
SELECT rule, coalesce(array_to_string(i, ','), '') AS issues, len(i) AS n_issues FROM x""")
def suppression_audit(spark: SparkSession, sf: str) -> DataFrame:
    return rules.audit(*_edges(spark, sf))


_FIND = f"""{WITH}, f AS (SELECT substr(sha256('v1' || chr(31) || 't' || chr(31) || kind || chr(31) || src), 1, 20) AS fp, kind, src AS host, severity, domain FROM (
SELECT src, ['silence.silent', 'silence.drop', 'noise.tune'][(k % 3) + 1] AS kind, ['silence', 'silence', 'noise'][(k % 3) + 1] AS domain, ['info', 'low', 'medium', 'high', 'critical'][max(CASE WHEN lvl >= 13 THEN 5 WHEN lvl >= 10 THEN 3 ELSE 2 END)] AS severity FROM a GROUP BY src, k % 3))"""


def _findings(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("m") + 1).cast("int"))
    top = F.max(F.when(F.col("lvl") >= 13, 5).when(F.col("lvl") >= 10, 3).otherwise(2))
    g = alerts(spark, sf).groupBy("src", (F.col("k") % 3).alias("m")).agg(F.element_at(F.array(*[F.lit(s) for s in incidents.SEVERITIES]), top).alias("severity"))
    g = g.withColumns({"kind": pick("silence.silent", "silence.drop", "noise.tune"), "domain": pick("silence", "silence", "noise")})
    return g.select(fn.fingerprint(F.lit("t"), F.col("kind"), F.col("src")).alias("fp"), "kind", F.col("src").alias("host"), "severity", "domain")


_RANK = "list_position(['info', 'low', 'medium', 'high', 'critical'], {}.severity)"


@query(f"""{_FIND}, c AS (SELECT x.fp, y.fp AS root, {_RANK.format("y")} AS rr FROM f x JOIN (VALUES ('silence.silent', 'silence.drop'), ('silence.drop', 'noise.tune')) AS e(cause, kind) ON x.kind = e.kind JOIN f y ON y.kind = e.cause AND y.host = x.host WHERE {_RANK.format("y")} >= {_RANK.format("x")} AND x.fp <> y.fp),
b AS (SELECT fp, root FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY rr DESC, root) AS r FROM c) WHERE r = 1)
SELECT f.fp, coalesce(b3.root, b2.root, b1.root, f.fp) AS root FROM f LEFT JOIN b b1 ON b1.fp = f.fp LEFT JOIN b b2 ON b2.fp = b1.root LEFT JOIN b b3 ON b3.fp = b2.root""")
def incident_fold(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.fold(_findings(spark, sf), [("silence.silent", "silence.drop"), ("silence.drop", "noise.tune")])


@query(f"""{_FIND}, g AS (SELECT domain, max({_RANK.format("f")}) AS worst, count(*) AS n FROM f GROUP BY domain)
SELECT d.domain, CASE WHEN NOT assessed THEN 'not_assessed' WHEN worst >= 4 THEN 'fail' WHEN worst >= 2 THEN 'warn' ELSE 'ok' END AS status, coalesce(worst, 0)::BIGINT AS worst, coalesce(n, 0) AS n
FROM (VALUES ('noise', true), ('silence', true), ('fields', true), ('coverage', false)) AS d(domain, assessed) LEFT JOIN g ON g.domain = d.domain""")
def domain_status(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.domain_status(_findings(spark, sf), ["noise", "silence", "fields", "coverage"], ["noise", "silence", "fields"])


@query(f"""{WITH}, r AS (SELECT rule_id || '/' || src AS fp, s AS at_s, event_id, count(*) OVER (PARTITION BY rule_id, src ORDER BY s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS recent FROM a) SELECT *, recent >= 3 AS flapping FROM r""")
def flapping(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).select(F.concat("rule_id", F.lit("/"), "src").alias("fp"), F.unix_seconds("ts").alias("at_s"), "event_id")
    return lifecycle.flapping(a)


_RUNS = "runs AS (SELECT unnest(range(d0, d1 + 1)) AS run FROM (SELECT min(d) AS d0, max(d) AS d1 FROM a)), lg AS (SELECT k.src AS fp, run, EXISTS (SELECT 1 FROM a WHERE a.src = k.src AND a.d = run AND a.lvl >= 10) AS present FROM (SELECT DISTINCT src FROM a) k CROSS JOIN runs)"


def _log(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).withColumn("d", F.floor(F.unix_seconds("ts") / 86400))
    days = a.agg(F.min("d").alias("d0"), F.max("d").alias("d1")).select(F.explode(F.sequence("d0", "d1")).alias("run"))
    seen = a.filter("lvl >= 10").select(F.col("src").alias("fp"), F.col("d").alias("run"), F.lit(True).alias("hit")).distinct()
    return a.select(F.col("src").alias("fp")).distinct().join(F.broadcast(days)).join(seen, ["fp", "run"], "left").select("fp", "run", F.coalesce("hit", F.lit(False)).alias("present"))


@query(f"""{WITH.replace("WITH", "WITH RECURSIVE", 1)}, {_RUNS}, q AS (SELECT fp, run, present, row_number() OVER (PARTITION BY fp ORDER BY run) AS i FROM lg),
st(fp, i, run, state, bad, good, event) AS (
  SELECT fp, 0::BIGINT, 0::BIGINT, 'none', 0, 0, NULL::VARCHAR FROM (SELECT DISTINCT fp FROM q)
  UNION ALL
  SELECT q.fp, q.i, q.run,
    CASE WHEN q.present THEN CASE WHEN state = 'none' THEN 'new' WHEN state = 'new' AND bad + 1 >= 2 THEN 'open' WHEN state = 'resolved' AND bad + 1 >= 2 THEN 'regressed' ELSE state END
      ELSE CASE WHEN state = 'new' THEN 'none' WHEN state IN ('open', 'regressed') AND good + 1 >= 2 THEN 'resolved' ELSE state END END,
    CASE WHEN q.present THEN bad + 1 ELSE 0 END, CASE WHEN q.present THEN 0 ELSE good + 1 END,
    CASE WHEN q.present THEN CASE WHEN state = 'none' THEN 'new' WHEN state = 'new' AND bad + 1 >= 2 THEN 'opened' WHEN state = 'resolved' AND bad + 1 >= 2 THEN 'regressed' END
      ELSE CASE WHEN state IN ('open', 'regressed') AND good + 1 >= 2 THEN 'resolved' END END
  FROM st JOIN q ON q.fp = st.fp AND q.i = st.i + 1)
SELECT fp, run, event, state FROM st WHERE event IS NOT NULL""")
def lifecycle_replay(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.replay(_log(spark, sf))


@query("SELECT kind, count(*) AS n, count(DISTINCT k) AS keys, round(sum(amount), 2) AS amount FROM (SELECT 'order' AS kind, o_orderkey AS k, o_totalprice AS amount FROM orders UNION ALL SELECT 'line', l_orderkey, NULL FROM lineitem) GROUP BY kind")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"))
    li = table(spark, sf, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("k"))
    return o.unionByName(li, allowMissingColumns=True).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("keys"), F.round(F.sum("amount"), 2).alias("amount"))


@query("""WITH h AS (SELECT o_custkey AS c, list_sort(list_distinct(list(o_orderpriority))) AS a FROM orders GROUP BY o_custkey), w AS (SELECT ['1-URGENT', '2-HIGH'] AS b)
SELECT c, array_to_string(a, ',') AS has, coalesce(array_to_string(list_filter(a, lambda x: list_contains(b, x)), ','), '') AS sensitive, len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS superset FROM h, w""")
def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    h = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("a"))
    return h.select("c", F.array_join("a", ",").alias("has"), F.array_join(F.array_intersect("a", wanted), ",").alias("sensitive"), (F.size(F.array_except(wanted, "a")) == 0).alias("superset"))


@query("SELECT 'c' || c_custkey AS host FROM customer EXCEPT SELECT DISTINCT 'c' || o_custkey FROM orders")
def never_seen_hosts(spark: SparkSession, sf: str) -> DataFrame:
    have, peers = _have(spark, sf)
    return peers.select("host").join(have, "host", "left_anti")


@query("""WITH s AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '\\\\srv\\share\\x.exe' WHEN c_custkey % 4 = 0 THEN '"C:\\Program Files\\App\\Run.EXE" /q' WHEN c_custkey % 4 = 1 THEN 'cmd.exe /c dir' WHEN c_custkey % 4 = 2 THEN '/usr/bin/Python3' ELSE 'C:\\Users\\bob\\a b\\evil.exe' END AS p FROM customer)
SELECT c_custkey, p, CASE WHEN c_acctbal_neg THEN 'x.exe' WHEN c_custkey % 4 = 0 THEN 'run.exe' WHEN c_custkey % 4 = 1 THEN 'cmd.exe' WHEN c_custkey % 4 = 2 THEN 'python3' ELSE 'evil.exe' END AS name, c_acctbal_neg OR c_custkey % 4 = 3 AS writable
FROM (SELECT s.*, starts_with(p, '\\\\') AS c_acctbal_neg FROM s)""".replace("\\\\", "\\"))
def process_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    p = F.when(F.col("c_acctbal") < 0, "\\srv\\share\\x.exe").when(k == 0, '"C:\\Program Files\\App\\Run.EXE" /q').when(k == 1, "cmd.exe /c dir").when(k == 2, "/usr/bin/Python3").otherwise("C:\\Users\\bob\\a b\\evil.exe")
    d = table(spark, sf, "customer").select("c_custkey", p.alias("p"))
    return d.select("c_custkey", "p", fn.process_name(F.col("p")).alias("name"), fn.user_writable(F.col("p")).alias("writable"))


@query(f"""{WITH}, u AS (SELECT src, arg_min(rule_id, (ts, event_id)) AS r FROM a GROUP BY src) SELECT r, count(DISTINCT src) AS hosts FROM u GROUP BY r""")
def hosts_by_first_label(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts by the rule of their first event in time."""
    first = alerts(spark, sf).groupBy("src").agg(F.min_by("rule_id", F.struct("ts", "event_id")).alias("r"))
    return first.groupBy("r").agg(F.count(F.lit(1)).alias("hosts"))


@query(f"""{WITH}, an AS (SELECT src AS host, max(s) AS start_s, CASE WHEN max(k) % 2 = 0 THEN 'drop' ELSE 'silent' END AS kind FROM a GROUP BY src), p AS (SELECT src AS host, s AS at_s FROM a WHERE lvl >= 10)
SELECT an.host, start_s, kind, count(*) AS n, max(at_s) AS latest_s FROM an JOIN p ON p.host = an.host AND at_s BETWEEN start_s - 7200 AND start_s + 600 + CASE WHEN kind = 'drop' THEN 3600 ELSE 0 END GROUP BY ALL""")
def tampering_precursors(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    gone = a.groupBy(F.col("src").alias("host")).agg(F.unix_seconds(F.max("ts")).alias("start_s"), F.when(F.max("k") % 2 == 0, "drop").otherwise("silent").alias("kind"))
    return causes.tampering(gone, a.filter("lvl >= 10").select(F.col("src").alias("host"), F.unix_seconds("ts").alias("at_s")))


@query(f"""{WITH}, pr AS (SELECT rule_id, src, ls, max(ts) AS t FROM a GROUP BY ALL), la AS (SELECT rule_id, max(t) AS rl FROM pr GROUP BY rule_id), lv AS (SELECT src, ls, max(ts) AS sl FROM a GROUP BY ALL)
SELECT rule_id, epoch_us(max(rl)) // 1000000 AS last_s, count(*) FILTER (epoch_us(sl) - epoch_us(rl) > 60000000) AS live_sources, count(*) AS sources, count(*) FILTER (epoch_us(sl) - epoch_us(rl) > 60000000) > 0 AS dark FROM pr JOIN lv USING (src, ls) JOIN la USING (rule_id) GROUP BY rule_id""")
def dark_rules(spark: SparkSession, sf: str) -> DataFrame:
    return causes.dark_rules(alerts(spark, sf))


@query(f"{WITH}, r AS (SELECT event_id, rule_id, src, count(*) OVER (PARTITION BY rule_id, src ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS recent FROM a) SELECT * FROM r WHERE recent >= 3")
def frequency_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return causes.correlated(alerts(spark, sf), 3, 86400).select("event_id", "rule_id", "src", "recent")


@query(f"""{WITH.replace("WITH", "WITH RECURSIVE", 1)}, s AS (SELECT rule_id, 'ls:' || ls AS subject, count(*) AS n, list(DISTINCT h) AS hours FROM a GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, subject) AS i FROM s),
g AS (SELECT DISTINCT rule_id, 0::BIGINT AS i, []::BIGINT[][] AS chosen, NULL::VARCHAR AS subject, NULL::BIGINT AS n, false AS took FROM o
UNION ALL SELECT rule_id, i, CASE WHEN ok THEN list_append(chosen, hours) ELSE chosen END, subject, n, ok FROM (SELECT o.*, g.chosen, len(g.chosen) < 5 AND len(list_filter(g.chosen, lambda c: len(list_intersect(c, o.hours)) >= 0.8 * least(len(c), len(o.hours)))) = 0 AS ok FROM g JOIN o ON o.rule_id = g.rule_id AND o.i = g.i + 1))
SELECT rule_id, subject, n, len(chosen) AS nth FROM g WHERE took""")
def scope_selection(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf)
    s = a.groupBy("rule_id", F.concat(F.lit("ls:"), "ls").alias("subject")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.floor(F.unix_seconds("ts") / 3600)).alias("hours"))
    return causes.select_scopes(s)
