"""Queries over raw files: the driver tables written as logs, arrays, search responses and delimited files, then scanned. With SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.cuts import folder, lines_of
from alertloom.operators.alerts import table
from alertloom.plans.noise_queries import WITH
from alertloom.sources import documents, tables

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """id, at (text of the time), rule, user, k, value of every event."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return e.select(F.col("event_id").alias("id"), at.alias("at"), F.col("event_type").alias("rule"), F.col("user_id").alias("user"), k.alias("k"))


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _text(c: str) -> Column:
    return F.col(c).cast("string")


_LINES = f"""{WITH}, l AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'cut' WHEN event_id % 101 = 0 THEN 'blank' WHEN event_id % 103 = 0 THEN 'array' ELSE 'doc' END AS kind FROM a)"""


@query(f"{_LINES} SELECT kind <> 'doc' AS malformed, count(*) AS n, sum(CASE WHEN kind = 'doc' THEN event_id END)::BIGINT AS ids FROM l WHERE kind <> 'blank' GROUP BY ALL")
def scan_ndjson(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents, some cut off, blank or no object: blank ones don't count, the others are malformed."""
    e = _events(spark, sf)
    whole = _json(id=F.col("id"), rule=F.struct(F.col("rule").alias("id")), user=F.col("user"))
    line = F.when(F.col("id") % 97 == 0, F.expr("substring(line, 1, length(line) - 3)")).when(F.col("id") % 101 == 0, "  ").when(F.col("id") % 103 == 0, F.concat(F.lit("["), F.col("line"), F.lit("]"))).otherwise(F.col("line"))
    path = lines_of(e.select("id", whole.alias("line")).select(line.alias("value")))
    return documents.ndjson(spark, path).groupBy("malformed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("doc", "$.id", "long")).alias("ids"))


@query(f"{WITH} SELECT event_id // 2000 AS part, rule_id AS rule, count(*) AS n, sum(event_id)::BIGINT AS ids FROM a GROUP BY ALL")
def scan_json_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold one array of documents each."""
    e = _events(spark, sf).withColumn("part", F.floor(F.col("id") / 2000))
    arrays = e.groupBy("part").agg(F.to_json(F.collect_list(F.struct("id", "rule"))).alias("value"))
    d = documents.documents(spark, lines_of(arrays, "part"))
    get = lambda p, t: F.try_variant_get("doc", p, t)
    return d.groupBy(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), get("$.rule", "string").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.sum(get("$.id", "long")).alias("ids"))


@query(f"{WITH} SELECT event_id // 2000 AS part, count(*) AS n, sum(event_id)::BIGINT AS ids, false AS malformed FROM a WHERE event_id // 2000 % 5 <> 4 GROUP BY ALL UNION ALL SELECT DISTINCT event_id // 2000, 1, NULL, true FROM a WHERE event_id // 2000 % 5 = 4")
def scan_search_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold a search response each, every fifth one cut off: that one is malformed as a whole."""
    e = _events(spark, sf).withColumn("part", F.floor(F.col("id") / 2000))
    hits = F.collect_list(F.struct(F.struct("id", "rule").alias("_source"), F.lit("x").alias("_index")))
    files = e.groupBy("part").agg(F.to_json(F.struct(F.struct(hits.alias("hits")).alias("hits"))).alias("value"))
    files = files.withColumn("value", F.when(F.col("part") % 5 == 4, F.expr("substring(value, 1, length(value) - 4)")).otherwise(F.col("value")))
    d = documents.documents(spark, lines_of(files, "part"))
    return d.groupBy(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "malformed").agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_variant_get("doc", "$.id", "long")).alias("ids"))


@query(f"""{WITH} SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE rule_id END AS rule, 'a;b "' || src || '"' AS note, CASE WHEN event_id % 5 <> 0 THEN k END AS k FROM a""")
def scan_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Files separated by semicolons, with quoted cells and texts that mean no value."""
    e = _events(spark, sf)
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(";", _text("id"), F.when(F.col("id") % 7 == 0, "N/A").otherwise(F.col("rule")), quoted(F.concat(F.lit('a;b "u'), _text("user"), F.lit('"'))), F.when(F.col("id") % 5 == 0, "").otherwise(_text("k")))
    e = e.select(F.floor(F.col("id") / 5000).alias("part"), "id", line.alias("line"))
    # a header in front of each file
    head = e.select("part").distinct().select("part", F.lit(-1).cast("long").alias("id"), F.lit(" id ;rule;note;k").alias("line"))
    files = e.unionByName(head).repartition("part").sortWithinPartitions("part", "id").select("part", F.col("line").alias("value"))
    path = f"{folder(spark)}/csv-{uuid.uuid4().hex}"
    files.write.partitionBy("part").text(path)
    d = documents.csv(spark, path)
    return d.select(F.col("id").cast("long").alias("id"), "rule", "note", F.col("k").cast("long").alias("k"))


def _shaped(e: DataFrame) -> DataFrame:
    """(part, value): each event as a document of one of five shapes, by id; a file holds one shape, every tenth line of another."""
    rule, agent = F.concat(F.lit("r"), F.col("rule")), F.concat(F.lit("u"), _text("user"))
    place = F.concat(F.lit("ch"), F.col("k") % 4)
    old = _json(timestamp=F.col("at"), id=_text("id"), rule=F.struct(rule.alias("id"), (F.col("k") % 16).alias("level"), F.col("rule").alias("description")), agent=F.struct(F.lit("007").alias("id"), agent.alias("name")), location=place, data=F.struct(F.concat(F.lit("10.0.0."), F.col("k") % 250).alias("srcip")))
    nested = _json(**{"@timestamp": F.col("at"), "event": F.struct(F.lit("alert").alias("kind"), place.alias("dataset"), _text("k").alias("code"), _text("id").alias("id")), "rule": F.struct(rule.alias("id"), F.col("rule").alias("name")), "host": F.struct(agent.alias("name")), "user": F.struct(agent.alias("name"))})
    dotted = _json(**{"@timestamp": F.col("at"), "kibana.alert.rule.uuid": rule, "kibana.alert.rule.name": F.col("rule"), "kibana.alert.severity": F.when(F.col("k") % 2 == 0, "high").otherwise("low"), "host.name": agent, "event.dataset": place, "event.code": _text("k"), "event.id": _text("id"), "user.name": F.array(F.lit("-"), agent)})
    five = _json(**{"@timestamp": F.col("at"), "wazuh": F.struct(F.struct(rule.alias("id"), (F.col("k") % 101).alias("level")).alias("rule"), F.struct(agent.alias("name")).alias("agent")), "event": F.struct(place.alias("dataset"), _text("id").alias("id"))})
    other = _json(when=F.col("at"), sig=rule, title=F.col("rule"), sev=(F.col("k") % 16).cast("string"), box=agent, ch=place, nr=_text("id"))
    kind = F.when(F.col("id") % 10 == 9, F.floor(F.col("id") / 10) % 5).otherwise(F.col("part") % 5)
    shape = F.when(kind == 0, old).when(kind == 1, nested).when(kind == 2, dotted).when(kind == 3, five).otherwise(other)
    return e.withColumn("part", F.floor(F.col("id") / 1000)).select("part", shape.alias("value"))


_KIND = "CASE WHEN event_id % 10 = 9 THEN event_id // 10 % 5 ELSE event_id // 1000 % 5 END"
_NAMES = "['wazuh4', 'ecs', 'ecs', 'wazuh5', 'generic']"


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    return documents.by_file(documents.ndjson(spark, lines_of(_shaped(_events(spark, sf)), "part")))


@query(f"""{WITH}, d AS (SELECT event_id // 1000 AS part, {_NAMES}[{_KIND} + 1] AS p FROM a),
v AS (SELECT part, p, count(*) AS n FROM d WHERE p <> 'generic' GROUP BY ALL), best AS (SELECT part, arg_min(p, (-n, list_position(['wazuh4', 'wazuh5', 'ecs'], p))) AS profile FROM v GROUP BY part)
SELECT part, coalesce(any_value(profile), 'generic') AS profile, count(*) AS n FROM d LEFT JOIN best USING (part) GROUP BY part""")
def profile_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """The profile that most documents of a file speak for."""
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long")
    return _scan(spark, sf).groupBy(part.alias("part"), "profile").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{WITH}, d AS (SELECT {_NAMES}[{_KIND} + 1] AS p, event_id FROM a) SELECT p AS profile, count(*) AS n, sum(event_id)::BIGINT AS ids FROM d GROUP BY ALL""")
def profile_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The profile that each document's own shape speaks for."""
    d = documents.ndjson(spark, lines_of(_shaped(_events(spark, sf)), "part"))
    ids = F.coalesce(documents.at("id"), documents.at("event.id"), documents.at("nr")).cast("long")
    return d.groupBy(F.coalesce(documents.profile(), F.lit("generic")).alias("profile")).agg(F.count(F.lit(1)).alias("n"), F.sum(ids).alias("ids"))


def _projected(kinds: tuple[int, ...], kind: str, mapping: dict[str, str] | None = None):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = _events(spark, sf).filter((F.col("id") % 10 != 9) & (F.floor(F.col("id") / 1000) % 5).isin(*kinds))
        d = documents.normalised(documents.ndjson(spark, lines_of(_shaped(e), "part")), kind, mapping)
        cols = ["event_id", "rule_id", "rule_name", "severity", "source", "log_source", "event_code"]
        return d.select(*cols, F.unix_seconds("ts").alias("at_s"), F.col("entities")["user"].alias("user"), F.col("entities")["src_ip"].alias("src_ip"), F.col("entities")["host"].alias("host"))

    return run


def _wanted(kinds: str, severity: str, code: str = "NULL", user: str = "NULL", ip: str = "NULL", name: str = "rule_id") -> str:
    return f"""{WITH} SELECT event_id::VARCHAR AS event_id, 'r' || rule_id AS rule_id, {name} AS rule_name, ({severity})::INT AS severity, src AS source, ls AS log_source, {code} AS event_code, s AS at_s,
{user} AS user, {ip} AS src_ip, src AS host FROM a WHERE event_id % 10 <> 9 AND event_id // 1000 % 5 IN ({kinds})"""


@query(_wanted("0", "k % 16", ip="'10.0.0.' || (k % 250)"))
def project_wazuh4(spark: SparkSession, sf: str) -> DataFrame:
    return _projected((0,), "wazuh4")(spark, sf)


@query(_wanted("1, 2", "CASE WHEN event_id // 1000 % 5 = 2 THEN CASE WHEN k % 2 = 0 THEN 10 ELSE 3 END END", "k::VARCHAR", "src"))
def project_ecs(spark: SparkSession, sf: str) -> DataFrame:
    return _projected((1, 2), "ecs")(spark, sf)


@query(_wanted("3", "CASE WHEN k % 101 <= 16 THEN k % 101 WHEN k % 101 <= 21 THEN 3 WHEN k % 101 <= 47 THEN 7 WHEN k % 101 <= 73 THEN 10 ELSE 13 END", name="NULL"))
def project_wazuh5(spark: SparkSession, sf: str) -> DataFrame:
    return _projected((3,), "wazuh5")(spark, sf)


@query(_wanted("4", "k % 16", user="src"))
def project_generic(spark: SparkSession, sf: str) -> DataFrame:
    return _projected((4,), "generic", {"ts": "time|when", "rule_id": "Sig|sig", "rule_name": "title", "severity": "sev", "source": "box", "log_source": "ch", "event_id": "nr", "user": "box"})(spark, sf)


@query(f"""{WITH}, v AS (SELECT *, CASE event_id % 6 WHEN 0 THEN 'tp' WHEN 1 THEN 'fp' WHEN 2 THEN 'btp' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'untriaged' ELSE 'odd' END AS verdict FROM a WHERE event_id % 11 <> 0 OR event_id % 22 = 0)
SELECT CASE WHEN event_id % 4 <> 0 THEN event_id::VARCHAR END AS alert_id, CASE WHEN event_id % 4 < 3 THEN rule_id END AS rule_id, verdict, s AS closed_s,
CASE WHEN event_id % 4 <> 0 THEN 'alert' WHEN event_id % 8 = 0 THEN 'condition' ELSE 'rule' END AS scope, verdict = 'odd' AS bad, count(*) AS n FROM v GROUP BY ALL""")
def dispositions_file(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of analysts from a file with other headers and spellings, one tenant's."""
    e = _events(spark, sf)
    i = F.col("id")
    said = F.when(i % 6 == 0, "True Positive").when(i % 6 == 1, "fp").when(i % 6 == 2, " benign ").when(i % 6 == 3, "DUP").when(i % 6 == 4, "").otherwise("odd")
    cells = [F.when(i % 4 != 0, _text("id")).otherwise(""), F.when(i % 4 < 3, F.col("rule")).otherwise("-"), F.when(i % 8 == 0, "source").otherwise(""), F.when(i % 8 == 0, F.lit("u1")).otherwise(""), said, F.col("at"), F.when(i % 11 != 0, "ACME").when(i % 22 == 0, "").otherwise("other")]
    head = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("alert,rule,field,value,disposition,closed,customer").alias("value"))
    rows = e.select("id", F.concat_ws(",", *cells).alias("value")).unionByName(head)
    path = lines_of(rows.repartition(1).sortWithinPartitions("id").select("value"))
    d = tables.dispositions(spark, path, "acme")
    return d.groupBy("alert_id", "rule_id", "verdict", "closed_s", "scope", "bad").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey::VARCHAR AS agent, 'host' || c_custkey AS name, CASE c_custkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'disconnected' ELSE 'never_connected' END AS status,
CASE WHEN c_custkey % 3 < 2 THEN 1700000000 + c_custkey END AS keepalive_s, CASE WHEN c_custkey % 5 > 0 THEN 'os' || (c_nationkey % 4) END AS platform FROM customer""")
def inventory_files(spark: SparkSession, sf: str) -> DataFrame:
    """Agents from inventory files: whole responses, their data, or bare lists."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").cast("long").alias("m"))
    status = F.when(F.col("k") % 3 == 0, "Active").when(F.col("k") % 3 == 1, "disconnected").otherwise("never_connected")
    alive = F.when(F.col("k") % 3 < 2, F.date_format(F.timestamp_seconds(F.col("k") + 1700000000), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    item = F.struct(_text("k").alias("id"), F.concat(F.lit("host"), _text("k")).alias("name"), status.alias("status"), alive.alias("lastKeepAlive"), F.struct(F.when(F.col("k") % 5 > 0, F.concat(F.lit("OS"), F.col("m") % 4)).otherwise("N/A").alias("platform")).alias("os"))
    f = c.withColumn("part", F.floor(F.col("k") / 500)).groupBy("part").agg(F.collect_list(item).alias("x"))
    bare, data = F.to_json("x"), F.struct(F.col("x").alias("affected_items"))
    text = F.when(F.col("part") % 3 == 0, F.to_json(F.struct(data.alias("data")))).when(F.col("part") % 3 == 1, F.to_json(data)).otherwise(bare)
    return tables.inventory(spark, lines_of(f.select("part", text.alias("value")), "part"))
