"""Root causes over the levels of the cube, on losses planted in the events, and findings watched over days. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.cuts import checkpointed
from alertloom.operators import hierarchy
from alertloom.operators.alerts import alerts
from alertloom.plans.noise_queries import WITH
from alertloom.streaming import watch

QUERIES: dict = {}
#: Days of the past and of the end that are held against each other, and the least expectation of an anomaly.
PAST, LAST, LEAST = 20, 5, 1.5


def _levels(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Anomalies, needs, haves and monitored agents: hosts and channels that the last days lack, some of them planted."""
    a = alerts(spark, sf).select(F.unix_seconds("ts").alias("s"), F.floor(F.unix_seconds("ts") / 86400).alias("d"), F.col("src").alias("agent"), F.col("ls").alias("source"))
    d0, d1 = a.agg(F.min("d"), F.max("d")).first()
    i = F.substring("agent", 2, 9).cast("long")
    gone = (F.col("d") > d1 - LAST) & ((i % 7 == 0) | ((F.col("source") == "ch2") & (i % 4 > 0)) | ((F.col("source") == "ch1") & (i % 11 == 3)))
    a = checkpointed(a.filter(~gone))
    past, last = F.count_if(F.col("d") < d0 + PAST), F.count_if(F.col("d") > d1 - LAST)
    stats = (past * LAST / PAST).alias("expected"), last.alias("observed"), F.max("s").alias("last_s")
    all_levels = [("tenant", []), ("agent", ["agent"]), ("source", ["source"]), ("pair", ["agent", "source"])]
    none = lambda c: F.lit(None).cast("string").alias(c)
    rows = [a.groupBy(*by).agg(*stats).select(F.lit(level).alias("level"), *[F.col(c) if c in by else none(c) for c in ("agent", "source")], "expected", "observed", "last_s") for level, by in all_levels]
    e = rows[0]
    for r in rows[1:]:
        e = e.unionByName(r)
    e = checkpointed(e.withColumn("need", F.col("expected") - F.col("observed")))
    status = F.when(F.col("observed") == 0, "silent").when(F.col("observed") < 0.3 * F.col("expected"), "drop").when(F.col("observed") < 0.8 * F.col("expected"), "decay")
    fit = e.filter(F.col("expected") >= LEAST)
    found = fit.withColumn("status", status).filter("status is not null")
    found = found.select("level", "agent", "source", "status", F.when(F.col("status") == "silent", F.col("last_s")).otherwise((d1 - LAST + 1) * 86400).alias("onset_s"), F.lit(False).alias("always_on"), "need")
    pairs = found.filter("level = 'pair'").select("agent", "source", F.greatest(F.lit(0.0), "need").alias("have"))
    have = pairs.select(F.lit("agent").alias("level"), "agent", none("source"), F.col("agent").alias("by_agent"), F.col("source").alias("by_source"), "have").unionByName(
        pairs.select(F.lit("source").alias("level"), none("agent"), "source", F.col("agent").alias("by_agent"), F.col("source").alias("by_source"), "have")
    )
    monitored = fit.filter("level = 'pair'").groupBy("agent").agg(F.count(F.lit(1)).alias("channels"))
    return found.drop("need"), found.select("level", "agent", "source", "need"), have, monitored


def root_causes(spark: SparkSession, sf: str) -> DataFrame:
    """Of each anomalous tenant, host, channel and pair what explains it, from the top down."""
    return hierarchy.resolve(*_levels(spark, sf))


SQL = f"""{WITH}, w AS (SELECT min(d) AS d0, max(d) AS d1 FROM a),
b AS (SELECT s, d, src AS agent, ls AS source, d0, d1 FROM a, w WHERE NOT (d > d1 - {LAST} AND (substr(src, 2)::BIGINT % 7 = 0 OR ls = 'ch2' AND substr(src, 2)::BIGINT % 4 > 0 OR ls = 'ch1' AND substr(src, 2)::BIGINT % 11 = 3))),
e AS (SELECT CASE WHEN grouping(agent) = 1 AND grouping(source) = 1 THEN 'tenant' WHEN grouping(source) = 1 THEN 'agent' WHEN grouping(agent) = 1 THEN 'source' ELSE 'pair' END AS level, agent, source,
  count(*) FILTER (d < d0 + {PAST}) * {LAST} / {PAST} AS expected, count(*) FILTER (d > d1 - {LAST}) AS observed, max(s) AS last_s, any_value(d1) AS d1 FROM b GROUP BY GROUPING SETS ((), (agent), (source), (agent, source))),
f AS (SELECT *, expected - observed AS need, CASE WHEN observed = 0 THEN 'silent' WHEN observed < 0.3 * expected THEN 'drop' WHEN observed < 0.8 * expected THEN 'decay' END AS status FROM e WHERE expected >= {LEAST}),
x AS (SELECT *, CASE WHEN status = 'silent' THEN last_s ELSE (d1 - {LAST - 1}) * 86400 END AS onset FROM f WHERE status IS NOT NULL),
mo AS (SELECT agent, count(*) AS channels FROM f WHERE level = 'pair' GROUP BY agent),
ag AS (SELECT p.agent, p.status, p.onset, p.need, count(k.source) AS kids, any_value(k.source) AS sole, any_value(greatest(0, k.need)) AS have FROM x p LEFT JOIN x k ON k.level = 'pair' AND k.agent = p.agent WHERE p.level = 'agent' GROUP BY ALL),
ac AS (SELECT ag.*, status <> 'silent' AND kids = 1 AND need > 0 AND have >= 0.7 * need AS carried, coalesce(channels, 0) AS channels FROM ag LEFT JOIN mo USING (agent)),
su AS (SELECT onset FROM ac WHERE (NOT carried OR channels < 2) AND status IN ('silent', 'drop')),
sp AS (SELECT y.onset AS lo, count(*) AS n, max(z.onset) AS hi FROM (SELECT DISTINCT onset FROM su) y JOIN su z ON z.onset BETWEEN y.onset AND y.onset + 7200 GROUP BY y.onset),
ou AS (SELECT coalesce((SELECT onset FROM x WHERE level = 'tenant' AND status = 'silent'), (SELECT arg_min(lo, (-n, lo)) FROM sp WHERE n >= 0.3 * (SELECT count(*) FROM mo) AND n >= 5)) AS lo, coalesce((SELECT onset FROM x WHERE level = 'tenant' AND status = 'silent'), (SELECT arg_min(hi, (-n, lo)) FROM sp WHERE n >= 0.3 * (SELECT count(*) FROM mo) AND n >= 5)) AS hi),
g AS (SELECT x.*, CASE WHEN status = 'silent' THEN onset BETWEEN lo - 3600 AND hi + 3600 WHEN status = 'drop' THEN onset BETWEEN lo - 7200 AND hi + 7200 ELSE false END IS TRUE AS same FROM x, ou),
a1 AS (SELECT g.agent, g.status, CASE WHEN same THEN 'all' WHEN carried THEN 'pair/' || g.agent || '/' || sole ELSE 'itself' END AS "by" FROM g JOIN ac ON ac.agent = g.agent WHERE level = 'agent'),
p1 AS (SELECT g.agent, g.source, g.status, g.need, CASE WHEN same OR a1."by" = 'all' THEN 'all' WHEN a1."by" = 'itself' THEN 'agent/' || g.agent END AS "by" FROM g LEFT JOIN a1 ON a1.agent = g.agent WHERE level = 'pair'),
ow AS (SELECT source, sum(have) AS have, arg_min("by", (-have, "by")) AS owner FROM (SELECT source, "by", sum(greatest(0, need)) AS have FROM p1 WHERE "by" IS NOT NULL GROUP BY ALL) GROUP BY source),
le AS (SELECT source, count(*) AS n, sum(greatest(0, need)) AS have, any_value(agent) AS one FROM p1 WHERE "by" IS NULL GROUP BY source),
s1 AS (SELECT g.source, g.status, CASE WHEN same THEN 'all' WHEN g.need > 0 AND ow.have >= 0.7 * g.need THEN owner WHEN g.need > 0 AND n = 1 AND le.have >= 0.7 * g.need THEN 'pair/' || one || '/' || g.source ELSE 'itself' END AS "by" FROM g LEFT JOIN ow ON ow.source = g.source LEFT JOIN le ON le.source = g.source WHERE level = 'source'),
p2 AS (SELECT p1.agent, p1.source, p1.status, CASE WHEN p1."by" IS NOT NULL THEN p1."by" WHEN s1."by" = 'itself' THEN 'source/' || p1.source WHEN s1."by" = 'all' THEN 'all' ELSE 'itself' END AS "by" FROM p1 LEFT JOIN s1 USING (source)),
u AS (SELECT 'agent' AS level, agent, NULL AS source, status, "by" FROM a1 UNION ALL SELECT 'source', NULL, source, status, "by" FROM s1 UNION ALL SELECT 'pair', agent, source, status, "by" FROM p2)
SELECT * FROM u UNION ALL SELECT 'tenant', NULL, NULL, status, CASE WHEN status = 'silent' OR NOT EXISTS (SELECT 1 FROM u WHERE "by" IN ('itself', 'all')) THEN 'itself' ELSE 'below' END FROM x WHERE level = 'tenant'"""
QUERIES["root_causes"] = (root_causes, SQL)


def watched_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions of a finding for each host over its days, forgotten after two days and more without a run; what the stream with timers gives."""
    log = alerts(spark, sf).groupBy(F.col("src").alias("fp"), F.floor(F.unix_seconds("ts") / 86400).alias("run")).agg(F.max("ts").alias("ts"), F.bool_or(F.col("lvl") >= 10).alias("present"))
    return watch.replay(log, FORGET)


FORGET = 2 * 86400
WATCHED = f"""{WITH.replace("WITH ", "WITH RECURSIVE ", 1)}, r AS (SELECT src AS fp, d AS run, max(s) AS at_s, bool_or(lvl >= 10) AS p FROM a GROUP BY ALL), g AS (SELECT *, at_s - lag(at_s) OVER (PARTITION BY fp ORDER BY run) AS gap FROM r),
q AS (SELECT *, count(*) FILTER (gap > {FORGET}) OVER (PARTITION BY fp ORDER BY run) AS part FROM g), o AS (SELECT *, row_number() OVER (PARTITION BY fp, part ORDER BY run) AS i FROM q),
st AS (SELECT fp, part, 0::BIGINT AS i, 'none' AS state, 0 AS bad, 0 AS good, NULL::VARCHAR AS event, NULL::BIGINT AS run FROM (SELECT DISTINCT fp, part FROM o) UNION ALL
  SELECT o.fp, o.part, o.i, CASE WHEN p THEN CASE WHEN state = 'none' THEN 'new' WHEN state = 'new' AND bad >= 1 THEN 'open' WHEN state = 'resolved' AND bad >= 1 THEN 'regressed' ELSE state END WHEN state = 'new' THEN 'none' WHEN state IN ('open', 'regressed') AND good >= 1 THEN 'resolved' ELSE state END,
    CASE WHEN p THEN bad + 1 ELSE 0 END, CASE WHEN p THEN 0 ELSE good + 1 END, CASE WHEN p THEN CASE WHEN state = 'none' THEN 'new' WHEN state = 'new' AND bad >= 1 THEN 'opened' WHEN state = 'resolved' AND bad >= 1 THEN 'regressed' END WHEN state IN ('open', 'regressed') AND good >= 1 THEN 'resolved' END, o.run
  FROM st JOIN o ON o.fp = st.fp AND o.part = st.part AND o.i = st.i + 1)
SELECT fp, run, event, state FROM st WHERE event IS NOT NULL
UNION ALL SELECT fp, run, 'forgotten', state FROM (SELECT st.*, at_s, max(st.i) OVER (PARTITION BY st.fp, st.part) AS last_i, max(st.part) OVER (PARTITION BY st.fp) AS last_part, max(at_s) OVER () AS end_s FROM st JOIN o USING (fp, part, i)) WHERE i = last_i AND (part < last_part OR end_s - at_s > {FORGET})"""
QUERIES["watched_findings"] = (watched_findings, WATCHED)
