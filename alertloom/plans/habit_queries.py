"""Queries on the habits of sources. Each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.operators import cube, habits, rhythm
from alertloom.operators.alerts import alerts, r6
from alertloom.plans.cube_queries import _ALL, _DISP, _fitted
from alertloom.plans.noise_queries import WITH
from alertloom.plans.rhythm_queries import _days, _dense

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""{WITH}, w AS (SELECT min(h) - 2000 AS lo, max(h) + 2000 AS hi, min(d) AS d0 FROM a), hs AS (SELECT unnest(range(lo, hi + 1)) AS h FROM w),
l AS (SELECT h, timezone('America/New_York', timezone('UTC', make_timestamp(h * 3600000000 + 1800000000))) AS lt FROM hs), x AS (SELECT h, (isodow(lt) - 1) * 24 + hour(lt) AS slot, date_diff('day', DATE '1970-01-01', lt::DATE) AS day, hour(lt) AS hod FROM l)
SELECT h, slot, day, day % 10 = 3 AS off, count(*) OVER (PARTITION BY day) = 24 AND day IN (SELECT day FROM x GROUP BY day HAVING count(DISTINCT hod) = 24) AS regular FROM x""")
def local_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Hours around the events on a local clock, with a change of summer time and a calendar."""
    lo, hi = alerts(spark, sf).agg(F.floor(F.unix_seconds(F.min("ts")) / 3600) - 2000, F.floor(F.unix_seconds(F.max("ts")) / 3600) + 2000).first()
    off = spark.range(lo // 24 - 2, hi // 24 + 2).filter("id % 10 = 3").select(F.col("id").alias("day"))
    return habits.clock(spark, lo, hi, "America/New_York", off)


@query(f"""{_ALL}, s AS (SELECT key1, slot, sum(n) AS c, count(*) AS m FROM b GROUP BY ALL), m AS (SELECT key1, avg(n) AS mean FROM b GROUP BY key1),
r AS (SELECT s.*, mean, mean * weight AS rate FROM s JOIN m USING (key1) JOIN p ON p.key1 = s.key1 AND p.hod = s.slot % 24), o AS (SELECT *, CASE WHEN rate > 0 THEN (c + 1.0::DOUBLE) / (m + 1.0::DOUBLE / rate) ELSE 0 END AS own FROM r),
t AS (SELECT *, CASE WHEN sum(own) OVER w > 0 THEN mean * own * count(*) OVER w / sum(own) OVER w END AS alt FROM o WINDOW w AS (PARTITION BY key1))
SELECT key1, slot, round(rate, 6) AS rate, round(alt, 6) AS alt, round(least(rate, alt), 6) AS low FROM t""")
def hour_of_week_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of the second model: own counts by hour of the week."""
    _, b, p = _fitted(spark, sf)
    d = habits.alternate(b, p)
    return d.select("key1", "slot", *[r6(F.col(c)).alias(c) for c in ("rate", "alt", "low")])


_OFF = f"""{WITH}, {_dense("src", "d")}, e AS (SELECT key, t, n, avg(n) OVER (PARTITION BY key) * 3 AS expected FROM z),
dd AS (SELECT key, CASE WHEN key < 'u12' THEN 'critical' ELSE 'standard' END AS tier, length(key) AS peer, count(*) FILTER (n <= 0) AS events, count(*) AS days FROM e WHERE expected >= 3 GROUP BY key),
pt AS (SELECT peer, sum(events) / sum(days) AS mean FROM dd GROUP BY peer), po AS (SELECT peer, count(*) AS m, var_samp(events / days) AS var, avg(1 / days) AS inv FROM dd WHERE days >= 5 GROUP BY peer),
pr AS (SELECT peer, mean, CASE WHEN mean <= 0 OR mean >= 1 THEN 200 WHEN coalesce(m, 0) < 3 THEN 2 WHEN var - mean * (1 - mean) * inv <= 0 THEN 200 ELSE greatest(2, least(200, mean * (1 - mean) / (var - mean * (1 - mean) * inv) - 1)) END AS weight FROM pt LEFT JOIN po USING (peer)),
tail AS (SELECT key, sum(exp(lgamma(days + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - CASE WHEN days > j THEN lgamma(days - j + 1) ELSE 0 END + j * ln(mean) + (days - j) * ln(1 - mean))) AS p FROM (SELECT key, peer, events, days, unnest(range(events + 1)) AS j FROM dd) JOIN pr USING (peer) WHERE mean > 0 AND mean < 1 GROUP BY key),
f AS (SELECT dd.*, CASE WHEN alone THEN 0 ELSE mean END AS mean, CASE WHEN alone THEN 2 ELSE weight END AS weight FROM (SELECT dd.key, tier = 'critical' OR coalesce(p < 0.01, false) OR mean >= 1 AND events < days AS alone, mean, weight FROM dd JOIN pr USING (peer) LEFT JOIN tail ON tail.key = dd.key) JOIN dd USING (key)),
rr AS (SELECT key, tier, peer, events, days, (events + weight * mean) / (days + weight) AS rate FROM f)"""


def _off(spark: SparkSession, sf: str):
    d = _days(alerts(spark, sf), "src")
    n = d.groupBy("key").agg((F.avg("n") * 3).alias("expected"))
    d = d.join(n, "key")
    per = d.filter("expected >= 3").groupBy("key").agg(F.count_if(F.col("n") <= 0).alias("events"), F.count(F.lit(1)).alias("days"))
    return d, per.select("key", F.when(F.col("key") < "u12", "critical").otherwise("standard").alias("tier"), F.length("key").cast("long").alias("peer"), "events", "days")


@query(f"{_OFF} SELECT key, tier, peer, events, days, round(rate, 6) AS rate FROM rr")
def day_off_rates(spark: SparkSession, sf: str) -> DataFrame:
    """How often sources have a day off, by their record and their peers'."""
    return habits.day_rates(_off(spark, sf)[1], ["peer"]).withColumn("rate", r6(F.col("rate"))).select("key", "tier", "peer", "events", "days", "rate")


@query(f"""WITH RECURSIVE {_OFF.removeprefix("WITH ")}, el AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i, max(t) OVER (PARTITION BY key) AS last_t FROM e WHERE expected >= 3),
o AS (SELECT *, i - row_number() OVER (PARTITION BY key ORDER BY t) AS island FROM el WHERE n <= 0), ru AS (SELECT length(key) AS peer, count(*) AS len, bool_or(t = last_t) AS censored FROM o GROUP BY key, island),
ov AS (SELECT peer, (sum(len - 1) + 2 * any_value(mean)) / (sum(len - 1) + count(*) FILTER (NOT censored) + 2) AS stay FROM ru JOIN pr USING (peer) GROUP BY peer),
pts AS (SELECT peer, j, count(*) FILTER (len > j) AS more, count(*) FILTER (len > j OR len = j AND NOT censored) AS risk FROM ru, (SELECT unnest(range(1, 15)) AS j) GROUP BY peer, j),
curve AS (SELECT peer, 0::BIGINT AS j, stay FROM ov UNION ALL SELECT c.peer, pts.j, greatest(c.stay, (more + 2 * c.stay) / (risk + 2)) FROM curve c JOIN pts ON pts.peer = c.peer AND pts.j = c.j + 1)
SELECT peer, j AS after, round(stay, 6) AS stay FROM curve WHERE j > 0""")
def day_off_stays(spark: SparkSession, sf: str) -> DataFrame:
    """How likely one more day off is after some, by peers."""
    d, per = _off(spark, sf)
    runs = rhythm.days_off(d).select(F.length("key").cast("long").alias("peer"), "length", "censored")
    rates = per.groupBy("peer").agg((F.sum("events") / F.sum("days")).alias("rate"))
    return habits.staying_off(runs, rates, "peer").withColumn("stay", r6(F.col("stay")))


@query(f"""{WITH}, o AS (SELECT src AS key, max(s) - max(s) % 1800 AS at_s, max(k) % 2 = 0 AS steady FROM a GROUP BY src), sp AS (SELECT x.at_s, count(*) AS n, count(*) FILTER (y.steady) AS steady FROM (SELECT DISTINCT at_s FROM o) x JOIN o y ON y.at_s BETWEEN x.at_s AND x.at_s + 7200 GROUP BY x.at_s),
best AS (SELECT at_s AS f FROM sp WHERE n >= 0.3 * 20 AND (steady >= 3 OR n >= 5) ORDER BY n DESC, at_s LIMIT 1)
SELECT key, at_s, steady, coalesce(at_s BETWEEN f AND f + 7200, false) AS outage FROM o LEFT JOIN best ON true""")
def outage_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that fell quiet together, against a fleet of twenty."""
    s = F.unix_seconds(F.max("ts"))
    o = alerts(spark, sf).groupBy(F.col("src").alias("key")).agg((s - s % 1800).alias("at_s"), (F.max("k") % 2 == 0).alias("steady"))
    return habits.outage(o, 20)


@query(f"""{WITH}, c AS (SELECT src, ls, count(*) FILTER (d % 2 = 0) - count(*) FILTER (d % 2 = 1) AS deficit FROM a GROUP BY ALL), p AS (SELECT src, sum(deficit)::DOUBLE AS deficit FROM c GROUP BY src),
h AS (SELECT src, sum(greatest(deficit, 0)) AS have, count(*) AS children FROM c WHERE deficit >= 2 GROUP BY src)
SELECT p.src AS parent, p.deficit, coalesce(children, 0) AS children, round(CASE WHEN deficit > 0 THEN coalesce(have, 0) / deficit END, 6) AS share, coalesce(children, 0) > 0 AND deficit > 0 AND coalesce(have, 0) >= 0.7 * deficit AS explained FROM p LEFT JOIN h USING (src)""")
def explained_deficits(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts whose missing events their silent channels account for."""
    odd = F.floor(F.unix_seconds("ts") / 86400) % 2
    c = alerts(spark, sf).groupBy("src", "ls").agg((F.count_if(odd == 0) - F.count_if(odd == 1)).cast("double").alias("deficit"))
    kids = c.filter("deficit >= 2").select(F.col("src").alias("parent"), F.col("ls").alias("child"), "deficit")
    return habits.explained(c.groupBy(F.col("src").alias("parent")).agg(F.sum("deficit").alias("deficit")), kids).withColumn("share", r6(F.col("share")))


_BURSTS = _ALL.replace("FROM events)", "FROM events WHERE epoch_us(ts) // 25200000000 % 3 = 0)")


@query(f"""{_BURSTS}, {_DISP}, hr AS (SELECT b.key1 AS key, b.h, b.n, k.k * ln(1 + mean * weight / k.k) AS cost, b.h // 24 AS day FROM b JOIN p ON p.key1 = b.key1 AND p.hod = slot % 24 JOIN k ON k.key1 = b.key1),
ev AS (SELECT *, count(*) FILTER (n > 0) OVER (PARTITION BY key ORDER BY h) AS ev FROM hr), q AS (SELECT key, ev, h, cost, day, min(h) OVER r AS first, min(day) OVER r AS fd FROM ev WHERE ev > 0 AND n <= 0 WINDOW r AS (PARTITION BY key, ev)),
e AS (SELECT key, ev, cost AS fin, day AS ed FROM ev WHERE n > 0), ru AS (SELECT q.key, q.first, round(sum(CASE WHEN q.h > q.first AND q.day = q.fd THEN q.cost ELSE 0 END), 9) AS on_, coalesce(max(e.fin) FILTER (e.ed = q.fd), 0) AS fin FROM q LEFT JOIN e ON e.key = q.key AND e.ev = q.ev + 1 GROUP BY q.key, q.first),
nn AS (SELECT *, count(*) OVER (PARTITION BY key) AS runs, row_number() OVER (PARTITION BY key ORDER BY on_, first) AS place FROM ru WHERE on_ + fin >= 0.5), ke AS (SELECT *, place <= runs - greatest(1, runs // 10) AS kept FROM nn WHERE runs > 5),
ca AS (SELECT *, max(on_) FILTER (kept) OVER (PARTITION BY key) AS cap FROM ke), so AS (SELECT key, runs, sum(least(on_, cap)) AS on_ FROM ca GROUP BY ALL), th AS (SELECT unnest(range(4097)) AS i), tv AS (SELECT i, exp(ln(1e-6::DOUBLE) * (1 - i / 4096)) AS theta FROM th),
te AS (SELECT ca.key, i, sum(ln(greatest(1 - exp(-theta * fin), 1e-300::DOUBLE))) AS s FROM ca, tv WHERE kept AND fin > 0 GROUP BY ALL), ll AS (SELECT so.key, runs, tv.i, theta, coalesce(s, 0) - theta * on_ AS ll FROM so CROSS JOIN tv LEFT JOIN te ON te.key = so.key AND te.i = tv.i),
pk AS (SELECT key, max(ll) AS peak FROM ll GROUP BY key)
SELECT key, any_value(runs) AS runs, round(greatest(0.01, max(theta) FILTER (peak - ll <= 1.355)), 6) AS theta FROM ll JOIN pk USING (key) GROUP BY key""")
def burstiness(spark: SparkSession, sf: str) -> DataFrame:
    """How much longer sources stay quiet than their rates say, within a day."""
    a = alerts(spark, sf).filter(F.floor(F.unix_seconds("ts") / 25200) % 3 == 0)
    b = cube.baseline(cube.series(cube.hourly_cube(a), "agent"))
    p = cube.profile(b)
    size = cube.dispersion(b, p)
    d = b.join(p, (b["key1"] == p["key1"]) & (F.pmod("slot", F.lit(24)) == p["hod"])).drop(p["key1"]).join(size, "key1")
    hours = d.select(F.col("key1").alias("key"), "h", "n", (F.col("k") * F.log1p(F.col("mean") * F.col("weight") / F.col("k"))).alias("cost"), F.floor(F.col("h") / 24).alias("day"))
    return habits.burstiness(habits.quiet_costs(hours, within_day=True)).withColumn("theta", r6(F.col("theta")))
