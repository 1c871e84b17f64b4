"""The silence model over the events' hourly counts, on a local clock, with planted losses. Each query with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions import tails
from alertloom.functions.cuts import checkpointed
from alertloom.operators import habits, model
from alertloom.operators.alerts import alerts, r6
from alertloom.plans.noise_queries import WITH

QUERIES: dict = {}
ZONE, OFF = "Europe/Madrid", 19_728  # the sixth of January, a holiday there


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """Hourly counts of hosts and channels, the clock and the end: two channels of three lose events near the end, one declines for a week."""
    a = alerts(spark, sf).select(F.floor(F.unix_seconds("ts") / 3600).cast("long").alias("h"), "src", "ls", "event_id", F.col("k"))
    lo, hi = a.agg(F.min("h"), F.max("h")).first()
    end = hi + 1
    gone = ((F.col("ls") == "ch1") & (F.col("h") >= end - 40)) | ((F.col("ls") == "ch0") & (F.col("h") >= end - 60) & (F.col("event_id") % 8 != 0)) | ((F.col("ls") == "ch2") & (F.col("h") >= end - 160) & (F.col("event_id") % 4 != 0))
    kept = a.filter(~gone)
    counts = kept.select("h", F.explode(F.array(F.concat(F.lit("channel:"), "ls"), F.concat(F.lit("host:"), "src"))).alias("key")).groupBy("key", "h").agg(F.count(F.lit(1)).alias("n"))
    spine = habits.clock(spark, lo, hi, ZONE, spark.createDataFrame([(OFF,)], "day long"))
    return checkpointed(counts), checkpointed(spine), end


_IN = f"""{WITH}, w AS (SELECT min(h) AS lo, max(h) + 1 AS e FROM a),
cn AS (SELECT key, h, count(*) AS n FROM (SELECT h, unnest(['channel:' || ls, 'host:' || src]) AS key FROM a, w WHERE NOT (ls = 'ch1' AND h >= e - 40 OR ls = 'ch0' AND h >= e - 60 AND event_id % 8 <> 0 OR ls = 'ch2' AND h >= e - 160 AND event_id % 4 <> 0)) GROUP BY ALL),
hs AS (SELECT h, timezone('{ZONE}', timezone('UTC', make_timestamp(h * 3600000000 + 1800000000))) AS lt FROM (SELECT unnest(range(lo, e)) AS h FROM w)),
sp0 AS (SELECT h, (isodow(lt) - 1) * 24 + hour(lt) AS slot, date_diff('day', DATE '1970-01-01', lt::DATE) AS day, hour(lt) AS hod FROM hs),
sp AS (SELECT h, slot, day, day = {OFF} AS off, count(*) OVER (PARTITION BY day) = 24 AND day IN (SELECT day FROM sp0 GROUP BY day HAVING count(DISTINCT hod) = 24) AS regular FROM sp0),
cal AS (SELECT day, (day + 3) % 7 AS dow, min(h) AS first_h, max(h) < any_value(e) - 24 AS base FROM sp, w WHERE regular AND NOT off GROUP BY day),
ks AS (SELECT key, min(h) AS kf, max(h) AS kl FROM cn GROUP BY key),
dn AS (SELECT key, day, sum(n) AS n, count(*) AS active FROM cn JOIN sp USING (h) GROUP BY ALL),
dy AS (SELECT ks.key, kl, cal.day, dow, base, coalesce(n, 0) AS n, coalesce(active, 0) AS active FROM ks CROSS JOIN w JOIN cal ON first_h >= CASE WHEN kf <= lo + 24 THEN lo ELSE kf END LEFT JOIN dn ON dn.key = ks.key AND dn.day = cal.day),
md AS (SELECT key, median(n) FILTER (n > 0) AS med, count(*) FILTER (n > 0) AS act FROM dy WHERE base GROUP BY key),
sk AS (SELECT x.key, x.day, CASE WHEN act >= 4 AND x.n > 3 * med AND NOT EXISTS (SELECT 1 FROM dy y WHERE y.base AND y.key = x.key AND y.dow = x.dow AND y.day <> x.day AND y.n >= 0.5 * x.n) THEN 3 * med / x.n ELSE 1 END AS f FROM dy x JOIN md USING (key) WHERE base),
sc AS (SELECT cn.key, slot, sum(n * f) AS c, sum(n * f * n * f) AS q FROM cn JOIN sp USING (h) JOIN sk ON sk.key = cn.key AND sk.day = sp.day GROUP BY ALL),
kn AS (SELECT key, count(*) AS n_days FROM dy WHERE base GROUP BY key HAVING count(*) >= 2), exs AS (SELECT key, dow, count(*) AS ex FROM dy WHERE base GROUP BY ALL),
s0 AS (SELECT kn.key, n_days, g.slot, g.slot // 24 AS dow, g.slot % 24 AS hod, coalesce(ex, 0) AS ex, coalesce(c, 0) AS c, coalesce(q, 0) AS q, sum(coalesce(c, 0)) OVER (PARTITION BY kn.key) AS n FROM kn CROSS JOIN (SELECT unnest(range(168)) AS slot) g LEFT JOIN exs ON exs.key = kn.key AND exs.dow = g.slot // 24 LEFT JOIN sc ON sc.key = kn.key AND sc.slot = g.slot),
s1 AS (SELECT *, CASE WHEN ex > 0 THEN c / ex END AS r, n / (n + 48.0::DOUBLE) AS wt FROM s0 WHERE n > 0),
s2 AS (SELECT *, avg(r) OVER (PARTITION BY key) AS mean, coalesce(sum(c) OVER (PARTITION BY key, hod) / nullif(sum(ex) OVER (PARTITION BY key, hod), 0), 0) AS hr, coalesce(sum(c) OVER (PARTITION BY key, dow) / nullif(sum(ex) OVER (PARTITION BY key, dow), 0), 0) AS dr FROM s1),
s3 AS (SELECT *, hr / avg(hr) OVER (PARTITION BY key) AS ho, dr / avg(dr) OVER (PARTITION BY key) AS do_ FROM s2),
pe0 AS (SELECT slot, coalesce(avg(r / mean), 0) AS how, avg(ho) AS hp, avg(do_) AS dp FROM s3 WHERE n >= 24 AND mean > 0 GROUP BY slot), pe AS (SELECT slot, how / avg(how) OVER () AS how, hp / avg(hp) OVER () AS hp, dp / avg(dp) OVER () AS dp FROM pe0),
s4 AS (SELECT s3.*, coalesce(how, 1) AS how, coalesce(hp, 1) AS hp, coalesce(dp, 1) AS dp, n_days >= 21 AS weekly, n_days / 7.0::DOUBLE / (n_days / 7.0::DOUBLE + 2) AS wd, avg(do_) OVER (PARTITION BY key, s3.dow < 5) AS part FROM s3 LEFT JOIN pe USING (slot)),
s5 AS (SELECT *, CASE WHEN weekly THEN CASE WHEN r IS NOT NULL AND mean > 0 THEN wt * r / mean + (1 - wt) * how ELSE how END ELSE (wt * ho + (1 - wt) * hp) * (wt * (wd * do_ + (1 - wd) * part) + (1 - wt) * dp) END AS raw FROM s4),
s6 AS (SELECT s5.*, s5.raw / avg(s5.raw) OVER (PARTITION BY s5.key) AS p0, 0.25 * b.raw + 0.5 * s5.raw + 0.25 * f.raw AS sm FROM s5 JOIN s5 b ON b.key = s5.key AND b.slot = (s5.slot + 167) % 168 JOIN s5 f ON f.key = s5.key AND f.slot = (s5.slot + 1) % 168),
s7 AS (SELECT *, sm / avg(sm) OVER (PARTITION BY key) AS shape FROM s6),
dd AS (SELECT key, dow, avg(shape) AS f, round(coalesce(sum(r), 0), 9) AS raw_day, count(r) AS seen FROM s7 GROUP BY ALL), b0 AS (SELECT dy.*, f, raw_day FROM dy JOIN dd USING (key, dow) WHERE base),
fx AS (SELECT key, day, CASE WHEN f >= 0.25 THEN n / f ELSE n END AS x FROM (SELECT *, max(f >= 0.25) OVER (PARTITION BY key) AS anyf FROM b0) WHERE f >= 0.25 OR NOT anyf),
scl AS (SELECT key, avg(x) AS scale FROM (SELECT key, x, row_number() OVER (PARTITION BY key ORDER BY x, day) AS i, count(*) OVER (PARTITION BY key) AS m FROM fx) WHERE i > floor(m * 0.1) AND i <= m - floor(m * 0.1) GROUP BY key HAVING avg(x) > 0),
s8 AS (SELECT s7.*, scale, scale / 24 * shape AS rate, scale / 24 * p0 AS rp FROM s7 JOIN scl USING (key)),
s9 AS (SELECT *, CASE WHEN ex > 0 AND rp > 0 THEN (c + 1) / (ex + 1 / rp) ELSE 0 END AS al FROM s8),
s AS (SELECT *, CASE WHEN NOT weekly AND sum(al) OVER (PARTITION BY key) > 0 THEN scale / 24 * al / avg(al) OVER (PARTITION BY key) END AS ra FROM s9),
po AS (SELECT CASE WHEN den > 0 AND num > 0 THEN greatest(0.5, least(1000.0, num / den)) ELSE 1000.0::DOUBLE END AS pooled FROM (SELECT sum(ex * r * r) AS num, sum((q - c * c / ex) * ex / (ex - 1) - c) AS den FROM s WHERE n >= 100 AND ex >= 2)),
m0 AS (SELECT key, n, n_days, wt, wd, weekly, scale, sum(ex) AS hrs, sum(ex * rp * rp) AS num, sum(q - 2 * rp * c + ex * rp * rp) AS rest, sum(CASE WHEN hod BETWEEN 7 AND 18 THEN c ELSE 0 END) AS business FROM s GROUP BY ALL),
m1 AS (SELECT *, rest * hrs / greatest(1.0, hrs - (1 + wt * CASE WHEN weekly THEN 168 ELSE 31 END)) - n AS den, 1 + wt * (1 + 5 * CASE WHEN weekly THEN 1 ELSE wd END) AS pd FROM m0),
ed AS (SELECT key, day, b0.n, scale * f AS e FROM b0 JOIN scl USING (key)), lg AS (SELECT key, ln(n / e) AS x, 1 / e AS inv FROM ed WHERE e >= 20 AND n > 0),
lm AS (SELECT key, median(x) AS mid, median(inv) AS noise FROM lg GROUP BY key HAVING count(*) >= 5), lw AS (SELECT key, 2.5 * 1.4826 * median(abs(x - mid)) AS reach FROM lg JOIN lm USING (key) GROUP BY key),
ls_ AS (SELECT key, sqrt(greatest(0.0, var_samp(greatest(mid - reach, least(mid + reach, x))) - any_value(noise))) AS sg FROM lg JOIN lm USING (key) JOIN lw USING (key) GROUP BY key),
sd AS (SELECT key, sum(e * e) AS nd, sum((n - e) * (n - e) - n) AS xd FROM ed GROUP BY key),
m2 AS (SELECT m1.*, CASE WHEN n >= 100 THEN CASE WHEN den > 0 AND num > 0 THEN greatest(0.5, least(1000.0, num / den)) ELSE 1000.0 END ELSE pooled END AS k,
  CASE WHEN coalesce(sg, 0) > 0 THEN exp(sg * sg) - 1 ELSE 1 / CASE WHEN xd > 0 AND nd > 0 THEN greatest(0.5, least(1000.0, nd / xd)) ELSE 1000.0 END END * least(4.0, (1 + pd / n_days) / greatest(0.25, 1 - pd / n_days)) AS cv2 FROM m1 JOIN sd USING (key) LEFT JOIN ls_ USING (key), po),
m3 AS (SELECT *, sqrt(ln(1 + cv2)) AS sigma, greatest(0.5, least(1000.0, 1 / greatest(cv2, 0.001))) AS k_day FROM m2),
du AS (SELECT key, count(*) FILTER (raw_day >= 3) AS days, count(*) FILTER (raw_day >= 3 AND n <= 0) AS off, count(*) FILTER (raw_day >= 3 AND n < 0.3 * raw_day) AS low, count(*) FILTER (n > 0) AS ad, count(*) AS xd2, sum(active) AS ac,
  avg(n) FILTER (dow < 5) AS week, avg(n) FILTER (dow >= 5) AS ends FROM b0 GROUP BY key),
d1 AS (SELECT du.*, CASE WHEN week IS NULL OR ends IS NULL THEN 'unknown' WHEN ends >= 0.1 * week THEN 'weekends' ELSE 'weekdays' END AS peers, CASE WHEN ac >= 0.9 * hrs THEN 'always_on' WHEN ad >= 0.5 * xd2 AND business >= 0.7 * m0.n THEN 'business_hours' ELSE 'intermittent' END AS duty FROM du JOIN m0 USING (key)),
d2 AS (SELECT key, peers, duty, days, unnest([{{'c': 'off', 'ev': off}}, {{'c': 'low', 'ev': low}}], recursive := true) FROM d1),
g1 AS (SELECT peers, c, coalesce(sum(ev) / nullif(sum(days), 0), 0) AS mean, count(*) FILTER (days >= 5) AS m, var_samp(ev / days) FILTER (days >= 5) AS vr, avg(1 / days) FILTER (days >= 5) AS inv FROM d2 GROUP BY ALL),
g2 AS (SELECT *, CASE WHEN mean <= 0 OR mean >= 1 THEN 200 WHEN m < 3 THEN 2 WHEN vr - mean * (1 - mean) * inv <= 0 THEN 200 ELSE greatest(2.0, least(200.0, mean * (1 - mean) / (vr - mean * (1 - mean) * inv) - 1)) END AS weight FROM g1),
d3 AS (SELECT d2.*, mean, weight, mean > 0 AND mean < 1 AND days > 0 AND list_sum(list_transform(range(ev + 1), lambda i: exp(lgamma(days + 1) - lgamma(i + 1) - lgamma(days - i + 1) + i * ln(mean) + (days - i) * ln(1 - mean)))) < 0.01 OR mean >= 1 AND ev < days AS alone FROM d2 JOIN g2 USING (peers, c)),
d4 AS (SELECT key, any_value(peers) AS peers, any_value(duty) AS duty, max((ev + CASE WHEN alone THEN 0 ELSE weight * mean END) / (days + CASE WHEN alone THEN 2 ELSE weight END)) FILTER (c = 'off') AS po_, max((ev + CASE WHEN alone THEN 0 ELSE weight * mean END) / (days + CASE WHEN alone THEN 2 ELSE weight END)) FILTER (c = 'low') AS pl_ FROM d3 GROUP BY key),
k AS (SELECT m3.key, kl, n_days, m3.n, scale, k, sigma, k_day, n_days / (1 / scale + 1 / k_day) AS n_eff, duty, CASE WHEN duty = 'always_on' THEN 0 ELSE po_ END AS pi_off, CASE WHEN duty = 'always_on' THEN 0 ELSE pl_ END AS pi_low, n_days * 3.0::DOUBLE / CASE WHEN weekly THEN 7 ELSE 1 END AS occ, peers FROM m3 JOIN d4 USING (key) JOIN ks USING (key))"""
_NODES = "[" + ", ".join(f"{{'x': {x!r}::DOUBLE, 'w': {w!r}::DOUBLE}}" for x, w in model._doubled()) + "]"
_SILENT = f"""{_IN}, rd AS (SELECT b0.key, peers, day, b0.n, raw_day, row_number() OVER (PARTITION BY b0.key ORDER BY day) AS i, lead(1) OVER (PARTITION BY b0.key ORDER BY day) IS NULL AS tail FROM b0 JOIN k USING (key) WHERE raw_day >= 3),
ru AS (SELECT peers, key, count(*) AS len, max(tail) AS cens FROM (SELECT *, i - row_number() OVER (PARTITION BY key ORDER BY day) AS isl FROM rd WHERE n <= 0) GROUP BY peers, key, isl),
rt AS (SELECT peers, count(*) FILTER (n <= 0) / count(*) AS rate FROM rd GROUP BY peers),
rs AS (SELECT ru.peers, (sum(len - 1) + 2 * any_value(rate)) / (sum(len - 1) + count(*) FILTER (NOT cens) + 2) AS start FROM ru JOIN rt USING (peers) GROUP BY ru.peers),
pt AS (SELECT ru.peers, af, count(*) FILTER (len > af) AS more, count(*) FILTER (len > af) + count(*) FILTER (len = af AND NOT cens) AS risk FROM ru, (SELECT unnest(range(1, 15)) AS af) GROUP BY ALL),
st AS (SELECT peers, 0 AS af, start AS stay FROM rs UNION ALL SELECT st.peers, st.af + 1, greatest(stay, (more + 2 * stay) / (risk + 2)) FROM st JOIN pt ON pt.peers = st.peers AND pt.af = st.af + 1),
gh AS (SELECT k.*, sp.h, sp.day, (sp.slot - sh.shift + 168) % 168 AS slot, shift FROM k, w, sp, (SELECT unnest([0, -1, 1]) AS shift) sh WHERE sp.h > kl AND sp.h < e AND sp.h >= e - 1440 AND NOT sp.off),
gm AS (SELECT gh.*, 0 AS model, rp AS mu FROM gh JOIN s ON s.key = gh.key AND s.slot = gh.slot WHERE rp > 0 UNION ALL SELECT gh.*, 1, ra FROM gh JOIN s ON s.key = gh.key AND s.slot = gh.slot WHERE ra > 0),
gd0 AS (SELECT key, shift, model, day, k, sigma, n_eff, occ, pi_off, peers, kl, sum(-k * ln(1 + mu / k)) AS plain, sum(mu) AS lam, list(mu) AS mus FROM gm GROUP BY ALL),
gn AS (SELECT *, ln(list_sum(list_transform({_NODES}, lambda g: exp(g.w + list_sum(list_transform(mus, lambda u: -k * ln(1 + u * exp(sigma * g.x - sigma * sigma / 2) / k))))))) AS mixed FROM gd0),
ge AS (SELECT gn.*, CASE WHEN sigma >= 0.05 THEN least(0.0, greatest(mixed, plain)) ELSE plain END AS cost, gn.day <> l.day AS later FROM gn JOIN sp l ON l.h = kl),
gf AS (SELECT *, coalesce(sum(CASE WHEN later AND round(lam, 9) >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY key, shift, model ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ge),
gq AS (SELECT gf.*, CASE WHEN before > 0 AND stay IS NOT NULL THEN least(0.999, greatest(pi_off, stay)) ELSE pi_off END AS q FROM gf LEFT JOIN st ON st.peers = gf.peers AND st.af = least(before, 14) AND before > 0),
gt AS (SELECT key, shift, model, n_eff, occ, greatest(-700.0, sum(CASE WHEN pi_off > 0 AND later THEN ln(q + (1 - q) * exp(cost)) ELSE cost END)) AS nb, sum(lam) AS lam FROM gq GROUP BY ALL),
gs AS (SELECT *, least(n_eff, greatest(1.0, lam * occ)) AS used FROM gt),
gb AS (SELECT key, max(greatest(nb, CASE WHEN lam > 0 THEN -used * ln(1 + lam / used) ELSE 0 END)) AS best, max(lam) FILTER (shift = 0 AND model = 0) AS expected FROM gs GROUP BY key),
sil AS (SELECT k.key, e - 1 - kl AS gap_h, coalesce(expected, 0) AS expected, least(0.0, coalesce(best, 0.0)) AS log_p0 FROM k CROSS JOIN w LEFT JOIN gb USING (key))"""
_SILENT = _SILENT.replace("WITH ", "WITH RECURSIVE ", 1)
_VARS = "[" + ", ".join(f"{{'z': {tails.normal_quantile(p)!r}::DOUBLE, 'w': {math.log(w)!r}::DOUBLE}}" for p, w in model.VARIANCES) + "]"
_PMF = "CASE WHEN sz IS NULL THEN i * ln(mu) - mu - lgamma(i + 1) ELSE lgamma(sz + i) - lgamma(sz) - lgamma(i + 1) - sz * ln(1 + mu / sz) + i * (ln(mu) - ln(mu + sz)) END"


def _tail(rows: str, by: str) -> str:
    """Rows (by, observed, mean, size, sigma, dof, pi, low_days) -> (by, log_p), in the plainest way: every tail summed from none on."""
    return f"""(WITH t0 AS (SELECT *, CASE WHEN pi > 0 AND low_days > 0 THEN low_days ELSE 0 END AS m FROM ({rows})), t1 AS (SELECT *, unnest(range(m + 1)) AS j FROM t0),
t2 AS (SELECT {by}, observed, dof, sigma, CASE WHEN m > 0 THEN mean * (m - j) / m ELSE mean END AS mn, CASE WHEN m > 0 AND m > j THEN size * (m - j) / m ELSE size END AS sz, CASE WHEN m > 0 THEN lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + j * ln(pi) + (m - j) * ln(1 - pi) ELSE 0 END AS lw FROM t1),
t3 AS (SELECT *, sigma >= 0.05 AND mn > 0 AS wide, greatest(1.0, dof) AS df FROM t2),
t4 AS (SELECT *, unnest(CASE WHEN wide THEN list_transform({_VARS}, lambda v: {{'lv': v.w, 'sg': sigma * sqrt(df / (df * greatest(1e-6, 1 - 2 / (9 * df) + v.z * sqrt(2 / (9 * df))) ** 3))}}) ELSE [{{'lv': 0.0::DOUBLE, 'sg': 0.0::DOUBLE}}] END, recursive := true) FROM t3),
t5 AS (SELECT *, unnest(CASE WHEN wide THEN {_NODES} ELSE [{{'x': 0.0::DOUBLE, 'w': 0.0::DOUBLE}}] END, recursive := true) FROM t4), t6 AS (SELECT *, mn * exp(sg * x - sg * sg / 2) AS mu FROM t5),
t7 AS (SELECT *, CASE WHEN mu <= 0 THEN 0 ELSE ln(list_sum(list_transform(range(observed + 1), lambda i: exp({_PMF} - ({_PMF.replace("i * ln", "observed * ln").replace("+ i)", "+ observed)").replace("lgamma(i + 1)", "lgamma(observed + 1)").replace("+ i * (", "+ observed * (")}))))) + {_PMF.replace("i * ln", "observed * ln").replace("+ i)", "+ observed)").replace("lgamma(i + 1)", "lgamma(observed + 1)").replace("+ i * (", "+ observed * (")} END AS lp FROM t6)
SELECT {by}, least(0.0, ln(sum(exp(greatest(-700.0, lw + lv + w + least(0.0, lp)))))) AS log_p FROM t7 GROUP BY {by})"""


_DROP = f"""{_SILENT}, ti AS (SELECT h, slot, day, row_number() OVER (ORDER BY h DESC) AS i FROM sp WHERE NOT off QUALIFY i <= 168),
lo_ AS (SELECT key, list(least(rp, coalesce(ra, rp)) ORDER BY slot) AS rl FROM s GROUP BY key),
t0 AS (SELECT lo_.key, ti.h, ti.day, i, rl[slot + 1] AS m0, rl[(slot + 1) % 168 + 1] AS m1, rl[(slot + 167) % 168 + 1] AS m2, coalesce(cn.n, 0) AS n FROM lo_ CROSS JOIN ti LEFT JOIN cn ON cn.key = lo_.key AND cn.h = ti.h),
t1 AS (SELECT *, sum(m0) OVER z AS s0, sum(m1) OVER z AS s1, sum(m2) OVER z AS s2, sum(m0 * m0) OVER z AS q0, sum(m1 * m1) OVER z AS q1, sum(m2 * m2) OVER z AS q2, sum(n) OVER z AS o FROM t0 WINDOW z AS (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING)),
t2 AS (SELECT *, coalesce(min(i) FILTER (i >= 24 AND i % 24 = 0 AND (s0 >= 20 AND q0 > 0 AND s0 * s0 >= 6 * q0 OR i >= 168)) OVER (PARTITION BY key), max(i) OVER (PARTITION BY key)) AS hours FROM t1),
t3 AS (SELECT *, max(CASE WHEN i = hours THEN CASE least(s0, s1, s2) WHEN s0 THEN 0 WHEN s1 THEN 1 ELSE 2 END END) OVER (PARTITION BY key) AS which FROM t2 WHERE i <= hours),
t4 AS (SELECT *, [m0, m1, m2][which + 1] AS mu, [s0, s1, s2][which + 1] AS e_, [q0, q1, q2][which + 1] AS sq FROM t3),
t5 AS (SELECT *, CASE WHEN e_ > 0 AND o < e_ THEN round(CASE WHEN o > 0 THEN o * ln(o / e_) ELSE 0 END - e_ * (o / e_ - 1), 9) END AS gain FROM t4),
cu AS (SELECT key, coalesce(arg_max(i, (gain, -i)) FILTER (gain IS NOT NULL), 1) AS cut FROM t5 GROUP BY key),
o1 AS (SELECT t5.key, hours, cut, max(o) FILTER (i = hours)::BIGINT AS observed, max(e_) FILTER (i = hours) AS expected, max(sq) FILTER (i = hours) AS sq, max(h) FILTER (i = cut) AS onset_h, max(o) FILTER (i = cut)::BIGINT AS so, max(least(s0, s1, s2)) FILTER (i = cut) AS se, max(CASE least(s0, s1, s2) WHEN s0 THEN q0 WHEN s1 THEN q1 ELSE q2 END) FILTER (i = cut) AS ss FROM t5 JOIN cu USING (key) GROUP BY ALL),
o2 AS (SELECT *, cut < hours AND se >= 20 AND so > 0 AS part FROM o1 WHERE expected >= 20), o3 AS (SELECT *, least(observed / expected, CASE WHEN part THEN so / se ELSE observed / expected END) AS effect FROM o2),
td AS (SELECT o3.*, k, k_day, sigma AS ds, n_eff, greatest(pi_off, pi_low) AS pi, n_days - 1.0::DOUBLE AS dof FROM o3 JOIN k USING (key) WHERE effect < 0.3),
rw AS (SELECT key, 0 AS pt, observed, expected AS mean, sq, hours AS hh FROM td UNION ALL SELECT key, 1, so, se, ss, cut FROM td WHERE part),
ld AS (SELECT key, pt, count(*) AS low_days FROM (SELECT rw.key, pt, t5.day, any_value(mean) AS mean, sum(mu) AS de FROM rw JOIN t5 ON t5.key = rw.key AND t5.i <= hh GROUP BY ALL) WHERE round(de, 9) >= round(greatest(3.0, 0.1 * mean), 9) GROUP BY ALL),
rr AS (SELECT rw.key, rw.pt, hh, rw.observed, mean, 1 / (rw.sq / (mean * mean * k) + CASE WHEN ds >= 0.05 THEN 0 ELSE 1 / (k_day * greatest(1.0, hh / 24)) END + 1 / n_eff) AS size, CASE WHEN ds >= 0.05 THEN sqrt(ln(1 + (exp(ds * ds) - 1) / greatest(1.0, hh / 24))) ELSE 0 END AS sigma, dof, pi, coalesce(low_days, 0) AS low_days FROM rw JOIN td USING (key) LEFT JOIN ld ON ld.key = rw.key AND ld.pt = rw.pt),
dp_ AS (SELECT key, min(least(0.0, log_p + CASE WHEN pt = 1 THEN ln(hh) ELSE 0 END)) AS log_p FROM {_tail("SELECT * FROM rr", "key, pt, hh")} GROUP BY key),
dr_ AS (SELECT o3.*, coalesce(log_p, 0) AS log_p FROM o3 LEFT JOIN dp_ USING (key)),
y0 AS (SELECT *, max(day) OVER (PARTITION BY key) AS last FROM dy), y1 AS (SELECT *, day <= last - 7 AS ref FROM y0 WHERE day > last - 35),
y2 AS (SELECT *, coalesce(sum(n) FILTER (ref) OVER (PARTITION BY key), 0) AS sk, count(*) FILTER (ref) OVER (PARTITION BY key) AS nk, coalesce(sum(n) FILTER (ref) OVER (PARTITION BY key, dow < 5), 0) AS sg, count(*) FILTER (ref) OVER (PARTITION BY key, dow < 5) AS ng, coalesce(sum(n) FILTER (ref) OVER (PARTITION BY key, dow), 0) AS s_d, count(*) FILTER (ref) OVER (PARTITION BY key, dow) AS nd FROM y1),
y3 AS (SELECT *, CASE WHEN ref THEN n ELSE 0 END AS out_, CASE WHEN ref THEN 1 ELSE 0 END AS one FROM y2 WHERE nk >= 7),
y4 AS (SELECT *, CASE WHEN ng > one THEN (sg - out_) / (ng - one) ELSE (sk - out_) / greatest(1, nk - one) END AS bs, nd - one AS mm FROM y3), y5 AS (SELECT *, CASE WHEN mm <= 0 THEN bs ELSE mm / (mm + 2) * (s_d - out_) / mm + 2 / (mm + 2) * bs END AS ee FROM y4),
yl AS (SELECT key, ln(n / ee) AS x, 1 / ee AS inv FROM y5 WHERE ref AND ee >= 20 AND n > 0), ym AS (SELECT key, median(x) AS mid, median(inv) AS noise FROM yl GROUP BY key HAVING count(*) >= 5), yw AS (SELECT key, 2.5 * 1.4826 * median(abs(x - mid)) AS reach FROM yl JOIN ym USING (key) GROUP BY key),
yg AS (SELECT key, greatest(0.0, var_samp(greatest(mid - reach, least(mid + reach, x))) - any_value(noise)) AS v FROM yl JOIN ym USING (key) JOIN yw USING (key) GROUP BY key),
yf AS (SELECT y5.key, median(n) AS usual, count(*) AS rdays, sum(ee * ee) AS num, sum((n - ee) * (n - ee) - n) AS den FROM y5 WHERE ref GROUP BY key HAVING median(n) >= 5),
yc AS (SELECT yf.*, greatest(CASE WHEN den > 0 AND num > 0 THEN 1 / greatest(0.5, least(1000.0, num / den)) ELSE 0.001 END, exp(coalesce(v, 0)) - 1) AS cv2 FROM yf LEFT JOIN yg USING (key)),
yr AS (SELECT key, span, count(*) AS days, sum(n)::BIGINT AS observed, sum(ee) AS mean, sum(ee * ee) AS sq, median(n) AS now_, list(ee) AS each FROM y5, (SELECT unnest([2, 3, 4, 5, 6, 7]) AS span) WHERE NOT ref AND day > last - span GROUP BY ALL),
yx AS (SELECT key, span, observed / mean AS ratio, observed, mean, k * 24 * days AS size, sqrt(ln(1 + sq * cv2 / (mean * mean))) AS sigma, rdays - 1.0::DOUBLE AS dof, greatest(pi_off, pi_low) AS pi, len(list_filter(each, lambda z: round(z, 9) >= round(greatest(3.0, 0.1 * mean), 9))) AS low_days FROM yr JOIN yc USING (key) JOIN k USING (key)
  WHERE mean > 0 AND CASE WHEN span = 7 THEN days >= 5 AND observed / mean < 0.5 AND now_ < 0.5 * usual ELSE days >= greatest(2, span - 2) AND observed / mean < 0.3 END),
yp AS (SELECT key, arg_min({{'span': span, 'ratio': ratio, 'lp': least(0.0, log_p + ln(6))}}, (least(0.0, log_p + ln(6)), span)) AS x FROM {_tail("SELECT * FROM yx", "key, span, ratio")} GROUP BY key),
al AS (SELECT sil.key, gap_h, log_p0, effect AS drop_effect, dr_.log_p AS drop_log_p, x.ratio AS decline_ratio, x.lp AS decline_log_p, ln(least(0.5, 0.05::DOUBLE / (SELECT count(*) FROM k))) AS lev, coalesce(observed <= 0 OR gap_h >= hours / 2 OR gap_h >= 0.5 * (e - onset_h), true) AS quiet FROM sil CROSS JOIN w LEFT JOIN dr_ USING (key) LEFT JOIN yp USING (key))"""


@query(f"{_IN} SELECT key, n_days, round(n, 6)::DOUBLE AS n, round(scale, 6) AS scale, round(k, 5) AS k, round(sigma, 6) AS day_sigma, round(k_day, 5) AS k_day, round(n_eff, 4) AS n_eff, duty, round(pi_off, 6) AS pi_off, round(pi_low, 6) AS pi_low, peers FROM k")
def silence_model(spark: SparkSession, sf: str) -> DataFrame:
    """What the model knows of each host and channel: scale, hourly and daily dispersion, duty, how often a day is off or low."""
    k = model.fit(*_input(spark, sf))[1]
    r = lambda c, d=6: F.round(c, d).alias(c)
    return k.select("key", "n_days", r("n"), r("scale"), r("k", 5), r("day_sigma"), r("k_day", 5), r("n_eff", 4), "duty", r("pi_off"), r("pi_low"), "peers")


@query(f"{_IN} SELECT key, slot, round(rate, 6) AS rate, round(rp, 6) AS rate_p0 FROM s WHERE key LIKE 'channel:%'")
def weekly_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Events an hour that each channel expects in every hour of the local week, drawn to the peers' week; smoothed and not."""
    s = model.fit(*_input(spark, sf))[0]
    return s.filter("key like 'channel:%'").select("key", "slot", r6(F.col("rate")).alias("rate"), r6(F.col("rate_p0")).alias("rate_p0"))


@query(f"{_SILENT} SELECT key, gap_h, round(expected, 6) AS expected, round(log_p0, 5) AS log_p0 FROM sil")
def silence_p0(spark: SparkSession, sf: str) -> DataFrame:
    """Chance of each host's and channel's silence, with shifts, day multipliers, days off and how they go on."""
    counts, spine, end = _input(spark, sf)
    s, keys, days = model.fit(counts, spine, end)
    d = model.silent(s, keys, spine, end, model.stays(days, s, keys))
    return d.select("key", "gap_h", r6(F.col("expected")).alias("expected"), F.round("log_p0", 5).alias("log_p0"))


@query(f"""{_DROP} SELECT key, gap_h, round(log_p0, 5) AS log_p0, round(drop_effect, 6) AS drop_effect, round(drop_log_p, 5) AS drop_log_p, round(decline_ratio, 6) AS decline_ratio, round(decline_log_p, 5) AS decline_log_p,
CASE WHEN log_p0 < lev AND (quiet OR NOT coalesce(drop_log_p < lev, false)) THEN 'silent' WHEN coalesce(drop_log_p < lev, false) THEN 'drop' WHEN coalesce(decline_log_p < lev, false) THEN 'decay' ELSE 'ok' END AS status FROM al""")
def silence_alarms(spark: SparkSession, sf: str) -> DataFrame:
    """Status of each host and channel at a shared budget of false alarms: silences, drops and declines."""
    d = model.alarms(*_input(spark, sf))
    r = lambda c, n=5: F.round(c, n).alias(c)
    return d.select("key", "gap_h", r("log_p0"), r("drop_effect", 6), r("drop_log_p"), r("decline_ratio", 6), r("decline_log_p"), "status")
