"""Operators on small planted cases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from alertloom.operators import coverage, cube, fields, incidents, labels, noise, pipeline, rules
from alertloom.streaming import lifecycle

ALERT = "event_id long, ts timestamp, rule_id string, src string, ls string, lvl int"
T0 = datetime(2026, 3, 2, tzinfo=timezone.utc)


def alerts(spark, rows):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=s), *r) for i, (s, *r) in enumerate(rows)], ALERT)


def test_regularity_tells_a_metronome_from_a_person(spark):
    r = random.Random(1)
    rows = [(600 * i, "beat", "h", "c", 5) for i in range(40)] + [(int(86400 * r.random() * 3), "odd", "h", "c", 5) for _ in range(40)] + [(i * 600, "few", "h", "c", 5) for i in range(5)]
    got = {x["rule_id"]: x["regularity"] for x in noise.regularity(alerts(spark, rows)).collect()}
    assert got["beat"] == 1.0 and got["odd"] < 0.6 and got["few"] is None


def test_beacons(spark):
    rows = [(3600 * h, "steady", "h", "c", 5) for h in range(24)] + [(3600 * h, "sparse", "h", "c", 5) for h in range(0, 72, 5)]
    rows += [(86400 * d + 3600 * h, "office", "h", "c", 5) for d in range(3) for h in range(9, 17)]
    got = {x["rule_id"]: x["beacon_like"] for x in noise.beacons(alerts(spark, rows)).collect()}
    assert got == {"steady": True, "sparse": False, "office": True}


def test_verdicts_never_hide_high_alerts(spark):
    rows = [(86400 * d + 600 * i, rule, "h", "c", 13 if rule == "mixed" and i == 3 and d == 4 else 7) for rule in ("quiet", "mixed") for d in range(10) for i in range(8)]
    rows += [(86400 * 9 + i, "late", "h", "c", 7) for i in range(60)]
    got = {x["rule_id"]: x["verdict"] for x in noise.gated(noise.candidates(alerts(spark, rows))).collect()}
    assert got == {"quiet": "tune", "mixed": "investigate", "late": "investigate"}


def test_backtest_needs_every_condition(spark):
    a = alerts(spark, [(0, "r", "h1", "c1", 7), (1, "r", "h1", "c2", 13), (2, "r", "h2", "c1", 5), (3, "q", "h1", "c1", 7)])
    s = spark.createDataFrame([("one", "r", [("src", "h1")]), ("both", "r", [("src", "h1"), ("ls", "c1")]), ("none", "r", [("src", "zz")])], "fp string, rule_id string, conditions array<struct<field:string,value:string>>")
    got = {x["fp"]: (x["hidden"], x["high_hidden"]) for x in noise.backtest(a, s).collect()}
    assert got == {"one": (2, 1), "both": (1, 0), "none": (0, 0)}


def test_cube_levels_skip_missing_keys(spark):
    a = alerts(spark, [(0, "r", "h1", "c1", 7), (10, "r", None, "c1", 7), (4000, None, "h1", None, 7)])
    got = {(x["level"], x["key1"], x["key2"], x["h"] - int(T0.timestamp()) // 3600): x["n"] for x in cube.hourly_cube(a).collect()}
    assert got == {("tenant", None, None, 0): 2, ("tenant", None, None, 1): 1, ("log_source", "c1", None, 0): 2, ("agent", "h1", None, 0): 1, ("agent", "h1", None, 1): 1, ("agent_log_source", "h1", "c1", 0): 1, ("rule", "r", None, 0): 2}
    dense = cube.series(cube.hourly_cube(a), "log_source").orderBy("h").collect()
    assert [x["n"] for x in dense] == [2, 0]


def test_q_values(spark):
    import math

    p = [0.01, 0.04, 0.03, 0.5]
    got = {x["key1"]: x["q"] for x in cube.q_values(spark.createDataFrame([(str(i), math.log(v)) for i, v in enumerate(p)], "key1 string, log_p0 double")).collect()}
    assert all(abs(got[k] - v) < 1e-12 for k, v in {"0": 0.04, "1": 0.16 / 3, "2": 0.16 / 3, "3": 0.5}.items())


def test_busiest(spark):
    d = spark.createDataFrame([(t,) for t in (0, 7200, 7201, 7300, 100000, 100000)], "at_s long")
    assert tuple(cube.busiest(d).first()) == (3, 7200)


def test_lost_field(spark):
    rows = [("a", d, 100, "f", 100 if d < 5 else 0) for d in range(8)] + [("a", d, 100, "g", 50) for d in range(8)] + [("a", d, 10, "small", 10 if d < 5 else 0) for d in range(8)]
    got = {x["field"]: x["lost"] for x in fields.lost(spark.createDataFrame(rows, "ls string, day long, events long, field string, present long")).collect()}
    assert got == {"f": True, "g": False, "small": False}


def test_inventory_matches_each_partner_once(spark):
    seen = spark.createDataFrame([("web",), ("DB.corp",), ("Mail",), ("x.a",), ("x.b",)], "host string")
    inv = spark.createDataFrame([("web",), ("WEB",), ("db",), ("MAIL",), ("x",)], "agent string")
    got = {(r["host"], r["agent"], r["how"]) for r in coverage.match_inventory(seen, inv).collect()}
    assert got == {("web", "web", "exact"), ("Mail", "MAIL", "case"), ("DB.corp", "db", "short"), ("x.a", None, "data_only"), ("x.b", None, "data_only"), (None, "WEB", "inventory_only"), (None, "x", "inventory_only")}


def test_peers_and_contracts(spark):
    peers = spark.createDataFrame([("g", f"h{i}") for i in range(10)] + [("s", "a"), ("s", "b")], "grp string, host string")
    have = spark.createDataFrame([(f"h{i}", "auth") for i in range(9)] + [("h0", "rare"), ("a", "auth")], "host string, source string")
    assert [(r["host"], r["source"]) for r in coverage.peer_gaps(have, peers).collect()] == [("h9", "auth")]


def test_wilson_and_latest(spark):
    got = spark.range(1).select(labels.wilson_lower(F.lit(9.0), F.lit(10.0)), labels.wilson_lower(F.lit(0.0), F.lit(0.0))).first()
    assert abs(got[0] - 0.65238) < 1e-4 and got[1] is None
    v = spark.createDataFrame([("a", "fp", 9, 1), ("a", "tp", 1, 2), ("b", "fp", 3, 1), ("b", "btp", 3, 2)], "alert_id string, verdict string, closed_s long, line int")
    assert {r["alert_id"]: r["verdict"] for r in labels.latest(v).collect()} == {"a": "tp", "b": "btp"}


def test_lag_states(spark):
    rows = [("ok", i) for i in range(100)] + [("late", 1000 + 37 * i) for i in range(100)] + [("ahead", -400 - i) for i in range(50)] + [("zone", 7200 + i % 20) for i in range(50)]
    got = {r["s"]: r["state"] for r in pipeline.lag_quantiles(spark.createDataFrame(rows, "s string, lag long"), "s", "lag").collect()}
    assert got == {"ok": "ok", "late": "late", "ahead": "ahead", "zone": "zone_offset"}


def test_rule_graph(spark):
    r = spark.createDataFrame([(i, i, 5) for i in range(1, 7)], "rule long, position long, level int")
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (6, 5), (9, 1), (4, 4)], "parent long, child long")
    got = {(x["root"], x["rule"]): x["level"] for x in rules.descendants(r, e).collect()}
    assert got == {(1, 2): 1, (1, 3): 1, (1, 4): 2, (2, 3): 1, (2, 4): 2, (3, 4): 1}


def test_fold_and_status(spark):
    f = spark.createDataFrame([("1", "a", "h", "high", "x"), ("2", "b", "h", "medium", "x"), ("3", "c", "h", "low", "y"), ("4", "b", "h", "critical", "y"), ("5", "b", "z", "low", "y")], "fp string, kind string, host string, severity string, domain string")
    got = {r["fp"]: r["root"] for r in incidents.fold(f, [("a", "b"), ("b", "c")]).collect()}
    assert got == {"1": "1", "2": "1", "3": "4", "4": "4", "5": "5"}
    got = {r["domain"]: r["status"] for r in incidents.domain_status(f, ["x", "y", "z", "w"], ["x", "y", "z"]).collect()}
    assert got == {"x": "fail", "y": "fail", "z": "ok", "w": "not_assessed"}


RUNS = "1101100111"


def test_lifecycle_batch_and_stream_agree(spark, tmp_path):
    rows = [("f", i, c == "1") for i, c in enumerate(RUNS)] + [("g", i, i == 2) for i in range(6)]
    log = spark.createDataFrame(rows, "fp string, run long, present boolean")
    batch = sorted(map(tuple, lifecycle.replay(log).collect()))
    assert [x[2] for x in batch if x[0] == "f"] == ["new", "opened", "resolved", "regressed"]
    assert [x[2] for x in batch if x[0] == "g"] == ["new"]
    for i, part in enumerate((log.filter("run < 4"), log.filter("run >= 4"))):
        part.coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    s = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    q = lifecycle.stream(s).writeStream.format("memory").queryName("life").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("life").collect())) == batch


def test_stream_counts_and_dedup(spark, tmp_path):
    rows = [(i, T0 + timedelta(seconds=s), "r", "h", "c", 7) for i, s in enumerate((0, 60, 899, 901, 3700, 20000))]
    spark.createDataFrame(rows, ALERT).coalesce(1).write.parquet(str(tmp_path / "in"))
    for name, f in (("counts", lifecycle.hourly_counts), ("once", lifecycle.deduped)):
        s = spark.readStream.schema(ALERT).parquet(str(tmp_path / "in"))
        q = f(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 4]
    assert sorted(r["event_id"] for r in spark.table("once").collect()) == [0, 3, 4, 5]
