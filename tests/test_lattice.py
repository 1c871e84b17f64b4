"""Anchor fields, what their values may be, and the lattice of conditions, on small cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from alertloom.functions import anchors
from alertloom.operators import lattice

ALERT = "rule_id string, event_id long, ts timestamp_ntz, lvl int, fields map<string,array<string>>, failure boolean, fim boolean, check boolean, process boolean"


def alerts(spark, rows):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    data = [(r.get("rule", "r"), i, start + timedelta(hours=r.get("hour", i % 240)), r.get("lvl", 5), {k: v if isinstance(v, list) else [v] for k, v in r["fields"].items()}, r.get("failure", False), r.get("fim", False), False, False) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ALERT).withColumn("ts", F.col("ts").cast("timestamp"))


def kinds(spark, rows, trusted=None):
    d = spark.createDataFrame(rows, "path string, role string, value string, failure boolean, fim boolean")
    c = anchors.classified(F.col("path"), F.col("role"), F.col("value"), F.col("failure"), F.col("fim"), trusted)
    return ["".join(sorted(k[0] if k != "attacker" else "A" for k, v in r[0].asDict().items() if v)) for r in d.select(c).collect()]


def test_what_values_may_be(spark):
    # letters: a alone, A attacker, e external, i internal, t trusted, h host, n never, c chosen
    rows = [
        ("agent.name", "host", "web-1", False, False, "ah"), ("location", "source", "10.0.0.9", False, False, "ah"), ("location", "source", "/var/log/x", False, False, ""), ("location", "source", "db->/var/log", False, False, "ah"),
        ("data.srcip", "src_ip", "10.1.1.1", False, False, "ai"), ("data.dstip", "peer_ip", "10.1.1.1", False, False, "i"), ("data.srcip", "src_ip", "2001:db8::5", False, False, "Ae"), ("data.srcip", "src_ip", "fd00::5", False, False, "ai"),
        ("data.srcip", "src_ip", "::ffff:10.0.0.1", False, False, "ai"), ("data.srcip", "src_ip", "host", False, False, "A"), ("data.dstuser", "user", "svc_web", False, False, "ct"), ("data.dstuser", "user", "svc_web", True, False, "A"),
        ("data.win.eventdata.subjectUserName", "user", "DC01$", True, False, "c"), ("data.dstuser", "user", "ann", False, False, "Ac"), ("data.dstuser", "user", "CORP\\boss", False, False, "t"),
        ("data.win.eventdata.image", "process", "C:\\Windows\\System32\\PowerShell.exe", False, False, "An"), ("data.win.eventdata.image", "process", "C:\\Program Files\\x\\y.exe", False, False, ""), ("data.win.eventdata.image", "process", "C:\\Users\\x\\y.exe", False, False, "A"),
        ("process.executable", "process", "/usr/bin/python3.11", False, False, "An"), ("process.executable", "process", "/opt/x/agent", False, False, ""), ("syscheck.path", "file", "/etc/passwd", False, True, "a"), ("syscheck.path", "file", "/etc/passwd", False, False, "A"),
        ("data.url", "attacker", "/x", False, False, "A"), ("data.win.eventdata.logonType", "context", "4", False, False, ""),
    ]
    assert kinds(spark, [r[:5] for r in rows], {"user": ["CORP\\Boss"]}) == [r[5] for r in rows]


def test_host_of_an_alert(spark):
    rows = [
        {"fields": {"agent.id": "001", "agent.name": "web-1", "predecoder.hostname": "WEB-1"}},
        {"fields": {"agent.id": "000", "agent.name": "manager", "predecoder.hostname": "fw-1", "location": "10.0.0.1"}},
        {"fields": {"agent.id": "000", "agent.name": "manager", "location": "10.0.0.1"}},
        {"fields": {"agent.id": "000", "agent.name": "manager", "location": "/var/log/x"}},
        {"fields": {"agent.name": " - ", "predecoder.hostname": "x" * 2000, "data.srcip": ["1.2.3.4", "1.2.3.4", "5.6.7.8"], "location": "EventChannel", "unknown": "v"}},
    ]
    got = [(r["host"] and tuple(r["host"]), sorted((v["path"], v["value"]) for v in r["vals"])) for r in lattice.anchored(alerts(spark, rows), "wazuh4").orderBy("event_id").collect()]
    assert got == [
        (("agent.name", "web-1"), [("agent.name", "web-1")]),
        (("predecoder.hostname", "fw-1"), [("location", "10.0.0.1"), ("predecoder.hostname", "fw-1")]),
        (("location", "10.0.0.1"), [("location", "10.0.0.1")]),
        (None, [("location", "/var/log/x")]),
        (None, [("data.srcip", "1.2.3.4"), ("data.srcip", "5.6.7.8")]),
    ]


def subjects(scopes):
    return {r["subject"].removeprefix("rule:r|"): r["n"] for r in scopes.collect()}


def test_host_falls_where_narrower_scopes_cover_it(spark):
    user, kind = "data.win.eventdata.targetUserName", "data.win.eventdata.logonType"
    rows = [{"fields": {"agent.name": "a", user: "svc_x", kind: "4"}}] * 90 + [{"fields": {"agent.name": "a", user: "bob", kind: "10"}}] * 10 + [{"fields": {"agent.name": "b", user: "ann"}}] * 60
    got = subjects(lattice.candidates(alerts(spark, rows), "wazuh4")[0])
    # the companion is pinned in this rule, so the pair of host b and ann, who has none, is no scope; host b stays as a whole
    assert got == {f"agent.name:a|{kind}:4|{user}:svc_x": 90, "agent.name:b": 60}


def test_own_machine_account_narrows_nothing(spark):
    rows = [{"fields": {"agent.name": "srv-01", "data.dstuser": "SRV-01$", "location": "/var/log/auth.log"}}] * 50
    assert subjects(lattice.candidates(alerts(spark, rows), "wazuh4")[0]) == {"agent.name:srv-01": 50}


def test_overlapping_scopes_are_chosen_once(spark):
    # a second pair on one host adds nothing; a source that may lie on several hosts is not bound to overlap
    rows = [{"fields": {"host.name": "h", "source.ip": "10.0.0.1", "destination.ip": "10.0.0.2"}}] * 95 + [{"fields": {"host.name": "k", "source.ip": "10.0.0.9", "destination.ip": "10.0.0.2"}}] * 30
    scopes, *_ = lattice.candidates(alerts(spark, rows), "ecs")
    assert subjects(lattice.selected(scopes)) == {"destination.ip:10.0.0.2|host.name:h": 95, "destination.ip:10.0.0.2|host.name:k": 30, "source.ip:10.0.0.1": 95, "source.ip:10.0.0.9": 30}


def test_gates(spark):
    steady = [{"rule": "calm", "fields": {"agent.name": "a"}, "hour": h} for h in range(0, 240, 2)]
    late = [{"rule": "late", "fields": {"agent.name": "b"}, "hour": h} for h in range(120, 240, 2)]
    away = [{"rule": "away", "fields": {"agent.name": "c", "data.srcip": "203.0.113.5"}, "hour": h} for h in range(0, 240, 2)]
    high = [{"rule": "high", "fields": {"agent.name": "d"}, "hour": h} for h in range(0, 240, 2)] + [{"rule": "else", "fields": {"agent.name": "D.corp.example"}, "hour": 50, "lvl": 13}]
    a = alerts(spark, steady + late + away + high)
    none = spark.createDataFrame([], "rule_id string, verdict string")
    tactics = spark.createDataFrame([("calm", [" Lateral-Movement "])], "rule_id string, tactics array<string>")
    judge = lambda t, v, w: {(r["rule_id"], r["subject"].split("|")[1]): (r["verdict"], r["failed"]) for r in lattice.judged(a, "wazuh4", t, v, w, {"host": ["a"]}).collect()}
    got = judge(tactics.limit(0), none.selectExpr("1L as event_id", "verdict").limit(0), none)
    assert got[("calm", "agent.name:a")] == ("tune", [])
    assert got[("late", "agent.name:b")] == ("investigate", ["novelty", "persistence"])
    assert got[("high", "agent.name:d")] == ("investigate", ["co_occurrence"])
    assert all(v == "fix_at_source" and "external" in f for (r, _), (v, f) in got.items() if r == "away")
    fps = spark.createDataFrame([(i, "fp") for i in range(30)], "event_id long, verdict string")
    assert judge(tactics, fps.limit(0), none)[("calm", "agent.name:a")] == ("investigate", ["sensitive"])
    assert judge(tactics, fps, none)[("calm", "agent.name:a")] == ("tune", [])
    wide = spark.createDataFrame([("calm", "tp")], "rule_id string, verdict string")
    assert judge(tactics, fps, wide)[("calm", "agent.name:a")] == ("do_not_tune", ["tp_rule_wide"])


def test_no_alerts(spark):
    assert lattice.candidates(alerts(spark, [{"fields": {"agent.name": "a"}}]).limit(0), "wazuh4")[0].collect() == []
