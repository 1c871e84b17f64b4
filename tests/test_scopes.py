"""Scopes, verdicts, spread of days, order of rules, scans by rule and by window, on small tables."""

from __future__ import annotations

import math
import statistics
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from alertloom.operators import rules, scopes
from alertloom.sources import documents


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_narrowest_scope_of_an_alert(spark):
    a = spark.createDataFrame([("r", "h", "v", "t", 7), ("r", "h", "v", "t", 3), ("r", "h", "v", None, 9), ("r", None, "v", "t", 9), ("r", "h", None, "t", 9)], "rule_id string, host string, value string, companion string, lvl int")
    got = {(r["companion"], r["n"], r["analyst"]) for r in scopes.narrowest(a, "host", "value", "companion").collect()}
    assert got == {("t", 2, 1), (None, 1, 1)}


def test_steady_values_are_old_frequent_and_calm(spark):
    t0 = datetime(2024, 3, 1)
    alerts = [("r", "h1", "steady", t0 + timedelta(days=d, hours=h)) for d in range(10) for h in (1, 5)]
    alerts += [("r", "h2", "late", t0 + timedelta(days=d, hours=h)) for d in range(5, 10) for h in range(4)]
    alerts += [("r", "h2", "burst", t0 + timedelta(days=d)) for d in range(10)] + [("r", "h2", "burst", t0 + timedelta(days=3, minutes=m)) for m in range(40)]
    alerts += [("r", None, "steady", t0 + timedelta(days=9, hours=9)), ("r", "h1", None, t0), ("r", "h3", "rare", t0)]
    a = spark.createDataFrame(alerts, "rule_id string, src string, ls string, ts timestamp")
    assert rows(scopes.steady(a, "ls"), "value", "n", "present", "nth") == [("steady", 21, 10, 1)]
    assert rows(scopes.steady_hosts(a, "src", "ls"), "host", "n", "nth") == [("h1", 20, 1)]
    assert scopes.steady(a.limit(0), "ls").count() == 0


def test_first_verdict_of_a_rule(spark):
    r = spark.createDataFrame([("a", 7.0, False), ("b", 12.0, True), ("c", 7.0, True), ("d", 7.0, False), ("e", None, False), ("f", 7.0, False)], "rule_id string, level double, burst boolean")
    found = spark.createDataFrame([("a", "tune"), ("a", "aggregate"), ("b", "tune"), ("c", "tune"), ("f", "unknown"), ("f", None)], "rule_id string, verdict string")
    assert rows(scopes.rule_verdicts(r, found), "rule_id", "verdict") == [("a", "aggregate"), ("b", "do_not_tune"), ("c", "investigate"), ("d", "watch"), ("e", "do_not_tune"), ("f", "watch")]
    assert {v for _, v in rows(scopes.rule_verdicts(r, found, learning=True), "rule_id", "verdict")} == {"learning"}


def test_day_spread_against_plain(spark):
    totals = {"wide": [100, 180, 60, 240, 90, 30, 5000, 0], "even": [100, 101, 99, 100, 102, 98], "few": [100, 200, 50, 400], "small": [3, 9, 1, 7, 5, 2]}
    expected = {"wide": 100.0, "even": 100.0, "few": 100.0, "small": 5.0}
    d = spark.createDataFrame([(k, expected[k], t) for k, ts in totals.items() for t in ts], "key1 string, expected double, total long")
    x = [math.log(t / 100) for t in totals["wide"] if t]
    mid = statistics.median(x)
    reach = 2.5 * 1.4826 * statistics.median(abs(v - mid) for v in x)
    want = math.sqrt(statistics.variance([min(mid + reach, max(mid - reach, v)) for v in x]) - 0.01)
    got = dict(rows(scopes.day_spread(d), "key1", "sigma"))
    assert got["wide"] == pytest.approx(want) and got["even"] == got["few"] == got["small"] == 0.0


def test_order_of_trial(spark):
    r = spark.createDataFrame([(1, 0, 5, None), (2, 1, 3, None), (3, 2, 0, None), (4, 3, 12, 0), (5, 4, 3, None), (6, 5, 3, 1)], "rule long, position int, level int, accuracy int")
    e = spark.createDataFrame([(1, c) for c in (2, 3, 4, 5, 6)] + [(1, 2), (6, 5), (9, 2)], "parent long, child long")
    got = rows(rules.trial_order(r, e), "parent", "nth", "rule", "after")
    assert got == [(1, 1, 3, 4), (1, 2, 2, 3), (1, 3, 5, 2), (1, 4, 6, 1), (1, 5, 4, 0)]


def test_documents_of_rules(spark, tmp_path):
    lines = ['{"rule": {"id": "5710"}, "n": 1}', '{"rule": {"id": 5710}, "n": 2}', '{"rule": {"id": "1"}, "note": "5710"}', '{"rule": {"id": "57\\u0031\\u0030"}, "n": 3}', '{"rule": {"id": "5710"}', '["5710"]', "", '{"rule": {"id": "15710"}}', '{"other": 5710}']
    (tmp_path / "x.json").write_text("\n".join(lines))
    d = documents.of_rules(spark, str(tmp_path), ["5710"])
    assert sorted(r[0] for r in d.select(F.try_variant_get("doc", "$.n", "int")).collect()) == [1, 2, 3]
    assert documents.of_rules(spark, str(tmp_path), []).count() == 0


def test_events_within_a_window(spark):
    t0 = datetime(2024, 3, 1)
    e = spark.createDataFrame([(i, t0 + timedelta(hours=i // 2)) for i in range(20)] + [(99, None)], "event_id long, ts timestamp")
    lo, hi = F.lit(t0 + timedelta(hours=2)), F.lit(t0 + timedelta(hours=5))
    assert rows(documents.within(e, lo, hi, 4), "nth", "event_id", "truncated") == [(1, 4, True), (2, 5, True), (3, 6, True), (4, 7, True)]
    assert rows(documents.within(e, lo, hi, 6), "event_id", "truncated")[-1] == (9, False)
    assert documents.within(e.limit(0), lo, hi, 6).count() == 0
