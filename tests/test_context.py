"""Cases of fields, verdicts, runs and habits that the registered queries don't hold."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.functions import context
from alertloom.operators import habits, runs, verdicts


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


@pytest.mark.parametrize(
    ("text", "seconds"),
    [("90s", 90.0), (" 15 m ", 900.0), ("1.5H", 5400.0), ("2w", 1209600.0), ("", None), ("h", None), ("-3m", None), ("3 months", None), (None, None)],
)
def test_durations(spark, text, seconds):
    assert one(spark, context.duration_s(F.lit(text).cast("string"))) == seconds


@pytest.mark.parametrize(("seconds", "words"), [(0, "0s"), (59, "59s"), (60, "1m"), (3661, "1h 1m"), (93600, "1d 2h"), (86400 + 120, "1d"), (-93600, "-1d 2h"), (None, None)])
def test_words(spark, seconds, words):
    assert one(spark, context.humanized(F.lit(seconds).cast("long"))) == words


def test_context_of_nulls_is_none(spark):
    null = F.lit(None).cast("string")
    assert tuple(one(spark, context.contexts(F.lit(None).cast("array<string>"), null, null, null, null))) == (False, False, False, False)


@pytest.mark.parametrize(
    ("kind", "value", "key"),
    [("ip", "::ffff:203.0.113.5", "203.0.113.5"), ("ip", " FE80::1", "fe80::1"), ("user", "CORP\\\\Ann", "ann"), ("user", "Ann@corp", "ann"), ("host", "SRV-01.corp.example", "srv-01"), ("host", "10.1.2.3", "10.1.2.3"), ("host", None, None)],
)
def test_link_keys(spark, kind, value, key):
    assert one(spark, context.link_key(F.lit(kind), F.lit(value).cast("string"))) == key


def test_verdicts_meet_under_any_name(spark):
    fields = spark.createDataFrame([(1, "data.srcip", " 10.0.0.1"), (2, "source.ip", "10.0.0.1"), (3, "data.user", "BOB"), (4, "data.srcip", None), (1, "data.srcip", "10.0.0.1")], "event_id long, field string, value string")
    tps = spark.createDataFrame([("a", "src_ip", "10.0.0.1"), ("b", "user", "bob "), ("c", "data.srcip", None)], "tp string, field string, value string")
    assert sorted(map(tuple, verdicts.confirmed(fields, tps).collect())) == [(1, "a"), (2, "a"), (3, "b")]


def test_candidates_without_alerts_or_conditions(spark):
    c = spark.createDataFrame([("none", []), ("other", [("f", "z")]), ("both", [("f", "x"), ("g", "y")])], "candidate string, conditions array<struct<field string, value string>>")
    v = spark.createDataFrame([("x", "y", "tp"), ("x", None, "fp"), ("x", "y", "fp")], "f string, g string, verdict string")
    got = {r[0]: tuple(r)[1:] for r in verdicts.covered_verdicts(c, v, ["f", "g"]).collect()}
    assert got == {"none": (0, 0, 0, False), "other": (0, 0, 0, False), "both": (1, 1, 0, True)}
    assert all(r["tp"] == 0 for r in verdicts.covered_verdicts(c, v.limit(0), ["f", "g"]).collect())


def test_redelivery_twice_is_once(spark):
    states = spark.createDataFrame([("a", "open", 20), ("b", "open", 30), ("c", None, None)], "fp string, phase string, notified_s long")
    notices = spark.createDataFrame([(1, "a", 20, "new", 10), (1, "b", 20, None, None)], "run long, fp string, at_s long, was_phase string, was_s long")
    lost = spark.createDataFrame([(1, None), (1, "a")], "run long, fp string")
    first = runs.handed_back(states, notices, lost)
    assert sorted(map(tuple, first.collect())) == [("a", "new", 10, True), ("b", "open", 30, False), ("c", None, None, False)]
    again = runs.handed_back(first.drop("again"), notices, lost)
    assert sorted(map(str, again.drop("again").collect())) == sorted(map(str, first.drop("again").collect()))


def test_few_samples_have_no_zone(spark):
    rows = [("few", 3600, True)] * 19 + [("many", 3600 + i, True) for i in range(20)] + [("far", 3600 + 300, True)] * 20 + [("many", 5, False)]
    got = runs.zoned_lags(spark.createDataFrame(rows, "source string, lag_s long, naive boolean")).groupBy("source", "naive").agg(F.max("offset_s").alias("o")).collect()
    assert {(r[0], r[1]): r[2] for r in got} == {("few", True): 0.0, ("many", True): 3600.0, ("far", True): 0.0, ("many", False): 0.0}


@pytest.mark.parametrize(("events", "days", "rate"), [(0, 10, 0.2), (3, 10, 0.2), (10, 10, 0.5), (1, 60, 0.4)])
def test_binomial_tail(spark, events, days, rate):
    want = sum(math.comb(days, j) * rate**j * (1 - rate) ** (days - j) for j in range(events + 1))
    got = one(spark, habits.binomial_tail(F.lit(events).cast("long"), F.lit(days).cast("long"), F.lit(rate)))
    assert got == pytest.approx(want, rel=1e-9)


def test_outage_needs_enough_sources(spark):
    rows = [(f"k{i}", 7100 + 60 * i, True) for i in range(4)] + [("late", 20000, True)]
    d = spark.createDataFrame(rows, "key string, at_s long, steady boolean")
    assert {r["key"] for r in habits.outage(d, 10).filter("outage").collect()} == {"k0", "k1", "k2", "k3"}
    assert habits.outage(d, 100).filter("outage").count() == 0
    assert habits.outage(d.limit(0), 10).count() == 0


def test_surplus_explains_nothing(spark):
    p = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", -1.0), ("d", 5.0)], "parent string, deficit double")
    k = spark.createDataFrame([("a", "x", 8.0), ("a", "y", -8.0), ("b", "x", 6.0), ("c", "x", 1.0)], "parent string, child string, deficit double")
    assert {r["parent"]: r["explained"] for r in habits.explained(p, k).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_burstiness_against_a_fine_grid(spark):
    rng = np.random.default_rng(5)
    quiet = [("bursty", i, float(c), float(t)) for i, (c, t) in enumerate(zip(rng.uniform(4, 9, 30), rng.uniform(0.3, 1, 30), strict=True))]
    quiet += [("plain", i, 0.1, 2.0) for i in range(12)] + [("few", i, 3.0, 1.0) for i in range(5)]
    got = {r["key"]: r["theta"] for r in habits.burstiness(spark.createDataFrame(quiet, "key string, first long, on double, end double")).collect()}
    assert set(got) == {"bursty", "plain"} and got["plain"] == 1.0
    runs_ = sorted((c, t) for k, _, c, t in quiet if k == "bursty")
    cap = runs_[26][0]
    on, ends = sum(min(c, cap) for c, _ in runs_), np.array([t for _, t in runs_[:27]])
    grid = np.exp(np.linspace(np.log(1e-6), 0, 200_001))
    ll = np.array([-g * on + np.log(-np.expm1(-g * ends)).sum() for g in grid])
    assert got["bursty"] == pytest.approx(max(0.01, grid[ll.max() - ll <= 1.355].max()), rel=0.004)


def test_quiet_runs_end_with_their_day(spark):
    n = [0, 2, 0, 0, 0, 1, 0, 0]
    rows = [("a", h, c, float(h), h // 4) for h, c in enumerate(n)]
    d = spark.createDataFrame(rows, "key string, h long, n long, cost double, day long")
    assert sorted(map(tuple, habits.quiet_costs(d).collect())) == [("a", 2, 7.0, 5.0), ("a", 6, 7.0, 0.0)]
    assert sorted(map(tuple, habits.quiet_costs(d, within_day=True).collect())) == [("a", 2, 3.0, 0.0), ("a", 6, 7.0, 0.0)]
    assert habits.quiet_costs(d.limit(0)).count() == 0
