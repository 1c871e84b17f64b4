"""The model of silence on planted worlds: false alarms within the budget, weekly jobs, silences, drops, declines, days off; tails."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.functions import negbin, tails
from alertloom.operators import habits, model

START = 473_352  # a Monday, 00:00 UTC, in hours since 1970 (2024-01-01)


def ask(spark, rows, expr, schema="x long, mu double, k double"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_tails_in_columns(spark):
    rows = [(x, mu, k) for mu, k in [(0.5, 0.7), (5.0, 2.0), (40.0, 3.0), (300.0, 1000.0), (80.0, None), (1e4, 50.0)] for x in (0, 1, 3, int(mu / 4), int(mu / 2))]
    got = ask(spark, rows, tails.log_cdf(F.col("x"), F.col("mu"), F.col("k")))
    for (x, mu, k), v in zip(rows, got, strict=True):
        assert v == pytest.approx(negbin.log_cdf(x, mu, math.inf if k is None else k), rel=1e-8, abs=1e-9)
    zs = [-30.0, -8.0, -3.5, -2.9, -1.0, 0.0, 1.5, 5.0, 9.0]
    want = [math.log(0.5 * math.erfc(-z / math.sqrt(2))) if z > -30 else -454.3212439563 for z in zs]
    assert ask(spark, [(z,) for z in zs], tails.log_normal_cdf(F.col("z")), "z double") == pytest.approx(want, rel=1e-8, abs=1e-12)
    assert ask(spark, [(g,) for g in (0.3, 1.0, 2.5, 100.0)], tails.log_gamma(F.col("g")), "g double") == pytest.approx([math.lgamma(g) for g in (0.3, 1.0, 2.5, 100.0)], rel=1e-10, abs=1e-10)


def test_tails_of_large_counts_in_columns(spark):
    rows = [(x, x * by, k) for x in (5_000, 40_000) for by in (0.3, 0.97, 1.0, 1.05, 4.0) for k in (0.4, 30.0, 2000.0, None)]
    got = ask(spark, rows, tails.log_cdf(F.col("x"), F.col("mu"), F.col("k")))
    for (x, mu, k), v in zip(rows, got, strict=True):
        assert v == pytest.approx(negbin.log_cdf(x, mu, math.inf if k is None else k), rel=1e-8, abs=1e-8)


def test_lower_tail_of_large_counts_is_the_whole_mixture(spark):
    """Days empty, variances and nodes of a count of any size, summed up one by one."""
    rows = [(1, 110, 830.0, 40.0, 0.1, 20.0, 0.0, 0), (2, 6_000, 45_000.0, 60.0, 0.2, 27.0, 0.1, 2), (3, 25, 210.0, 15.0, 0.3, 9.0, 0.05, 1)]
    d = spark.createDataFrame(rows, "id int, observed long, mean double, size double, sigma double, dof double, pi double, low_days long")
    got = {r["id"]: r["log_p"] for r in model.lower_tail(d, ["id"]).collect()}
    for i, observed, mean, size, sigma, dof, pi, m in rows:
        total = -math.inf
        for j in range(m + 1):
            share = (m - j) / m if m else 1.0
            days = math.log(math.comb(m, j)) + j * math.log(pi) + (m - j) * math.log1p(-pi) if m else 0.0
            for p, w in model.VARIANCES if share else [(0.5, 1.0)]:
                c = 2 / (9 * dof)
                sg = sigma / math.sqrt((1 - c + tails.normal_quantile(p) * math.sqrt(c)) ** 3)
                for x, lw in model._doubled() if share else [(0.0, 0.0)]:
                    total = np.logaddexp(total, days + math.log(w) + lw + negbin.log_cdf(observed, mean * share * math.exp(sg * x - sg * sg / 2), size * share or size))
        assert got[i] == pytest.approx(total, rel=1e-7)


def world(spark, keys: dict[str, np.ndarray], days: int):
    """Sparse counts and the spine of hourly series from START on."""
    rows = [(k, START + int(h), int(n[h])) for k, n in keys.items() for h in np.flatnonzero(n)]
    spine = habits.clock(spark, START, START + 24 * days - 1, "UTC", spark.createDataFrame([], "day long"))
    return spark.createDataFrame(rows, "key string, h long, n long"), spine, START + 24 * days


def statuses(spark, keys, days, budget=0.05):
    return {r["key"]: r.asDict() for r in model.alarms(*world(spark, keys, days), budget).collect()}


def pattern(kind: str, days: int) -> np.ndarray:
    h = np.arange(24 * days)
    if kind == "flat":
        return np.full(len(h), 4.0)
    if kind == "sine":
        return 5 * (1.2 + np.sin(2 * np.pi * (h % 24) / 24))
    return np.where((h // 24 % 7 < 5) & (h % 24 >= 7) & (h % 24 < 19), 9.0, 0.05)


@pytest.mark.parametrize("days", [16, 30])
def test_planted_world(spark, days):
    r = np.random.default_rng(days)
    draw = lambda mu, k=3.0: r.negative_binomial(k, k / (k + mu))
    keys = {f"{kind}{i}": draw(pattern(kind, days)) for kind in ("flat", "sine", "office") for i in range(12)}
    weekly = np.zeros(24 * days, int)
    weekly[6 * 24 + 3 :: 168] = 60  # Sundays at 3
    keys["weekly"] = weekly
    gone = draw(pattern("flat", days))
    gone[-20:] = 0
    keys["gone"] = gone
    less = draw(np.full(24 * days, 20.0), 50.0)
    less[-14:] = r.poisson(1.0, 14)
    less[-1] = 1
    keys["less"] = less
    got = statuses(spark, keys, days)
    assert got["gone"]["status"] == "silent" and got["less"]["status"] == "drop" and got["weekly"]["status"] == "ok"
    assert [k for k, v in got.items() if v["status"] != "ok" and k not in ("gone", "less")] == []
    assert set(got) == set(keys)


def test_slow_decline(spark):
    r = np.random.default_rng(4)
    days = 35
    keys = {f"flat{i}": r.poisson(4.0, 24 * days) for i in range(8)}
    fading = r.poisson(4.0, 24 * days)
    fading[-24 * 7 :] = r.poisson(1.4, 24 * 7)
    keys["fading"] = fading
    got = statuses(spark, keys, days)
    assert got["fading"]["status"] in ("decay", "drop") and got["fading"]["decline_ratio"] < 0.5 and got["fading"]["decline_log_p"] < -10
    assert all(v["status"] == "ok" for k, v in got.items() if k != "fading")


def test_a_day_off_is_no_silence_where_days_off_are_usual(spark):
    r = np.random.default_rng(6)
    days = 28
    keys = {}
    for i in range(20):
        n = r.poisson(pattern("office", days))
        for d in r.choice(days - 7, 5, replace=False):
            n[24 * d : 24 * d + 24] = 0
        n[-31:] = 0  # the last day and the evening before
        keys[f"laptop{i}"] = n
    keys |= {f"server{i}": r.poisson(4.0, 24 * days) for i in range(10)}
    keys["server0"][-31:] = 0
    got = statuses(spark, keys, days)
    assert got["server0"]["status"] == "silent"
    assert all(v["status"] != "silent" for k, v in got.items() if k.startswith("laptop"))


def test_false_alarms_stay_within_the_budget(spark):
    r = np.random.default_rng(9)
    days, alarms = 28, 0
    keys = {}
    for i in range(150):
        mu = pattern(("flat", "sine", "office")[i % 3], days) * r.uniform(0.2, 4)
        mu = mu * np.repeat(np.exp(r.normal(0, 0.15, days)), 24)
        k = r.uniform(1, 20)
        keys[f"k{i}"] = r.negative_binomial(k, k / (k + mu))
    for end in (28, 27):
        got = statuses(spark, {k: n[: 24 * end] for k, n in keys.items()}, end, 1.0)
        alarms += sum(v["status"] != "ok" for v in got.values())
    assert alarms <= 2 * 2 * 1.0 + 2


def test_odd_input(spark):
    empty = spark.createDataFrame([], "key string, h long, n long")
    spine = habits.clock(spark, START, START + 24 * 10 - 1, "UTC", spark.createDataFrame([], "day long"))
    assert model.alarms(empty, spine, START + 240).collect() == []
    # a key of one event, one that only began today, and one event a day: no model or no alarm, none lost but those without a baseline
    rows = [("once", START + 5, 1), ("new", START + 239, 9), *[("daily", START + 24 * d + 7, 1) for d in range(10)]]
    got = {r["key"]: r["status"] for r in model.alarms(spark.createDataFrame(rows, "key string, h long, n long"), spine, START + 240).collect()}
    assert got == {"once": "ok", "daily": "ok"}
