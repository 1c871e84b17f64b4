"""Tails against direct sums, planted drops and declines, and false alarms within the budget."""

from __future__ import annotations

import math

import numpy as np
import pytest

from alertloom.functions.negbin import change_point, log_cdf, log_pmf, matched_size
from alertloom.operators import silence


@pytest.mark.parametrize("mu,k", [(0.5, 0.7), (5.0, 2.0), (40.0, 3.0), (300.0, 1000.0), (80.0, math.inf), (1e4, 50.0)])
def test_log_cdf_against_sums(mu, k):
    for x in (0, 1, 3, int(mu / 4), int(mu), int(mu * 1.5) + 2):
        want = math.fsum(math.exp(log_pmf(i, mu, k)) for i in range(x + 1))
        got = log_cdf(x, mu, k)
        if want > 1e-290:
            assert got == pytest.approx(math.log(min(1.0, want)), abs=1e-9)
    assert log_cdf(-1, mu, k) == -math.inf
    assert log_cdf(int(mu * 100) + 100, mu, k) == pytest.approx(0.0, abs=1e-6)


def test_far_tail_stays_finite():
    assert -2001 < log_cdf(0, 2000.0, math.inf) < -1999


def test_matched_size_and_change_point(rng=np.random.default_rng(0)):
    mus = np.array([1.0, 2.0, 3.0])
    k = matched_size(mus, 4.0)
    assert 6 + 36 / k == pytest.approx(6 + (mus * mus).sum() / 4)
    c = np.concatenate([rng.poisson(20, 60), rng.poisson(3, 30)]).astype(float)
    assert abs(change_point(np.full(90, 20.0), c) - 60) <= 1
    assert change_point(np.full(5, 1.0), np.full(5, 9.0)) == 4


def test_planted_drop_and_decline(rng=np.random.default_rng(1)):
    mu = np.full(24 * 40, 5.0)
    n = rng.poisson(mu).astype(float)
    assert not silence.drop(np.arange(len(n)), n, mu, 1000.0, 1e-4)[-1]
    n[-20:] = rng.poisson(0.3, 20)
    found = silence.drop(np.arange(len(n)), n, mu, 1000.0, 1e-4)
    assert found[-1] and abs(found[-2] - (len(n) - 20)) <= 2
    days = np.arange(40)
    totals = rng.poisson(120, 40).astype(float)
    assert not silence.decline(days, totals, 100.0, 1e-4)[-1]
    totals[-7:] *= 0.4
    assert silence.decline(days, totals.round(), 100.0, 1e-4)[-1]


def test_false_alarms_stay_within_the_budget(rng=np.random.default_rng(2)):
    alarms = 0
    for _ in range(400):
        mu = np.full(24 * 14, float(rng.uniform(0.3, 6)))
        n = rng.negative_binomial(2.0, 2.0 / (2.0 + mu)).astype(float)
        alarms += silence.drop(np.arange(len(n)), n, mu, 2.0, 1.0 / 400)[-1]
    assert alarms <= 3
