"""Drops and declines of a series against its own rhythm, with an explicit budget of false alarms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.negbin import change_point, log_cdf, matched_size

#: Hours of the drop test at first and at most, the least expected count and hours with any, and the ratio that is a drop.
FIRST_H, MOST_H, LEAST_EXPECTED, LEAST_HOURS, DROP_RATIO = 24, 168, 20.0, 6, 0.3
#: Days of the decline test: spans, reference, least reference days and median, and ratios for two to six days and for seven.
SPANS, REFERENCE, LEAST_DAYS, LEAST_MEDIAN, DECAY_RATIO = range(2, 8), 28, 8, 5.0, 0.5
RESULT = "key1 string, expected double, observed long, log_p double, ratio double, onset_h long, dropped boolean, decay_ratio double, decay_log_p double, declining boolean"


def drop(h: np.ndarray, n: np.ndarray, mu: np.ndarray, k: float, alpha: float) -> tuple[float, int, float, float, int, bool]:
    """(expected, observed, log p, ratio, onset hour, dropped): the last hours, grown by days until enough is expected.

    The window as a whole and the suffix after its most likely change are both tested, each at half the level.
    """
    size = FIRST_H
    while size < min(MOST_H, len(h)) and (mu[-size:].sum() < LEAST_EXPECTED or (mu[-size:] > 0).sum() < LEAST_HOURS):
        size += 24
    size = min(size, len(h))
    m, c, hours = mu[-size:], n[-size:], h[-size:]
    expected, observed = float(m.sum()), int(c.sum())
    if expected < LEAST_EXPECTED:
        return expected, observed, 0.0, observed / expected if expected else 1.0, int(hours[0]), False
    at = change_point(m, c)
    tests = []
    for lo in (0, at):
        e, o = float(m[lo:].sum()), int(c[lo:].sum())
        if e > 0:
            tests.append((log_cdf(o, e, matched_size(m[lo:], k)), o / e, int(hours[lo])))
    log_p, ratio, onset = min(tests)
    return expected, observed, log_p, ratio, onset, log_p < math.log(alpha / 2) and ratio < DROP_RATIO


def decline(days: np.ndarray, totals: np.ndarray, k: float, alpha: float) -> tuple[float, float, bool]:
    """(ratio, log p, declining) of the span of last days that speaks most for a decline, against the days before all spans.

    A day's expectation is its weekday's mean in the reference, shrunk towards the mean of all with the weight of two days. Spans
    share the level.
    """
    last = SPANS[-1]
    ref_d, ref = days[:-last][-REFERENCE:], totals[:-last][-REFERENCE:]
    if len(ref) < LEAST_DAYS or np.median(ref) < LEAST_MEDIAN:
        return 1.0, 0.0, False
    mean = ref.mean()
    expect = {w: (ref[ref_d % 7 == w].sum() + 2 * mean) / ((ref_d % 7 == w).sum() + 2) for w in range(7)}
    fit = np.array([expect[w] for w in ref_d % 7])
    excess = float(((ref - fit) ** 2 - ref).sum())
    daily_k = min(k * 24, max(0.5, float((fit * fit).sum()) / excess)) if excess > 0 else k * 24
    best = (0.0, 1.0, False)
    for s in SPANS:
        e = np.array([expect[w] for w in days[-s:] % 7])
        o = int(totals[-s:].sum())
        log_p, ratio = log_cdf(o, float(e.sum()), matched_size(e, daily_k)), o / float(e.sum())
        hit = log_p < math.log(alpha / len(SPANS)) and ratio < (DECAY_RATIO if s == last else DROP_RATIO)
        best = min(best, (log_p, ratio, hit), key=lambda x: (not x[2], x[0]))
    return best[1], best[0], best[2]


def tests(series: DataFrame, profile: DataFrame, size: DataFrame, budget: float = 0.05) -> DataFrame:
    """RESULT for every key: one task per key holds that key's hours only, whose number the window bounds."""
    keys = max(1, size.count())
    alpha = min(0.5, budget / keys)
    d = series.withColumn("hod", F.pmod(F.col("h") + 72, F.lit(24))).join(profile, ["key1", "hod"]).join(size, "key1")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("h")
        h, n, k = pdf["h"].to_numpy(), pdf["n"].to_numpy().astype(float), float(pdf["k"].iloc[0])
        found = drop(h, n, (pdf["mean"] * pdf["weight"]).to_numpy(), k, alpha)
        day = h // 24
        days, at = np.unique(day, return_index=True)
        totals = np.add.reduceat(n, at)
        if (day == days[-1]).sum() < 24:  # the last day isn't over
            days, totals = days[:-1], totals[:-1]
        return pd.DataFrame([(pdf["key1"].iloc[0], *found, *decline(days, totals, k, alpha))], columns=[c.split()[0] for c in RESULT.split(", ")])

    return d.select("key1", "h", "n", "mean", "weight", "k").groupBy("key1").applyInPandas(one, RESULT)
