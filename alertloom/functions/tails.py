"""Tails of the negative binomial as column expressions: log gamma, log probability, and the lower tail by a continued fraction."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments are raised by so much before Stirling's series; a tail has so many levels, and the root of its count besides.
RAISED, LEVELS = 8, 64
#: Size that stands for none (Poisson) in the fraction of a tail.
NO_SIZE = 1e15
LOG_FLOOR = -700.0


def log_gamma(x: Column) -> Column:
    """log Gamma(x) of x > 0, by Stirling's series at x + RAISED and the recurrence down."""
    z = x + RAISED
    down = F.aggregate(F.sequence(F.lit(0), F.lit(RAISED - 1)), F.lit(0.0), lambda a, i: a + F.log(x + i))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7)) - down


def log_pmf(x: Column, mu: Column, k: Column) -> Column:
    """log P(X = x) of mean ``mu`` > 0 and size ``k``; a null size is Poisson."""
    poisson = x * F.log(mu) - mu - log_gamma(x + 1.0)
    binomial = log_gamma(k + x) - log_gamma(k) - log_gamma(x + 1.0) - k * F.log1p(mu / k) + x * (F.log(mu) - F.log(mu + k))
    return F.when(k.isNull(), poisson).otherwise(binomial)


def log_cdf(x: Column, mu: Column, k: Column) -> Column:
    """log P(X <= x), as the incomplete beta function of (k, x + 1) at k / (k + mu): by its continued fraction below, where the tail is small, and
    as what the fraction of the upper tail leaves above.

    The fraction (Didonato and Morris's, TOMS 708) is within 1e-9 after LEVELS levels and the root of x, for sizes from 0.01 to none; the lower
    one ends after x. So the work grows with the root of the count, and no count is too large. No events expected: certain.
    """
    x, size = x.cast("double"), F.coalesce(k, F.lit(NO_SIZE))
    p, low = size / (size + mu), mu * (1 + 1 / size) >= x + 1
    either = lambda one, other: F.when(low, one).otherwise(other)
    depth = F.ceil(F.lit(LEVELS) + F.sqrt(x))
    # the parameters are bound once, not worked out again on every level
    given = F.struct(
        low.alias("low"), either(size, x + 1).alias("a"), either(x + 1, size).alias("b"), either(p, mu / (size + mu)).alias("p"), (either(mu - x - 1, x + 1 - mu) * p).alias("l"),
        F.greatest(F.lit(1).cast("long"), either(F.least(depth, x.cast("long")), depth)).alias("depth"), (log_pmf(x, mu, k) + F.log(mu * (size + x) / (size + mu))).alias("front"),
    )

    def tail(g: Column) -> Column:
        a, b, q = g["a"], g["b"], g["p"]
        beta = lambda n: n + n * (b - n) * q / (a + F.abs(2 * n - 1)) + (a + n) * (g["l"] + 1 + n * (2 - q)) / (a + 2 * n + 1)
        alpha = lambda n: n * (b - n) * (a + n - 1) / (a + 2 * n - 1) * (a + b + n - 1) / (a + 2 * n - 1) * q * q
        step = lambda f, n: beta(n - 1) + alpha(n) / F.when(f == 0, 1e-300).otherwise(f)
        end = lambda f: F.when(g["low"], g["front"] - F.log(f)).otherwise(F.log1p(-F.least(F.lit(1 - 2.0**-53), F.exp(g["front"]) / f)))
        return F.aggregate(F.sequence(g["depth"], F.lit(1).cast("long"), F.lit(-1).cast("long")), beta(g["depth"].cast("double")), lambda f, n: step(f, n.cast("double")), end)

    return F.when(mu <= 0, F.lit(0.0)).otherwise(F.least(F.lit(0.0), F.get(F.transform(F.array(given), tail), 0)))


def log_sum(c: Column) -> Column:
    """log of the sum of exp, as an aggregate: a maximum would need a second pass, so terms are held over LOG_FLOOR."""
    return F.log(F.sum(F.exp(F.greatest(c, F.lit(LOG_FLOOR)))))


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def log_normal_cdf(z: Column) -> Column:
    """log of the normal distribution function, by its continued fraction where z < -3 and by the error function's series above."""
    t = -z
    # Mills ratio by a continued fraction of 60 levels, from the innermost out
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1)), t, lambda a, i: t + i / a)
    far = -t * t / 2 - 0.5 * math.log(2 * math.pi) - F.log(fraction)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(120)), F.struct(z.alias("t"), z.alias("s")), lambda a, i: F.struct((a["t"] * z * z / (2 * i + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * i + 1)).alias("s")), lambda a: a["s"])
    near = F.log(F.greatest(F.lit(1e-300), 0.5 + series * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)))
    return F.when(z < -3, far).when(z > 8, F.lit(0.0)).otherwise(F.least(F.lit(0.0), near))
