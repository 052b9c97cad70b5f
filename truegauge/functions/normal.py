"""The normal and binomial distributions: Python functions for the driver, Column expressions for plans."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

ALTERNATIVES = ("two-sided", "larger", "smaller")

#: Coefficients of the published rational Chebyshev fit of erfc, of relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def check_alternative(alternative: str) -> str:
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}, not {alternative!r}")
    return alternative


def z_of(alpha: float, alternative: str = "two-sided") -> float:
    """How many standard errors an interval of error level alpha reaches out."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must be between 0 and 1")
    return NormalDist().inv_cdf(1 - (alpha / 2 if check_alternative(alternative) == "two-sided" else alpha))


def interval(estimate: Column, se: Column, alpha: float, alternative: str = "two-sided") -> tuple[Column, Column]:
    """Bounds of the z-interval; a one-sided one ends at infinity on the other side."""
    z = z_of(alpha, alternative)
    low = F.lit(-math.inf) if alternative == "smaller" else estimate - z * se
    high = F.lit(math.inf) if alternative == "larger" else estimate + z * se
    return low, high


def erfc(x: Column) -> Column:
    t = 1 / (1 + 0.5 * F.abs(x))
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def p_value(z: Column, alternative: str = "two-sided") -> Column:
    x = {"two-sided": F.abs(z), "larger": z, "smaller": -z}[check_alternative(alternative)]
    return erfc(x / math.sqrt(2)) * (1.0 if alternative == "two-sided" else 0.5)


def p_value_of(z: float, alternative: str = "two-sided") -> float:
    if check_alternative(alternative) == "two-sided":
        return math.erfc(abs(z) / math.sqrt(2))
    return math.erfc((z if alternative == "larger" else -z) / math.sqrt(2)) / 2


def expit(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log1pexp(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bisect(f, low: float, high: float, steps: int = 200) -> float | None:
    """A root of f between low and high, or None if f has the same sign at both."""
    a, b = f(low), f(high)
    if a == 0:
        return low
    if b == 0:
        return high
    if (a > 0) == (b > 0):
        return None
    for _ in range(steps):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        m = f(mid)
        if (m > 0) == (a > 0):
            low = mid
        else:
            high = mid
    return (low + high) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for m in range(1, 10_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + term * d or tiny)
            c = 1 + term / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def binomial_cdf(k: float, n: int, p: float) -> float:
    k = math.floor(k)
    return 0.0 if k < 0 else 1.0 if k >= n else 1 - incomplete_beta(k + 1, n - k, p)


def binomial_ppf(q: float, n: int, p: float) -> int:
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if binomial_cdf(mid, n, p) >= q - 1e-14 else (mid + 1, high)
    return low


def binomial_bounds(n: int, alpha: float, mean: float) -> tuple[float, float]:
    """Proportions at which a count of n * mean lies on the lower and the upper tail of alpha / 2."""
    k = round(n * mean)
    tail = lambda level: bisect(lambda p: binomial_cdf(k, n, p) - level, 0.0, 1.0)
    high, low = tail(alpha / 2), tail(1 - alpha / 2)
    return 0.0 if low is None else low, 1.0 if high is None or k >= n else high


def max_binomial_error(n: int, classes: int, alpha: float, means) -> float:
    """The largest distance of a binomial bound from its mean, over the classes at alpha shared among them."""
    return max(abs(b - m) for m in means for b in binomial_bounds(n, alpha / classes, float(m)))


def dkw_error(n: int, alpha: float) -> float:
    return math.sqrt(2 / n * math.log(2 / alpha))
