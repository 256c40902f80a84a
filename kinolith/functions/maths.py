"""Number and time expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def percent_bin(x: Column) -> Column:
    """Bin 0..100 by half-even rounding."""
    return clamp(F.rint(x), 0.0, 100.0).cast("int")


def width_bin(x: Column, low: Column, width: float) -> Column:
    """1-based bin of a given width, the first beginning at floor(low)."""
    return (F.floor((x - F.floor(low)) / width) + 1).cast("int")


def unit_bin(x: Column, per_unit: int) -> Column:
    return F.floor(x * per_unit).cast("int")


def effective_number_weight(count: Column, beta: float = 0.9) -> Column:
    """Inverse of the effective number of samples of a class."""
    return F.lit(1 - beta) / (1 - F.pow(F.lit(beta), count))


def root_inverse_weight(count: Column) -> Column:
    return F.sqrt(1.0 / count)


def step_weight(label: Column, over: float = 4.0, weight: float = 2.0) -> Column:
    """weight for labels over a limit, else one."""
    return F.when(label > over, weight).otherwise(1.0)


def log_with_base(x: Column, base: float) -> Column:
    """Logarithm to a base; null where x is not positive."""
    return F.when(x > 0, F.log(x) / math.log(base))


def other_base(x: Column, old: float, new: float) -> Column:
    """A logarithm to one base as one to another."""
    return x * (math.log(old) / math.log(new))


def winkler(y: Column, low: Column, high: Column, alpha: float) -> Column:
    """Interval score: width plus 2 / alpha times the distance outside."""
    miss = F.greatest(low - y, F.lit(0.0)) + F.greatest(y - high, F.lit(0.0))
    return high - low + miss * (2 / alpha)


def ratio_class(ratio: Column) -> Column:
    return F.when(ratio < 0.5, "decreased").when(ratio < 2, "like").when(ratio >= 2, "increased")


def affinity(difference: Column, deviation: Column) -> Column:
    """Gaussian of a difference with half the deviation as its scale."""
    sigma = deviation * 0.5
    return F.exp(-(difference * difference) / (2 * sigma * sigma))


def percent_done(done: Column, total: Column) -> Column:
    return F.when(F.coalesce(total, F.lit(0)) > 0, F.least(F.lit(100), F.round(done * 100 / total))).otherwise(0).cast("int")


def kernel(name: str, size: int = 5, sigma: float = 2.0) -> list[float]:
    """Weights of a smoothing kernel, the largest being one."""
    half = (size - 1) // 2
    at = range(-half, half + 1)
    if name == "gaussian":
        raw = [math.exp(-i * i / (2 * sigma * sigma)) for i in at]
    elif name == "triangular":
        raw = [1 - abs(i) / (half + 1) for i in at]
    elif name == "laplace":
        raw = [math.exp(-abs(i) / sigma) / (2 * sigma) for i in at]
    else:
        raise ValueError(f"unknown kernel {name}")
    return [x / max(raw) for x in raw]


def seconds_to_midnight(now: Column) -> Column:
    return F.unix_timestamp(F.date_add(F.to_date(now), 1).cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))


def day_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def elapsed_seconds(start: Column, end: Column, now: Column) -> Column:
    """Seconds from start to end, or to now while open; never negative."""
    stop = F.coalesce(end, now).cast("timestamp")
    return F.greatest(F.lit(0).cast("long"), F.unix_timestamp(stop) - F.unix_timestamp(start.cast("timestamp")))


def hours_minutes(seconds: Column) -> Column:
    return F.concat(
        F.floor(seconds / 3600).cast("string"), F.lit("h "), F.floor(seconds % 3600 / 60).cast("string"), F.lit("m")
    )


def iso_zulu(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def rank_sum_p(z: Column) -> Column:
    """Two-sided normal p-value; erfc by a rational approximation with errors under 2e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # coefficients of the Chebyshev fit (fixed values)
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly: Column = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)
