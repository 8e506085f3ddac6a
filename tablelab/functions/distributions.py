"""Distribution functions: a normal quantile as a column, chi-square tail, Shapiro-Wilk."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_NORMAL = NormalDist()

# Coefficients of the published approximation AS 241 (PPND16),
# lowest power first, numerator and denominator for each of three regions.
AS241 = {
    "centre": (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
         4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
         3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    "middle": (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
         1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
         1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "tail": (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
         2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4,
         1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}


def _ratio(region: str, x: Column) -> Column:
    def horner(coefficients) -> Column:
        total = F.lit(coefficients[-1])
        for c in reversed(coefficients[:-1]):
            total = total * x + F.lit(c)
        return total

    top, bottom = AS241[region]
    return horner(top) / horner(bottom)


def add_normal_quantile(df: DataFrame, p: str, out: str) -> DataFrame:
    """Adds the inverse of the standard normal distribution function at a column with 0 < p < 1.

    The argument of the polynomials is a column of its own, worked out once.
    """
    q, r, x = F.col(p) - 0.5, F.col("_r"), F.col("_x")
    central = F.abs(q) <= 0.425
    argument = F.when(central, F.lit(0.180625) - q * q).when(r <= 5, r - 1.6).otherwise(r - 5)
    value = (
        F.when(central, q * _ratio("centre", x))
        .when(r <= 5, F.signum(q) * _ratio("middle", x))
        .otherwise(F.signum(q) * _ratio("tail", x))
    )
    staged = df.withColumn("_r", F.sqrt(-F.ln(F.least(F.col(p), 1 - F.col(p))))).withColumn("_x", argument)
    return staged.withColumn(out, value).drop("_r", "_x")


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, half = df / 2, x / 2
    scale = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= half / k
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300
    b = half + 1 - a
    c, d = 1 / tiny, 1 / b
    fraction = d
    for i in range(1, 10000):
        step = i * (a - i)
        b += 2
        d = 1 / ((step * d + b) or tiny)
        c = (b + step / c) or tiny
        fraction *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return scale * fraction


# Polynomials of the published approximation AS R94, lowest power first.
R94_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
R94_SECOND = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
R94_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
R94_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
R94_SMALL_G = (-2.273, 0.459)
R94_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
R94_SD = (-0.4803, -0.082676, 0.0030302)


def _poly(coefficients, x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_wilk(values) -> tuple[float, float] | None:
    """The W statistic and its p-value of values at hand; null when undefined."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return None if n < 3 else (1.0, 1.0)
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    spread = x - x.mean()
    ends = [x[i] for i in sorted({0, 1, n - 2, n - 1})]
    return shapiro_from_sums(n, float(m @ x), float(m @ m), ends, float(spread @ spread))


def shapiro_from_sums(n: int, cross: float, norm: float, ends: Sequence[float], spread: float) -> tuple[float, float] | None:
    """W and its p-value from sums over ``n`` sorted values.

    ``cross`` and ``norm`` are the sums of the normal scores times the values
    and squared, ``ends`` the two smallest and two largest values (their weights
    are not the scores), ``spread`` the squared deviations from the mean.
    """
    if n < 3 or len(ends) < 3:
        return None
    if n == 3:
        top = math.sqrt(0.5) * (ends[-1] - ends[0])
    else:
        scores = [_NORMAL.inv_cdf((n + 1 - i - 0.375) / (n + 0.25)) for i in (1, 2)]
        u = 1 / math.sqrt(n)
        edge = [scores[0] / math.sqrt(norm) + _poly(R94_LAST, u)]
        if n > 5:
            edge.append(scores[1] / math.sqrt(norm) + _poly(R94_SECOND, u))
        gaps = [ends[-1] - ends[0], ends[-2] - ends[1]]
        rest = norm - 2 * sum(v * v for v in scores[: len(edge)])
        inner = cross - sum(v * g for v, g in zip(scores[: len(edge)], gaps))
        top = inner / math.sqrt(rest / (1 - 2 * sum(e * e for e in edge))) + sum(e * g for e, g in zip(edge, gaps))
    w = min(1.0, top * top / spread)
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    if w == 1.0:
        return w, 1.0
    y, size = math.log(1 - w), math.log(n)
    if n <= 11:
        limit = _poly(R94_SMALL_G, n)
        if y >= limit:
            return w, 1e-99
        z = (-math.log(limit - y) - _poly(R94_SMALL_MEAN, n)) / math.exp(_poly(R94_SMALL_SD, n))
    else:
        z = (y - _poly(R94_MEAN, size)) / math.exp(_poly(R94_SD, size))
    return w, 0.5 * math.erfc(z / math.sqrt(2))
