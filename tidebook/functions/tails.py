"""Tail probabilities as columns: log-gamma, the incomplete beta function, the error function, and p-values from them.

The series and continued fractions are folds over sequences, so a row's p-value is computed where the row is. They are
long expressions for the few rows that statistics end in (one per coin, feature and horizon), not for every tick.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of the asymptotic series of log-gamma, in 1/z, 1/z^3 and so on: fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156)
#: Arguments are moved up by this much before the series is used.
SHIFT = 12
TINY = 1e-300


def _double(x: Column | float) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _series(z: Column) -> Column:
    total = F.lit(0.0)
    for c in reversed(STIRLING):
        total = F.lit(c) / z + total / (z * z)
    return total


def log_gamma(x: Column | float) -> Column:
    """ln of the gamma function of a positive number."""

    def of(x: Column) -> Column:
        steps = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda acc, i: acc + F.log(x + i))
        z = x + float(SHIFT)
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + _series(z) - steps

    return _let(_double(x), of)


def log_gamma_step(a: Column | float, b: Column | float) -> Column:
    """ln gamma(a + b) - ln gamma(a), without the loss of digits that the difference of two large values has."""

    def of(p: Column) -> Column:
        a, b = p["a"], p["b"]
        z = a + float(SHIFT)
        steps = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda acc, i: acc + F.log1p(b / (a + i)))
        return (z - 0.5) * F.log1p(b / z) + b * F.log(z + b) - b + _series(z + b) - _series(z) - steps

    return _let(F.struct(_double(a).alias("a"), _double(b).alias("b")), of)


def _fraction(p: Column) -> Column:
    """The continued fraction of the incomplete beta function at p (a, b, x), each step from the one before; as many steps as its
    convergence asks for, which go with the root of the larger parameter."""
    steps = F.least(F.lit(200_000.0), F.lit(60.0) + 8 * F.sqrt(F.greatest(p["a"], p["b"]))).cast("int")
    keep = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def half(s: Column, term: Column) -> Column:
        d = 1 / keep(1 + term * s["d"])
        c = keep(1 + term / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["f"] * c * d).alias("f"))

    def step(s: Column, m: Column) -> Column:
        a, b, x = p["a"], p["b"], p["x"]
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _let(half(s, even), lambda s: half(s, odd))

    d = 1 / keep(1 - (p["a"] + p["b"]) * p["x"] / (p["a"] + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("f"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), steps), lambda m: m.cast("double")), start, step, lambda s: s["f"])


def beta_inc(a: Column | float, b: Column | float, x: Column | float, rest: Column | None = None) -> Column:
    """The regularized incomplete beta function. `rest` is 1 - x, for callers who know it better than the difference does."""
    x = _double(x)
    rest = 1 - x if rest is None else rest.cast("double")

    def of(p: Column) -> Column:
        turned = p["x"] > (p["a"] + 1) / (p["a"] + p["b"] + 2)
        pick = lambda f, g: F.when(turned, p[g]).otherwise(p[f])
        q = F.struct(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("x", "y").alias("x"), pick("y", "x").alias("y"))

        def tail(q: Column) -> Column:
            front = log_gamma_step(q["a"], q["b"]) - log_gamma(q["b"]) + q["a"] * F.log(q["x"]) + q["b"] * F.log(q["y"])
            return F.exp(front) / q["a"] * _fraction(q)

        inside = _let(q, tail)
        value = F.when(turned, 1 - inside).otherwise(inside)
        return F.when(p["x"] <= 0, F.lit(0.0)).when(p["y"] <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)))

    return _let(F.struct(_double(a).alias("a"), _double(b).alias("b"), x.alias("x"), rest.alias("y")), of)


def erfc(x: Column | float) -> Column:
    """The complementary error function of a number of 0 or more: a series of positive terms below 2, from there on the
    continued fraction from its 80th term back."""

    def of(x: Column) -> Column:
        count = F.transform(F.sequence(F.lit(1), F.lit(80)), lambda i: i.cast("double"))
        start = F.struct(x.alias("term"), x.alias("sum"))

        def add(s: Column, n: Column) -> Column:
            return _let(s["term"] * 2 * x * x / (2 * n + 1), lambda t: F.struct(t.alias("term"), (s["sum"] + t).alias("sum")))

        small = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * F.aggregate(count, start, add, lambda s: s["sum"])
        deep = F.aggregate(F.reverse(count), F.lit(0.0), lambda acc, n: n / 2 / (x + acc))
        return F.when(x < 2, small).otherwise(F.exp(-x * x) / math.sqrt(math.pi) / (x + deep))

    return _let(_double(x), of)


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|) of the standard normal distribution."""
    return erfc(F.abs(z) / math.sqrt(2))


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's distribution; null without degrees of freedom."""
    df, square = df.cast("double"), t.cast("double") * t.cast("double")
    return F.when(df > 0, beta_inc(df / 2, 0.5, df / (df + square), square / (df + square)))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation of n pairs, the ranks' too; null below three pairs."""
    n = n.cast("double")
    inside = beta_inc((n - 2) / 2, 0.5, (1 - r) * (1 + r), r * r)
    return F.when((n >= 3) & r.isNotNull(), F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(inside))


def binomial_two_sided(hits: Column, n: Column) -> Column:
    """The exact test of an even chance: all outcomes at most as likely as this one; null without outcomes."""
    k = F.least(hits, n - hits).cast("double")
    n = n.cast("double")
    # P(X <= k) for p = 1/2; the two tails are equal
    return F.when(n > 0, F.when(2 * k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * beta_inc(n - k, k + 1, 0.5))))
