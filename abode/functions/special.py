"""Tail probabilities as column expressions: incomplete beta and gamma functions (M5 p-values).

Both are evaluated by their continued fractions (Lentz's scheme) inside ``aggregate`` over a
sequence, so the expression stays small and runs in the JVM. The number of terms follows the
parameters' square root, as the fractions' convergence does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients of the gamma function for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 0.5."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        total = total + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(0.9189385332046727) + (z + 0.5) * F.log(t) - t + F.log(total)


def _off_zero(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(first: Column, terms: Column, pair) -> Column:
    """Continued fraction by Lentz's scheme: ``first`` is its inverse start, ``pair(i)`` gives the i-th (a, b)."""
    start = F.struct((1 / _off_zero(first)).alias("d"), F.lit(1 / TINY).alias("c"), (1 / _off_zero(first)).alias("h"))

    def step(acc, i):
        a, b = pair(i)
        d = 1 / _off_zero(b + a * acc["d"])
        c = _off_zero(b + a / acc["c"])
        return F.struct(d.alias("d"), c.alias("c"), (acc["h"] * d * c).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), terms.cast("int")), start, step)["h"]


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b >= 0.5; null outside 0 <= x <= 1."""
    terms = F.lit(200) + 10 * F.sqrt(F.greatest(a, b))

    def side(p, q, y):
        def pair(j):  # even and odd terms in turn
            m = F.floor(j / 2)
            even = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(j % 2 == 0, even).otherwise(odd), F.lit(1.0)

        front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.log(y) + q * F.log(1 - y))
        # 1 / (1 + a_1 / (1 + a_2 / ...)): the first term is a_1
        return front / p * _fraction(F.lit(1.0), 2 * terms, pair)

    inside = F.when(x < (a + 1) / (a + b + 2), side(a, b, x)).otherwise(1 - side(b, a, 1 - x))
    return F.when(x == 0, 0.0).when(x == 1, 1.0).when((x > 0) & (x < 1), inside)


def gamma_q(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x) for a >= 0.5; null for x < 0."""
    terms = F.lit(200) + 20 * F.sqrt(a)
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    upper = front * _fraction(x + 1 - a, terms, lambda i: (-i * (i - a), x + 2 * i + 1 - a))
    series = F.aggregate(F.sequence(F.lit(1), (2 * terms).cast("int")), F.struct((1 / a).alias("t"), (1 / a).alias("s")),
                         lambda acc, i: F.struct((acc["t"] * x / (a + i)).alias("t"), (acc["s"] + acc["t"] * x / (a + i)).alias("s")))["s"]
    return F.when(x == 0, 1.0).when((x > 0) & (x < a + 1), 1 - front * series).when(x > 0, upper)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with ``df`` degrees of freedom."""
    return beta_inc(df / 2, F.lit(0.5), df / (df + t * t))


def f_upper(f: Column, d1: Column, d2: Column) -> Column:
    """P(F >= f) of the F distribution."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: Column, df: Column) -> Column:
    """P(X >= x) of the chi-square distribution."""
    return gamma_q(df / 2, x / 2)
