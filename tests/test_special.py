"""Tail probabilities against published table values and exact closed forms."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from abode.functions import special as S
from abode.operators import geo as G


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(v):
    return F.lit(float(v))


# Table values: two-sided 5 % and 1 % points of t, upper 5 % points of F and chi-square.
@pytest.mark.parametrize("t, df, p", [(12.706, 1, 0.05), (2.228, 10, 0.05), (3.169, 10, 0.01), (2.042, 30, 0.05), (1.96, 1e6, 0.05), (0.0, 5, 1.0)])
def test_t_table(spark, t, df, p):
    assert math.isclose(value(spark, S.t_two_sided(lit(t), lit(df))), p, rel_tol=2e-3)


@pytest.mark.parametrize("f, d1, d2, p", [(4.96, 1, 10, 0.05), (3.10, 3, 20, 0.05), (2.37, 5, 60, 0.05), (161.4, 1, 1, 0.05), (4.43, 3, 30, 0.0108)])
def test_f_table(spark, f, d1, d2, p):
    assert math.isclose(value(spark, S.f_upper(lit(f), lit(d1), lit(d2))), p, rel_tol=1e-2)


@pytest.mark.parametrize("x, df, p", [(3.841, 1, 0.05), (5.991, 2, 0.05), (18.307, 10, 0.05), (43.773, 30, 0.05), (0.103, 2, 0.95)])
def test_chi_square_table(spark, x, df, p):
    assert math.isclose(value(spark, S.chi2_upper(lit(x), lit(df))), p, rel_tol=2e-3)


def test_closed_forms(spark):
    for x in (0.0, 0.01, 0.5, 0.9, 0.999, 1.0):
        assert math.isclose(value(spark, S.beta_inc(lit(1), lit(1), lit(x))), x, abs_tol=1e-12)
        assert math.isclose(value(spark, S.beta_inc(lit(3), lit(1), lit(x))), x ** 3, abs_tol=1e-12)
        assert math.isclose(value(spark, S.beta_inc(lit(0.5), lit(0.5), lit(x))), 2 / math.pi * math.asin(math.sqrt(x)), abs_tol=1e-10)
    for x in (0.0, 0.1, 1.0, 7.0, 40.0):
        assert math.isclose(value(spark, S.gamma_q(lit(1), lit(x))), math.exp(-x), rel_tol=1e-10)
        assert math.isclose(value(spark, S.gamma_q(lit(0.5), lit(x))), math.erfc(math.sqrt(x)), rel_tol=1e-9)
    assert math.isclose(value(spark, S.gamma_q(lit(5e5), lit(5e5))), 0.5, abs_tol=1e-3)
    for x in (0.5, 1.0, 2.5, 30.0, 1e6):
        assert math.isclose(value(spark, S.log_gamma(lit(x))), math.lgamma(x), rel_tol=1e-12, abs_tol=1e-12)
    assert value(spark, S.beta_inc(lit(1), lit(1), F.lit(None).cast("double"))) is None


def test_tests_carry_their_p_values(spark):
    rows = [("a", float(v)) for v in (19.8, 20.4, 19.6, 17.8, 18.5, 18.9, 18.3, 18.9, 19.5, 22.0)] + [
        ("b", float(v)) for v in (28.2, 26.6, 20.1, 23.3, 25.2, 22.1, 17.7, 27.6, 20.6, 13.7, 23.2, 17.5, 20.6, 18.0, 23.9, 21.6, 24.3, 20.4, 24.0, 13.2)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = G.welch_t(df, "g", "v", "a", "b").first()
    assert math.isclose(t.t, -2.2192, abs_tol=1e-3) and math.isclose(t.df, 24.4963, abs_tol=1e-2) and math.isclose(t.p_value, 0.0360, abs_tol=2e-4)
    f = G.anova_f(df, "g", "v").first()
    assert math.isclose(f.p_value, value(spark, S.t_two_sided(F.sqrt(lit(f.f)), lit(28))), rel_tol=1e-9)  # two groups: F is t squared
    cells = spark.createDataFrame([("m", "x")] * 20 + [("m", "y")] * 30 + [("w", "x")] * 30 + [("w", "y")] * 20, "r string, c string")
    c = G.chi_square(cells, "r", "c").first()
    assert math.isclose(c.chi2, 4.0, abs_tol=1e-9) and c.dof == 1 and math.isclose(c.p_value, 0.0455, abs_tol=1e-4)
    assert G.welch_t(df, "g", "v", "a", "none").first().p_value is None
