"""Closed-form derivatives against central differences, and special functions against known values."""

import math

import numpy as np
import pytest

from lodestat.stats import likelihoods as L

RNG = np.random.default_rng(11)
N = 200
X = np.column_stack([np.ones(N), RNG.normal(0, 0.5, N), RNG.normal(0, 0.7, N)])
OFF = np.insert(X, 1, RNG.normal(0, 0.2, N), axis=1)
COUNTS = RNG.poisson(1.3, N) * RNG.integers(0, 2, N).astype(float)
MODELS = {
    "logit": (L.ll_logit, [0.2, -0.5, 0.8], X, RNG.integers(0, 2, N)),
    "probit": (L.ll_probit, [0.2, -0.5, 0.8], X, RNG.integers(0, 2, N)),
    "poisson": (L.ll_poisson, [0.2, -0.3, 0.4], OFF, COUNTS),
    "negative binomial": (L.ll_negative_binomial, [0.2, -0.3, 0.4, -0.6], OFF, COUNTS),
    "zero inflated": (L.ll_zero_inflated("poisson", 3), [0.2, -0.3, 0.4, 0.3, -0.2, 0.5], OFF, COUNTS),
    "zero inflated nb": (L.ll_zero_inflated("negbin", 3), [0.2, -0.3, 0.4, -0.5, 0.3, -0.2, 0.5], OFF, COUNTS),
    "hurdle": (L.ll_hurdle("poisson", 3), [0.2, -0.3, 0.4, 0.3, -0.2, 0.5], OFF, COUNTS),
    "hurdle nb": (L.ll_hurdle("negbin", 3), [0.2, -0.3, 0.4, -0.5, 0.3, -0.2, 0.5], OFF, COUNTS),
    "tobit left": (L.ll_tobit(0.0, False), [0.4, 0.5, -0.8, 0.1], X, np.maximum(0, RNG.normal(0.3, 1, N))),
    "tobit right": (L.ll_tobit(1.0, True), [0.4, 0.5, -0.8, 0.1], X, np.minimum(1, RNG.normal(0.3, 1, N))),
    "ordinal": (L.ll_ordinal(), [0.5, -0.8, -1.0, 0.2, -0.4], X[:, 1:], RNG.integers(0, 4, N)),
}


@pytest.mark.parametrize("name", MODELS)
def test_derivatives_are_those_of_the_value(name):
    model, theta, x, y = MODELS[name]
    theta, y = np.array(theta, float), np.asarray(y, float)
    k, h = len(theta), 1e-5
    value = lambda t: model(t, x, y).value
    sums = L.block_sums(model(theta, x, y))
    score, curve = sums[1 : 1 + k], sums[1 + k : 1 + k + k * k].reshape(k, k)
    each = np.array([(value(theta + h * e) - value(theta - h * e)) / (2 * h) for e in np.eye(k)])
    assert sums[0] == pytest.approx(value(theta).sum())
    assert np.allclose(score, each.sum(1), rtol=1e-6, atol=1e-6)
    assert np.allclose(sums[1 + k + k * k :].reshape(k, k), each @ each.T, rtol=1e-5, atol=1e-5)
    slopes = lambda t: L.block_sums(model(t, x, y))[1 : 1 + k]
    twice = np.array([(slopes(theta + h * e) - slopes(theta - h * e)) / (2 * h) for e in np.eye(k)])
    assert np.allclose(curve, -twice, rtol=1e-5, atol=1e-4), name
    assert np.allclose(curve, curve.T)


def test_digamma_and_trigamma():
    assert L.digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert L.digamma(0.5) == pytest.approx(-0.5772156649015329 - 2 * math.log(2), abs=1e-13)
    assert L.trigamma(1.0) == pytest.approx(math.pi**2 / 6, abs=1e-13)
    assert L.trigamma(0.5) == pytest.approx(math.pi**2 / 2, abs=1e-12)
    x = np.array([1e-3, 0.3, 4.0, 700.0])
    assert np.allclose(L.digamma(x + 1) - L.digamma(x), 1 / x, rtol=1e-12)
    assert np.allclose(L.trigamma(x) - L.trigamma(x + 1), 1 / x**2, rtol=1e-8)


def test_tails_stay_finite():
    y = np.array([0.0, 1.0])
    for far in (-800.0, 800.0):
        for model in (L.ll_logit, L.ll_probit):
            p = model(np.array([far]), np.ones((2, 1)), y)
            assert all(np.isfinite(v).all() for v in (p.value, p.first[0], p.second[0][0]))


@pytest.mark.parametrize("name", MODELS)
def test_rows_that_count_several_times_are_repeated_rows(name):
    model, theta, x, y = MODELS[name]
    theta, y, times = np.array(theta, float), np.asarray(y, float), np.arange(N) % 4
    at = np.repeat(np.arange(N), times)
    assert np.allclose(L.block_sums(model(theta, x, y), times.astype(float)), L.block_sums(model(theta, x[at], y[at])), rtol=1e-9, atol=1e-9)


def test_passes_go_over_distinct_rows(spark):
    """Equal rows become one that stands for them, and fits are those of all rows."""
    from pyspark.sql import functions as F

    from lodestat.stats import run_analysis
    from lodestat.stats.design import counted

    own = spark.range(40).select((F.col("id") % 5).cast("double").alias("y"), (F.col("id") % 8).cast("double").alias("x"))
    many = own.crossJoin(spark.range(30).select(F.lit(1).alias("_"))).drop("_")
    got = counted(many, ["y", "x"]).collect()
    assert len(got) == 40 and {r["_times"] for r in got} == {30.0}
    assert {r["_times"] for r in counted(own, ["y", "x"]).collect()} == {1.0}
    for kind, p in (("poisson_regression", {}), ("quantile_regression", {"quantiles": [0.25, 0.5]})):
        few, all_ = (run_analysis(d, kind, target="y", features=["x"], **p)["tables"]["coefficients"] for d in (own, many))
        for a, b in zip(few, all_, strict=True):
            assert all(b[k] == pytest.approx(a[k], rel=1e-4, abs=1e-4) for k in (a if kind[0] == "q" else ["coefficient"]))
