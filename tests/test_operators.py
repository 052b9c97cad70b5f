"""Operators against array formulas written out, and properties that must hold."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.functions import normal
from truegauge.operators import baselines, experiment, glm, labelshift, linear, mean, power, quantile, resample
from truegauge.plans.roles import one_table
from truegauge.sources.tables import load
from truegauge.streaming.means import StreamingMean


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(1)
    n, big = 80, 300
    x = rng.normal(size=(n + big, 2))
    y = 1 + x @ [0.5, -1.0] + rng.normal(size=n + big)
    f = y + 0.5 * rng.normal(size=n + big) + 0.3
    w = rng.uniform(0.5, 2, n + big)
    known = np.arange(n + big) < n
    return pd.DataFrame({"id": range(n + big), "x1": x[:, 0], "x2": x[:, 1], "y": np.where(known, y, np.nan), "f": f, "w": w, "g": np.arange(n + big) % 2})


@pytest.fixture(scope="module")
def df(spark, sample):
    return spark.createDataFrame(sample).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(5)


def arrays(s):
    known = s.y.notna()
    return s[known], s[~known]


def test_mean_is_the_array_formula(df, sample):
    a, u = arrays(sample)
    n, big = len(a), len(u)
    wl, wu = (a.w / a.w.sum() * n).to_numpy(), (u.w / u.w.sum() * big).to_numpy()
    theta = (wu * u.f).mean() + (wl * (a.y - a.f)).mean()
    g, h, k = wl * (a.y - theta), wl * (a.f - theta), wu * (u.f - theta)
    lam = np.clip(np.cov(g, h, ddof=0)[0, 1] / ((1 + n / big) * np.concatenate([h, k]).var(ddof=1)), 0, 1)
    estimate = lam * (wu * u.f).mean() + (wl * (a.y - lam * a.f)).mean()
    se = math.sqrt((lam * wu * u.f).std(ddof=0) ** 2 / big + (wl * (a.y - lam * a.f)).std(ddof=0) ** 2 / n)
    r = mean.mean_ci(df, "y", "f", w="w").first()
    assert np.allclose([r.lam, r.estimate, r.se, r.lower], [lam, estimate, se, estimate - 1.6448536269514715 * se], rtol=1e-9)


def test_mean_properties(df, spark):
    plain = mean.mean_ci(df, "y", "f").first()
    assert np.allclose(mean.mean_ci(df.repartition(2), "y", "f").first()[:], plain[:])
    shifted = mean.mean_ci(df.withColumn("y", F.col("y") * 2 + 3).withColumn("f", F.col("f") * 2 + 3), "y", "f").first()
    assert np.allclose([shifted.estimate, shifted.se], [plain.estimate * 2 + 3, plain.se * 2])
    assert np.allclose(mean.mean_ci(df, "y", "f", lam=0.0).first().estimate, mean.classical_mean_ci(df, "y").first().estimate)
    wide = {alt: mean.mean_ci(df, "y", "f", alternative=alt).first() for alt in normal.ALTERNATIVES}
    assert wide["larger"].upper == math.inf and wide["larger"].lower > wide["two-sided"].lower and wide["smaller"].lower == -math.inf
    with pytest.raises(ValueError):
        mean.mean_ci(df, "y", "f", alternative="both")
    two = mean.mean_ci(df, ["y", "y"], ["f", "f"], coord=1).collect()
    assert np.allclose([r.lam for r in two], plain.lam)
    assert mean.mean_ci(df.where("y IS NULL"), "y", "f").count() == 0
    assert mean.mean_ci(df.where("y IS NOT NULL"), "y", "f").first().lam == 0
    halves = one_table(df.where("y IS NOT NULL"), df.where("y IS NULL"), "y")
    assert np.allclose(mean.mean_ci(halves, "y", "f").first()[:], plain[:])


def test_missing_predictions_raise(df):
    with pytest.raises(Exception, match="null or NaN"):
        mean.mean_ci(df.withColumn("f", F.when(F.col("id") > 3, F.col("f"))), "y", "f").collect()


@pytest.mark.parametrize("exact", [False, True])
def test_quantile_is_the_array_formula(df, sample, exact):
    a, u = arrays(sample)
    every = np.concatenate([a.y, a.f, u.f])
    grid = np.sort(every) if exact else np.linspace(every.min(), every.max(), 5000)
    below = lambda v: (v.to_numpy()[:, None] <= grid).astype(float)
    fu, rect = below(u.f), below(a.y) - below(a.f)
    cdf = fu.mean(0) + rect.mean(0)
    se = np.maximum(np.sqrt(fu.var(0) / len(u) + rect.var(0) / len(a)), 1e-16)
    inside = grid[np.abs((cdf - 0.4) / se) < 1.6448536269514715]
    r = quantile.quantile_ci(df, "y", "f", 0.4, exact_grid=exact).first()
    assert np.allclose([r.lower, r.upper], inside[[0, -1]])
    assert np.isclose(quantile.quantile_estimate(df, "y", "f", 0.4, exact_grid=exact).first().estimate, grid[np.abs(cdf - 0.4).argmin()])
    by = {r.g: r for r in quantile.quantile_ci(df, "y", "f", 0.4, by="g", exact_grid=exact).collect()}
    alone = quantile.quantile_ci(df.where("g = 1"), "y", "f", 0.4, exact_grid=exact).first()
    assert np.allclose([by[1].lower, by[1].upper], [alone.lower, alone.upper])


def test_ols_is_the_array_formula(df, sample):
    a, u = arrays(sample)
    n, big = len(a), len(u)
    xl, xu = (t[["x1", "x2"]].to_numpy() for t in (a, u))
    fit = lambda lam: np.linalg.lstsq(xu, lam * u.f, rcond=None)[0] + np.linalg.lstsq(xl, a.y - lam * a.f, rcond=None)[0]
    h = np.linalg.inv((xl.T @ xl + xu.T @ xu) / (n + big))

    def grads(t):
        return xl * (xl @ t - a.y.to_numpy())[:, None], xl * (xl @ t - a.f.to_numpy())[:, None], xu * (xu @ t - u.f.to_numpy())[:, None]

    def tune(t):
        g, gl, gu = grads(t)
        c = (g - g.mean(0)).T @ (gl - gl.mean(0)) / n
        v = np.cov(np.concatenate([gl, gu]).T)
        return np.clip(np.trace(h @ (c + c.T) @ h) / (2 * (1 + n / big) * np.trace(h @ v @ h)), 0, 1)

    lam = tune(fit(tune(fit(1.0))))
    t = fit(lam)
    g, gl, gu = grads(t)
    se = np.sqrt(np.diag(h @ (n / big * np.cov(lam * gu.T) + np.cov((g - lam * gl).T)) @ h) / n)
    r = linear.ols_ci(df, ["x1", "x2"], "y", "f").orderBy("coord").collect()
    assert np.allclose([[x.estimate, x.se, x.lam] for x in r], np.stack([t, se, [lam, lam]], axis=1), rtol=1e-8)
    with pytest.raises(Exception, match="linearly dependent"):
        linear.ols_ci(df, ["x1", "x1"], "y", "f").collect()


def test_glm_recovers_and_warm(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 2))
    beta = np.array([0.4, -0.6])
    for family, mu in (("logistic", 1 / (1 + np.exp(-x @ beta))), ("poisson", np.exp(x @ beta))):
        y = rng.binomial(1, mu) if family == "logistic" else rng.poisson(mu)
        t = pd.DataFrame({"x1": x[:, 0], "x2": x[:, 1], "y": np.where(np.arange(3000) < 800, y, -1.0), "f": mu})
        d = spark.createDataFrame(t).withColumn("y", F.when(F.col("y") >= 0, F.col("y")))
        r = glm.glm_ci(d, family, ["x1", "x2"], "y", "f").orderBy("coord").collect()
        assert all(c.converged for c in r) and all(abs(c.estimate - b) < 0.2 for c, b in zip(r, beta, strict=True))
        c = glm.classical_glm_ci(d, family, ["x1", "x2"], "y").orderBy("coord").collect()
        assert all(a.se < 1.1 * b.se for a, b in zip(r, c, strict=True))
        assert np.allclose([v.estimate for v in glm.glm_ci(d, family, ["x1", "x2"], "y", "f", lam=0.0).orderBy("coord").collect()], [v.estimate for v in c])


def test_normal_and_binomial():
    assert np.isclose(normal.z_of(0.1), 1.6448536269514715)
    exact = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    for n, p in ((10, 0.3), (57, 0.01), (200, 0.9)):
        assert all(np.isclose(normal.binomial_cdf(k, n, p), exact(k, n, p), atol=1e-12) for k in range(0, n, 3))
        assert normal.binomial_ppf(0.5, n, p) == min(k for k in range(n + 1) if exact(k, n, p) >= 0.5 - 1e-14)
    low, high = normal.binomial_bounds(100, 0.1, 0.3)
    assert np.isclose(normal.binomial_cdf(30, 100, high), 0.05) and np.isclose(normal.binomial_cdf(30, 100, low), 0.95)
    assert normal.binomial_bounds(50, 0.1, 1.0)[1] == 1.0


def test_erfc_column(spark):
    x = [-3.0, -0.5, 0.0, 0.3, 2.0, 6.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(normal.erfc(F.col("x")), normal.expit(F.col("x")), normal.log1pexp(F.col("x"))).collect()
    for v, r in zip(x, got, strict=True):
        assert np.isclose(r[0], math.erfc(v), rtol=2e-7) and np.isclose(r[1], 1 / (1 + math.exp(-v))) and np.isclose(r[2], math.log1p(math.exp(v)))


def test_label_shift_order_and_cover(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 4000)
    f = np.where(rng.random(4000) < 0.9, y, rng.integers(0, 3, 4000))
    t = pd.DataFrame({"y": [int(v) if i < 2000 else None for i, v in enumerate(y)], "f": f}).astype({"y": "Int64"})
    d = spark.createDataFrame(t.astype(object).where(t.notna(), None), "y long, f long")
    a = labelshift.shifted_ci(d, "y", "f", 3, [1, 0, 0], counts=False).first()
    assert a[:] == labelshift.shifted_ci(d.orderBy(F.rand(1)), "y", "f", 3, [1, 0, 0], counts=False).first()[:]
    assert a.lower <= (y[2000:] == 0).mean() <= a.upper
    c = labelshift.shifted_ci(d, "y", "f", 3, [1, 0, 0]).first()
    assert c.lower <= (y[2000:] == 0).sum() <= c.upper


@pytest.mark.parametrize(("rho", "cost"), [(0.8, 0.1), (0.9, 0.2), (0.1, 0.1), (-0.7, 0.3)])
def test_no_better_plan(rho, cost):
    best = power.plan(rho, 0.0, 1.0, cost, budget=1000)
    for n in range(1, 1000):
        big = int((1000 - n * (1 + cost)) / cost)
        if big >= 0:
            assert power.effective_size(n, big, rho) <= best.effective_n * 1.01
    cheap = power.plan(rho, 0.0, 1.0, cost, effective_n=best.effective_n)
    assert cheap.cost <= 1000 * 1.01


def test_plans_refuse(recwarn):
    with pytest.raises(ValueError):
        power.plan(0.5, 0, 1, 0.1)
    with pytest.raises(ValueError):
        power.plan(1.0, 0, 1, 0.1, budget=10)
    assert power.plan(0.9, 0, 1, 0.1, effective_n=1000, n_max=500).n == 500 and len(recwarn) == 1


def test_bootstrap_covers_and_repeats(df):
    a = resample.bootstrap_ci(df, lambda v: float(np.mean(v)), "y", "f", n_resamples=200).first()
    assert a[:] == resample.bootstrap_ci(df.repartition(3), lambda v: float(np.mean(v)), "y", "f", n_resamples=200).first()[:]
    exact = mean.mean_ci(df, "y", "f", lam=a.lam).first()
    assert np.isclose(a.estimate, exact.estimate) and abs(a.lower - exact.lower) < 0.1 and abs(a.upper - exact.upper) < 0.1
    with pytest.raises(ValueError, match="more than 10 rows"):
        resample.bootstrap_ci(df, np.mean, "y", "f", most_rows=10)
    p = resample.poisson_mean_ci(df, "y", "f", "id").first()
    assert abs(p.estimate - mean.mean_ci(df, "y", "f", lam=1.0).first().estimate) < 0.1


def test_isotonic(spark):
    rows = [(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 5.0), (4.0, 7.0), (2.5, None), (3.5, None), (0.0, None), (9.0, None)]
    out = {r.f: r.v for r in baselines.recalibrated(spark.createDataFrame(rows, "f double, y double"), "y", "f", "f").collect()}
    assert np.allclose([out[f] for f in (1, 2, 3, 4, 2.5, 3.5, 0, 9)], [1, 2.5, 2.5, 6, 2.5, 4.25, 1, 6])


def test_weighted_sample_and_shift(df):
    s = experiment.weighted_sample(df, 40, "w", "id")
    assert s.count() == 40 and s.select("id").distinct().count() == 40
    t = experiment.covariate_shift_weights(df, "g", F.col("y").isNotNull())
    shares = {r.g: r[1] for r in t.where("y IS NOT NULL").groupBy("g").agg(F.sum("weight")).collect()}
    assert np.isclose(shares[0] + shares[1], 80)


def test_streamed_means_are_batch_means(df):
    m = StreamingMean("y", "f")
    for k in range(4):
        m.update(df.where(F.col("id") % 4 == k), k)
    m.update(df, 3)  # comes again
    want = mean.mean_ci(df, "y", "f").first()
    assert np.allclose(m.estimate(), [want.estimate, want.se, want.lam])


def test_unknown_dataset(spark):
    with pytest.raises(NotImplementedError):
        load(spark, "/root/testdata/sf0.01", "galaxies")
