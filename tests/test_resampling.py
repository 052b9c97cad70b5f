"""Resampling, predict-then-debias, linear fits of any width and trials, against array formulas and coverage levels."""

import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from truegauge.operators import baselines, cross, experiment, glm, labelshift, linear, mean, ptd, quantile, resample
from truegauge.streaming.means import StreamingMean


def table(spark, known, **columns):
    t = pd.DataFrame(columns)
    t["y"] = np.where(known, t["y"], np.nan)
    return spark.createDataFrame(t.assign(id=range(len(t)))).withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(4)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1100, 2))
    y = 1 + x @ [0.5, -1.0] + rng.normal(size=1100)
    data = {"x1": x[:, 0], "x2": x[:, 1], "h1": x[:, 0] + rng.normal(size=1100), "y": y, "f": y + 0.4 * rng.normal(size=1100) + 0.3}
    known = np.arange(1100) < 150
    return table(spark, known, **data), known, data


def test_weights_are_poisson():
    w = resample.weights(np.arange(4000), 3, 1 + np.arange(400))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w[:200])[np.triu_indices(200, 1)].mean()) < 0.005
    assert 0.8 < (w - 1).sum(axis=0).var() / 4000 < 1.2
    assert (resample.weights(np.arange(9), 3, np.array([resample.WHOLE])) == 1).all()


def test_moment_bootstrap_is_what_its_weights_say(sample):
    df, known, d = sample
    ids = 1 + np.arange(60)
    w = resample.weights(np.arange(1100), 5, ids)
    f, y = d["f"], d["y"]
    values = [np.average(f[~known], weights=v[~known]) * 0.7 + np.average(y[known], weights=v[known]) - 0.7 * np.average(f[known], weights=v[known]) for v in w.T]
    for t in (df, df.repartition(2)):
        r = resample.bootstrap_ci(t, resample.MEAN, "y", "f", lam=0.7, n_resamples=60, seed=5, key="id").first()
        assert np.allclose([r.lower, r.upper], np.quantile(values, [0.05, 0.95]))
    many = resample.bootstrap_ci(df, resample.MEAN, "y", "f", n_resamples=1000, key="id").first()
    exact = mean.mean_ci(df, "y", "f", lam=many.lam).first()
    assert np.isclose(many.estimate, exact.estimate) and abs(many.lower - exact.lower) < 0.04 and abs(many.upper - exact.upper) < 0.04
    with pytest.raises(ValueError, match="key"):
        resample.bootstrap_ci(df, resample.MEAN, "y", "f")


def test_bootstrap_of_any_statistic_keeps_pairs(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": 2 * a, "c": rng.normal(size=300)}))
    stat = lambda t: [np.corrcoef(t["a"], t["b"])[0, 1], np.corrcoef(t["a"], t["c"])[0, 1]]
    paired = resample.paired_bootstrap(df, stat, ["a", "b", "c"], [["a", "b"]], 50)
    assert paired.shape == (50, 2) and np.allclose(paired[:, 0], 1)
    alone = resample.paired_bootstrap(df, stat, ["a", "b", "c"], [], 50)
    assert np.abs(alone[:, 0]).max() < 0.5


def test_debiased_fits(sample):
    df, known, d = sample
    x, h, y, f = np.stack([np.ones(1100), d["x1"]], 1), np.stack([np.ones(1100), d["h1"]], 1), d["y"], d["f"]
    w = resample.weights(np.arange(1100), 0, np.arange(41))
    fit = lambda a, v, c: np.linalg.solve((a * c[:, None]).T @ a, (a * c[:, None]).T @ v)
    three = np.array([np.concatenate([fit(x, y, c * known), fit(h, f, c * known), fit(h, f, c * ~known)]) for c in w.T])
    cov = np.cov(three[1:].T)
    tuned = np.diag(cov[:2, 2:4]) / (np.diag(cov[2:4, 2:4]) + np.diag(cov[4:, 4:]))
    v = tuned * three[:, 4:] + three[:, :2] - tuned * three[:, 2:4]
    one = df.withColumn("one", F.lit(1.0))
    got = ptd.ptd_linear(one, ["one", "x1"], ["one", "h1"], "y", "f", n_resamples=40, key="id").orderBy("coord").collect()
    assert np.allclose([[r.tuning, r.estimate, r.lower, r.upper] for r in got], np.stack([tuned, v[0], *np.quantile(v[1:], [0.025, 0.975], axis=0)], 1), rtol=1e-6)
    assert all(abs(r.estimate - t) < 0.4 for r, t in zip(got, (1, 0.5), strict=True))


def test_debiased_logistic_is_newton(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 2))
    p = 1 / (1 + np.exp(-x @ [0.8, -0.5]))
    known = np.arange(600) < 200
    df = table(spark, known, x1=x[:, 0], x2=x[:, 1], y=(rng.random(600) < p).astype(float), f=p)
    t = resample.keyed(df, "id", ["y"], ["x1", "x2", "f", "x1", "x2"])
    got = ptd.logistic_replicates(t, 3, False, np.arange(4), 0)
    w, y = resample.weights(np.arange(600), 0, np.arange(4)), df.orderBy("id").toPandas()["y"].to_numpy()
    for b in range(4):
        for part, (v, on) in enumerate(((np.nan_to_num(y), known), (p, known), (p, ~known))):
            assert np.allclose(got[b, part], resample.logit(x[on], v[on], w[on, b]), atol=1e-6)


def test_semisupervised_mean_by_folds(spark):
    rng = np.random.default_rng(5)
    n, big, folds = 53, 400, 5
    x = rng.normal(size=(n + big, 2))
    y = 10 + x @ [0.6, 0.8] + rng.normal(size=n + big)
    known = np.arange(n + big) < n
    df = table(spark, known, x1=x[:, 0], x2=x[:, 1], y=y)
    r = baselines.semisupervised_mean_ci(df, ["x1", "x2"], "y", folds, "id").first()
    z, size = np.c_[np.ones(n + big), x], n // folds
    zl, zu, yl = z[:n], z[n:], y[:n]
    c = zu - zu.mean(0)
    fold = np.minimum(np.arange(n) // size, folds)
    beta = [np.linalg.lstsq(zl[fold != j], yl[fold != j], rcond=None)[0] for j in range(folds)] + [np.zeros(3)]
    fitted = np.array([zl[i] @ beta[k] for i, k in enumerate(fold)])
    along = np.array([c[i] @ beta[k] for i, k in enumerate(fold)])
    rest = np.where(fold < folds, yl - along, 0)
    estimate = np.mean([zu.mean(0) @ b for b in beta[:folds]]) + (yl - fitted).mean()
    inner = [b @ np.cov(c.T, ddof=0) @ b + 2 * (along * rest)[fold == j].mean() - 2 * estimate * along[fold == j].mean() for j, b in enumerate(beta[:folds])]
    se = math.sqrt((((rest - estimate) ** 2).mean() + n / big * np.mean(inner)) / n)
    assert np.allclose([r.estimate, r.se], [estimate, se])
    assert abs(r.estimate - 10) < 4 * r.se


def test_postprediction_recovers(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    y = x @ [1.0, -0.5] + rng.normal(size=3000)
    df = table(spark, np.arange(3000) < 1000, x1=x[:, 0], x2=x[:, 1], y=y, f=y + 0.1 * rng.normal(size=3000) + 10)
    r = baselines.postprediction_ols_ci(df, ["x1", "x2"], "y", "f", "id").orderBy("coord").collect()
    assert all(abs(c.estimate - b) < 0.1 and 0.015 < c.se < 0.035 for c, b in zip(r, (1.0, -0.5), strict=True))


def test_debiased_quantile_is_a_bootstrap_of_three(spark):
    rng = np.random.default_rng(12)
    y = rng.exponential(size=1200)
    f, known, q = y + 0.3 * rng.normal(size=1200) + 0.2, np.arange(1200) < 250, 0.7
    df = table(spark, known, y=y, f=f, one=np.ones(1200))
    got = ptd.ptd_quantile(df, q, "y", "f", n_resamples=600, tuning=None).first()
    at = lambda v: np.quantile(v, q)
    assert np.isclose(got.estimate, at(y[known]) + at(f[~known]) - at(f[known]))
    draws = []
    for _ in range(600):
        pick = rng.integers(0, 1200, 1200)
        a, u = pick[pick < 250], pick[pick >= 250]
        draws.append(at(y[a]) + at(f[u]) - at(f[a]))
    low, high = np.quantile(draws, [0.025, 0.975])
    width = high - low
    assert abs(got.lower - low) < 0.2 * width and abs(got.upper - high) < 0.2 * width
    tuned = ptd.ptd_quantile(df, q, "y", "f", n_resamples=600).first()
    assert 0 < tuned.tuning <= 1.3 and tuned.upper - tuned.lower < 1.1 * width and tuned.lower < np.quantile(y, q) < tuned.upper
    # equal weights interpolate between the middles of the rows' shares
    even = ptd.ptd_quantile(df, q, "y", "f", w="one", n_resamples=20, tuning=None).first()
    middle = lambda v: np.interp(q, (np.arange(len(v)) + 0.5) / len(v), np.sort(v))
    assert np.isclose(even.estimate, middle(y[known]) + middle(f[~known]) - middle(f[known]))


@pytest.mark.parametrize(("weighted", "whole"), [(False, False), (True, False), (False, True), (True, True)])
def test_predict_then_debias_quantile_by_row_weights(spark, monkeypatch, weighted, whole):
    """The same draws as by repeating each row in one place; also with few rows looked at first, with ties and past most_rows."""
    rng, n, q, b = np.random.default_rng(21), 900, 0.3, 40
    y = rng.exponential(size=n)
    y = np.round(y, 1) if whole else y
    f, known, w = np.round(y + 0.3 * rng.normal(size=n), 1 if whole else 9), np.arange(n) < 250, rng.integers(1, 4, n).astype(float)
    monkeypatch.setattr(ptd, "NEAR", 0.5)
    rows = [(i, float(y[i]) if known[i] else None, float(f[i]), float(w[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, y double, f double, w double").repartition(5)
    got = ptd.ptd_quantile(df, q, "y", "f", w="w" if weighted else None, n_resamples=b, key="id", seed=3, tuning=None, most_rows=100).first()
    times = resample.weights(np.arange(n), 3, np.r_[resample.WHOLE, 1 + np.arange(b)]).astype(int)

    def at(v, on, r):
        v, u = np.repeat(v[on], times[on, r]), np.repeat(w[on], times[on, r])
        if not weighted:
            return np.quantile(v, q)
        order = np.lexsort((u, v))
        share = np.cumsum(u[order])
        return np.interp(q, (share - u[order] / 2) / share[-1], v[order])

    draws = np.array([at(y, known, r) + at(f, ~known, r) - at(f, known, r) for r in range(b + 1)])
    assert np.allclose([got.estimate, got.lower, got.upper], [draws[0], *np.quantile(draws[1:], [0.025, 0.975])], rtol=1e-12)


def test_predict_then_debias_quantile_of_one_prediction(spark):
    """Predictions whose quantile is the same in all replicates have no weight, instead of an undefined one."""
    df = spark.createDataFrame([(i, float(i) if i < 40 else None, 2.0) for i in range(200)], "id long, y double, f double")
    got = ptd.ptd_quantile(df, 0.5, "y", "f", n_resamples=30, key="id").first()
    assert got.tuning == 0 and got.estimate == 19.5 and got.lower < 19.5 < got.upper


def test_label_shift_bounds_by_sums(spark):
    rng = np.random.default_rng(13)
    y = rng.integers(0, 2, 500)
    f = np.where(rng.random(500) < 0.85, y, 1 - y)
    known = np.arange(500) < 120
    df = spark.createDataFrame([(int(a) if k else None, int(b)) for a, b, k in zip(y, f, known, strict=True)], "y int, f int")
    table_of = np.array([[((f == i) & (y == j) & known).sum() for j in (0, 1)] for i in (0, 1)])
    n, matrix = table_of.sum(axis=0), table_of / table_of.sum(axis=0)
    big = int((~known).sum())
    frequency = np.array([(f[~known] == i).mean() for i in (0, 1)])
    estimate, delta = float(np.linalg.solve(matrix, frequency)[1]), 0.1
    below = lambda k, m, p: math.fsum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(k + 1))

    def solved(fn, low=0.0, high=1.0):
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if fn(mid) > 0 else (low, mid)
        return low

    wave = lambda a: math.sqrt(2 / big * math.log(2 / a))
    normal = statistics.NormalDist().inv_cdf
    share = solved(lambda s: normal(1 - s * delta / 8) / math.sqrt(n.min()) - wave((1 - s) * delta) if 0 < s < 1 else 1.0)
    errors = []
    for j in (0, 1):
        for i in (0, 1):
            k, m, tail = int(table_of[i, j]), int(n[j]), share * delta / 2 / 2
            errors += [abs(solved(lambda p: below(k, m, p) - level) - k / m) for level in (tail, 1 - tail)]  # noqa: B023
    off = max(errors) + wave((1 - share) * delta)
    got = labelshift.shifted_ci(df, "y", "f", 2, [0, 1], counts=False).first()
    assert np.allclose([got.estimate, got.lower, got.upper], [estimate, max(0, estimate - off), min(1, estimate + off)], atol=1e-6)


def test_maritz_jarrett_centre(spark):
    v = np.random.default_rng(8).normal(size=200)
    r = baselines.maritz_jarrett_ci(spark.createDataFrame([(float(a),) for a in v], "y double"), "y", 0.25).first()
    s = np.sort(v)
    assert np.isclose(r.estimate, 0.75 * s[49] + 0.25 * s[50]) and r.lower < s[45] < s[55] < r.upper


def test_ten_covariates_and_a_large_offset(spark):
    rng = np.random.default_rng(9)
    d, n = 10, 1300
    x, known = rng.normal(size=(n, d)), np.arange(n) < 300
    beta = rng.normal(size=d)
    noise, f0 = rng.normal(size=n), rng.normal(size=n)
    names = [f"x{k}" for k in range(d)]
    for offset in (0.0, 1e8):
        z = np.c_[x[:, :-1], np.ones(n)]
        y = z @ beta + noise + offset
        df = table(spark, known, **{c: z[:, k] for k, c in enumerate(names)}, y=y, f=y + f0)
        got = linear.classical_ols_ci(df, names, "y").orderBy("coord").collect()
        b = np.linalg.lstsq(z[known], (y - offset)[known], rcond=None)[0]
        e, h = (y - offset)[known] - z[known] @ b, np.linalg.inv(z[known].T @ z[known])
        se = np.sqrt(np.diag(h @ (z[known] * (e**2)[:, None]).T @ z[known] @ h))
        b[-1] += offset
        assert np.allclose([r.estimate for r in got], b, rtol=1e-8, atol=1e-6) and np.allclose([r.se for r in got], se, rtol=1e-6)
        r = linear.ols_ci(df, names, "y", "f").orderBy("coord").collect()
        assert all(a.se < 1.2 * c.se for a, c in zip(r, got, strict=True)) and all(a.se > 0 for a in r)
        by = linear.ols_ci(df.withColumn("g", F.when(F.col("id") % 2 == 0, "a")), names, "y", "f", by="g").groupBy("g").count().collect()
        assert {q.g: q["count"] for q in by} == {"a": d, None: d}


def test_streamed_means_at_an_offset(spark, tmp_path):
    rng = np.random.default_rng(10)
    y = rng.normal(size=900) + 1e8
    df = table(spark, np.arange(900) < 300, y=y, f=y + 0.7 * rng.normal(size=900))
    folder, want = str(tmp_path / "state"), mean.mean_ci(df, "y", "f").first()
    for k in range(3):  # each batch in a new session, as it were
        m = StreamingMean("y", "f", spark, folder)
        m.update(df.where(F.col("id") % 3 == k), k)
        m.update(df, k)
    assert np.allclose(m.estimate(), [want.estimate, want.se, want.lam], rtol=1e-9) and StreamingMean("y", "f", spark, folder).last == 2


def test_spreads_of_a_bootstrap_table(spark, sample):
    df, known, d = sample
    models, one = F.array(F.col("f") * 0.9, F.col("f") * 1.1), df.withColumn("one", F.lit(1.0))
    again = one.union(one)  # the same distribution, so the same spreads but for n / (n - 1)
    for fn in (lambda **k: linear.cross_ols_ci(one, ["one", "x1"], "y", "f", models, **k), lambda **k: quantile.quantile_ci(one, "y", "f", 0.5, models=models, **k), lambda **k: cross.cross_mean_ci(one, "y", "f", models, **k)):
        a, b = fn(), fn(bootstrap=again)
        order = [c for c in ("coord",) if c in a.columns]
        a, b = (t.orderBy(*order).collect() if order else t.collect() for t in (a, b))
        assert np.allclose([r.lower for r in a], [r.lower for r in b], atol=0.01) and np.allclose([r.upper for r in a], [r.upper for r in b], atol=0.01)
    logistic = one.withColumn("y", F.when(F.col("y").isNotNull(), (F.col("y") > 1).cast("double"))).withColumn("f", F.when(F.col("f") > 1, 0.9).otherwise(0.2))
    half = F.array(F.col("f"), F.col("f") * 0.8)
    a, b = (glm.cross_glm_ci(logistic, "logistic", ["one", "x1"], "y", "f", half, bootstrap=t).orderBy("coord").collect() for t in (None, logistic.union(logistic)))
    assert np.allclose([r.se for r in a], [r.se for r in b], rtol=0.01)
    wide = quantile.quantile_ci(one, "y", "f", 0.5, models=models, bootstrap=one.withColumn("y", F.col("y") * 30)).first()
    assert wide.upper - wide.lower > (lambda r: r.upper - r.lower)(quantile.quantile_ci(one, "y", "f", 0.5, models=models).first())


def test_trials_are_splits(sample):
    df, known, d = sample
    labelled = df.where("y IS NOT NULL")
    out = experiment.trial_grid(labelled, "y", "f", "id", [20, 60], 4, seed=1).toPandas()
    ids, y, f = np.arange(150), d["y"][:150], d["f"][:150]
    for k, draw in enumerate(experiment.draws(ids, 4, 1).T):
        order = np.argsort(draw)
        for n in (20, 60):
            own, rest = order[:n], order[n:]
            classical = out[(out.trial == k) & (out.n == n) & (out.method == "classical")].iloc[0]
            assert np.isclose(classical.estimate, y[own].mean()) and np.isclose(classical.width, 2 * 1.6448536269514715 * y[own].std() / math.sqrt(n))
            lam = np.clip(np.cov(y[own], f[own], ddof=0)[0, 1] / ((1 + n / len(rest)) * np.r_[f[own], f[rest]].var(ddof=1)), 0, 1)
            rectified = out[(out.trial == k) & (out.n == n) & (out.method == "rectified")].iloc[0]
            assert np.isclose(rectified.estimate, lam * f[rest].mean() + (y[own] - lam * f[own]).mean())


def test_bins_end_at_quantiles(spark):
    v = np.random.default_rng(11).integers(0, 50, 203).astype(float)
    out = experiment.quantile_bins(spark.createDataFrame([(float(a),) for a in v], "v double"), "v", 4).toPandas()
    assert (out.bin == np.digitize(out.v, np.quantile(v, [0.25, 0.5, 0.75]))).all()


@pytest.mark.parametrize("alpha", [0.1, 0.5])
def test_intervals_cover(spark, alpha):
    """Many trials at once, as groups: means, and one coefficient, cover their truth as often as they should, give or take 0.1."""
    rng, trials, rows = np.random.default_rng(12), 60, 400
    y = rng.normal(size=trials * rows)
    f = y + rng.normal(size=len(y)) - 2
    x = rng.normal(size=len(y))
    df = table(spark, np.tile(np.arange(rows) < 100, trials), y=y + 0.5 * x, f=f, x=x, trial=np.repeat(np.arange(trials), rows))
    inside = lambda t, truth: t.where(f"lower <= {truth} AND {truth} <= upper").count() / trials
    assert inside(mean.mean_ci(df.withColumn("y", F.col("y") - 0.5 * F.col("x")), "y", "f", by="trial", alpha=alpha), 0) >= 1 - alpha - 0.1
    assert inside(linear.ols_ci(df.withColumn("f", F.col("f") + 2), ["x"], "y", "f", by="trial", alpha=alpha), 0.5) >= 1 - alpha - 0.1


def test_bootstrap_covers(spark):
    rng, inside = np.random.default_rng(13), 0
    for _ in range(12):
        y = rng.normal(size=1150)
        df = table(spark, np.arange(1150) < 150, y=y, f=y + rng.normal(-0.5, 1, 1150))
        r = resample.bootstrap_ci(df, resample.MEAN, "y", "f", n_resamples=300, key="id", alpha=0.1).first()
        inside += r.lower <= 0 <= r.upper
    assert inside >= 9
