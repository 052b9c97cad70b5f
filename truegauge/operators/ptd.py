"""Predict-then-debias: bootstrap of a fit to truth, to predictions of the same rows, and to predictions of other rows.

Linear and logistic fits, and quantiles of rows with a key, are resampled by weights of rows (see resample), so rows
stay where they are; a logistic fit takes a pass for each Newton step, of all replicates at once. Other algorithms, and
quantiles without a key, need the sample in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..plans.moments import matrix
from ..plans.roles import column, listed
from .resample import MOST_ROWS, WHOLE, generator, keyed, least_squares, pair_products, replicate_sums, replicates, samples, symmetric, weights

SCHEMA = "coord int, tuning double, estimate double, lower double, upper double"
STEPS, TOLERANCE = 40, 1e-9
#: Standard errors of a replicate's quantile within which it is looked for at first, and the accuracy of its bounds.
NEAR, ACCURACY = 6.0, 100_000
#: Replicates whose quantiles are found by one task, and rows that it weighs together.
AT_ONCE, ROWS_AT_ONCE = 16, 2048


def parts_of(m: np.ndarray, k: int, weighted: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(covariates, response, weight) of the three fits, from rows of (truth.., predicted.., weight); the weight is 0 where a row isn't in a fit."""
    known, w = ~np.isnan(m[:, 0]), m[:, 2 * k] if weighted else np.ones(len(m))
    truth, predicted = np.nan_to_num(m[:, :k]), m[:, k : 2 * k]
    return [(a[:, 1:], a[:, 0], w * on) for a, on in ((truth, known), (predicted, known), (predicted, ~known))]


def linear_replicates(t: DataFrame, k: int, weighted: bool, replicate: np.ndarray, seed: int) -> np.ndarray:
    """(replicates, 3, k - 1): weighted least squares."""
    fit = least_squares(k - 1)
    sums = replicate_sums(t, seed, replicate, lambda m, w: w.T @ np.concatenate([fit.features(x, v) * own[:, None] for x, v, own in parts_of(m, k, weighted)], axis=1))
    return fit.finish(sums.reshape(len(replicate), 3, -1))


def logistic_replicates(t: DataFrame, k: int, weighted: bool, replicate: np.ndarray, seed: int) -> np.ndarray:
    """(replicates, 3, k - 1): logistic regressions of responses in [0, 1]."""
    d, t = k - 1, t.persist(StorageLevel.MEMORY_AND_DISK)
    theta = np.zeros((len(replicate), 3, d))
    for _ in range(STEPS):

        def fn(m: np.ndarray, w: np.ndarray, at=theta) -> np.ndarray:
            out = []
            for j, (x, v, own) in enumerate(parts_of(m, k, weighted)):
                mu = 1 / (1 + np.exp(-np.clip(x @ at[:, j].T, -35, 35)))
                out += [(w * own[:, None] * (mu - v[:, None])).T @ x, (w * own[:, None] * mu * (1 - mu)).T @ pair_products(x)]
            return np.concatenate(out, axis=1)

        s = replicate_sums(t, seed, replicate, fn).reshape(len(replicate), 3, -1)
        step = (np.linalg.pinv(symmetric(s[..., d:], d), hermitian=True) @ s[..., :d, None])[..., 0]
        theta = theta - np.clip(step, -4, 4)
        if np.abs(step).max() < TOLERANCE:
            break
    t.unpersist()
    return theta


def quantile_at(value: np.ndarray, weight: np.ndarray, first: np.ndarray, last: np.ndarray, below: float, total: float, at: float) -> float | None:
    """The value at a running weight, between the middles of rows, from sorted distinct values of a part with their rows'
    weights in all and the least and greatest of one; None if it may lie outside the part, nan if there are no rows."""
    if not total:
        return math.nan
    on = weight > 0
    value, weight = value[on], weight[on]
    if not len(value):
        return None
    upto = below + np.cumsum(weight)
    middle = np.stack([upto - weight + first[on] / 2, upto - last[on] / 2], axis=1).ravel()
    eps = 1e-9 * total
    if (at < middle[0] and below > eps) or (at > middle[-1] and upto[-1] < total - eps):
        return None
    return float(np.interp(at, middle, np.repeat(value, 2)))


def quantile_replicates(t: DataFrame, k: int, weighted: bool, replicate: np.ndarray, seed: int, q: float) -> np.ndarray:
    """(replicates, 3, 1): quantiles, exact ones.

    Rows near the quantile are summed by value, what is below them and all rows as sums only. Where a replicate's quantile
    isn't among these rows, more are taken; their number grows with the square root of the table's.
    """
    spark, t, n = t.sparkSession, t.persist(StorageLevel.MEMORY_AND_DISK), len(replicate)
    names = [c for c in t.columns if c != "_key"]
    sources = [("y0", "y0 IS NOT NULL"), ("c0", "y0 IS NOT NULL"), ("c0", "y0 IS NULL")]
    sizes = t.agg(*[F.count(F.when(F.expr(on), 1)) for _, on in sources]).first()
    out, todo, near = np.full((n, 3), np.nan), [j for j in range(3) if sizes[j]], NEAR

    def bounds(j: int) -> list:
        c, on = sources[j]
        wide = near * math.sqrt(max(q * (1 - q), 1 / sizes[j]) / sizes[j]) + 2 / ACCURACY
        ends = [q - wide, q + wide]
        found = F.percentile_approx(F.when(F.expr(on), F.col(c)), [min(max(x, 0.0), 1.0) for x in ends], ACCURACY)
        low, high = t.agg(found).first()[0]
        return [low if ends[0] > 0 else -math.inf, high if ends[1] < 1 else math.inf]

    while todo:
        ends = {j: bounds(j) for j in todo}

        def add(m: np.ndarray, w: np.ndarray) -> np.ndarray:
            sums = []
            for j, (_, v, own) in enumerate(parts_of(m, k, weighted)):
                low = ends[j][0] if j in ends else -math.inf
                sums += [own * (v < low), own]
            return w.T @ np.stack(sums, axis=1)

        sums = replicate_sums(t, seed, replicate, add)

        def by_value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, keys = matrix(b, names), b.column("_key").to_numpy(zero_copy_only=False)
                for at in range(0, len(rows), ROWS_AT_ONCE):
                    m = rows[at : at + ROWS_AT_ONCE]
                    times = None
                    for j, (_, v, own) in enumerate(parts_of(m, k, weighted)):
                        on = np.flatnonzero((own > 0) & (v >= ends[j][0]) & (v <= ends[j][1])) if j in ends else []
                        if not len(on):
                            continue
                        times = weights(keys[at : at + ROWS_AT_ONCE], seed, replicate) if times is None else times
                        on = on[np.argsort(v[on], kind="stable")]
                        value, start = np.unique(v[on], return_index=True)
                        w, c = own[on][:, None], times[on]
                        columns = [np.add.reduceat(w * c, start), np.minimum.reduceat(np.where(c > 0, w, np.inf), start), np.maximum.reduceat(np.where(c > 0, w, 0.0), start)]
                        for r in range(0, n, AT_ONCE):
                            some = np.concatenate([x[:, r : r + AT_ONCE] for x in (columns if weighted else columns[:1])], axis=1)
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(value), j), np.full(len(value), r), value)] + [pa.array([x.tobytes() for x in some], pa.binary())], names=["j", "r", "value", "sums"])

        def find(g: pd.DataFrame) -> pd.DataFrame:
            j, r = int(g.j.iloc[0]), int(g.r.iloc[0])
            width = min(AT_ONCE, n - r)
            value, place = np.unique(g.value.to_numpy(), return_inverse=True)
            order = np.argsort(place, kind="stable")
            start = np.searchsorted(place[order], np.arange(len(value)))
            m = np.frombuffer(b"".join(g["sums"]), dtype=float).reshape(len(g), -1)[order]
            weight = np.add.reduceat(m[:, :width], start)
            first, last = (np.minimum.reduceat(m[:, width : 2 * width], start), np.maximum.reduceat(m[:, 2 * width :], start)) if weighted else (np.ones_like(weight),) * 2
            found = []
            for i in range(width):
                below, total = sums[r + i, 2 * j : 2 * j + 2]
                at = q * total if weighted else q * (total - 1) + 0.5
                found.append(quantile_at(value, weight[:, i], first[:, i], last[:, i], below, total, at))
            return pd.DataFrame({"j": j, "r": r + np.arange(width), "found": [x is not None for x in found], "value": [math.nan if x is None else x for x in found]})

        within = [f"({on} AND {sources[j][0]} >= {lo!r}D AND {sources[j][0]} <= {hi!r}D)" for j, (lo, hi) in ends.items() for on in [sources[j][1]]]
        within = " OR ".join(x.replace("-infD", "double('-inf')").replace("infD", "double('inf')") for x in within)
        parts = t.where(within).mapInArrow(by_value, "j long, r long, value double, sums binary")
        got = parts.groupBy("j", "r").applyInPandas(find, "j long, r long, found boolean, value double").toPandas()
        ok = got[got.found]
        out[ok.r, ok.j] = ok.value
        # a part without any rows gives no groups
        todo = [j for j in todo if int((ok.j == j).sum()) < n and not (ends[j][0] == -math.inf and ends[j][1] == math.inf)]
        near *= 8
    t.unpersist()
    return out[..., None]


def ptd(df: DataFrame, algorithm: Callable | str, truth: list, predicted: list, w=None, n_resamples=2000, alpha=0.05, tuning="optimal_diagonal", seed=0, most_rows=MOST_ROWS, key=None, fit: Callable | None = None) -> DataFrame:
    """Intervals for `linear` or `logistic` coefficients, which need a key column, or those of a function of (data, weights).

    fit, which needs a key column too, makes all replicates as linear_replicates() does, and algorithm isn't used then.

    truth are columns, the first of which is null on rows without truth; predicted are their stand-ins, on all rows.
    Labelled and other rows are resampled from one pool, so how many labelled ones a replicate has varies. tuning is
    "optimal" (a full matrix), "optimal_diagonal", or None for no tuning.
    """
    if tuning not in ("optimal", "optimal_diagonal", None):
        raise ValueError("tuning must be optimal, optimal_diagonal or None")
    spark, k = df.sparkSession, len(truth)
    # only the first tells truth from prediction; elsewhere a missing truth isn't used
    filled = df.withColumns({f"_t{j}": F.coalesce(column(c).cast("double"), F.lit(0.0)) for j, c in enumerate(truth[1:], 1)})
    columns = [*[f"_t{j}" for j in range(1, k)], *predicted, *([w] if w is not None else [])]
    if fit is not None or isinstance(algorithm, str):
        t = keyed(filled, key, [truth[0]], columns)
        fit = fit or {"linear": linear_replicates, "logistic": logistic_replicates}[algorithm]
        fits = fit(t, k, w is not None, np.r_[WHOLE, 1 + np.arange(n_resamples)], seed)
        d = fits.shape[-1]
        whole, v = fits[0].ravel(), fits[1:].reshape(n_resamples, -1)
    else:
        known, other = samples(filled, columns, truth[0], most_rows)
        sent = spark.sparkContext.broadcast((known, other))

        def three(a: np.ndarray, u: np.ndarray) -> np.ndarray:
            wa, wu = (a[:, 2 * k], u[:, 2 * k]) if w is not None else (None, None)
            return np.concatenate([algorithm(a[:, :k], wa), algorithm(a[:, k : 2 * k], wa), algorithm(u[:, k : 2 * k], wu)])

        def one(b: int) -> np.ndarray:
            a, u = sent.value
            pick = generator(seed, b).integers(0, len(a) + len(u), len(a) + len(u))
            return three(a[pick[pick < len(a)]], u[pick[pick >= len(a)] - len(a)])

        whole = three(known, other)
        d = len(whole) // 3
        v = replicates(spark, n_resamples, one, 3 * d)
    cov = np.cov(v.T)
    cross, spread = cov[:d, d : 2 * d], cov[d : 2 * d, d : 2 * d] + cov[2 * d :, 2 * d :]
    tuned = np.eye(d) if tuning is None else cross @ np.linalg.inv(spread) if tuning == "optimal" else np.diag(np.divide(np.diag(cross), np.diag(spread), out=np.zeros(d), where=np.diag(spread) > 0))
    debiased = lambda c: c[..., 2 * d :] @ tuned.T + c[..., :d] - c[..., d : 2 * d] @ tuned.T
    estimate, low, high = debiased(whole), *np.quantile(debiased(v), [alpha / 2, 1 - alpha / 2], axis=0)
    return spark.createDataFrame([(j, float(tuned[j, j]), float(estimate[j]), float(low[j]), float(high[j])) for j in range(d)], SCHEMA)


def ptd_linear(df: DataFrame, x, xhat, y, yhat, w=None, **more) -> DataFrame:
    """Linear regression where covariates may be predicted too (xhat; x where they aren't)."""
    return ptd(df, "linear", [y, *listed(x)], [yhat, *listed(xhat)], w, **more)


def ptd_logistic(df: DataFrame, x, xhat, y, yhat, w=None, **more) -> DataFrame:
    """Logistic regression likewise."""
    return ptd(df, "logistic", [y, *listed(x)], [yhat, *listed(xhat)], w, **more)


def ptd_quantile(df: DataFrame, q: float, y, yhat, w=None, **more) -> DataFrame:
    """A quantile of y, weighted by interpolating the weights' running share if w is given.

    With a key column rows are resampled by Poisson weights where they are, whatever their number; without one the sample
    goes to executors, if it has at most most_rows rows.
    """

    def at(a: np.ndarray, wt: np.ndarray | None) -> np.ndarray:
        if wt is None:
            return np.quantile(a[:, :1], q, axis=0)
        order = np.argsort(a[:, 0])
        share = np.cumsum(wt[order])
        return np.array([np.interp(q, (share - wt[order] / 2) / share[-1], a[order, 0])])

    fit = partial(quantile_replicates, q=q) if more.get("key") is not None else None
    return ptd(df, at, [y], [yhat], w, fit=fit, **more)
