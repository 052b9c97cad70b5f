"""Bootstrap intervals.

What can be had from sums over rows (means, correlations, linear and logistic fits) is resampled where the rows are:
in replicate b the row of key k weighs a Poisson(1) number that a random cubic polynomial of k draws, so weights of
any four rows are independent, nothing is sent around, and a task returns sums for each replicate, whatever the size.
Replicates' sizes vary as Poisson counts do. Any other estimator needs the sample in one place: it goes to executors,
which is refused above `most_rows`, and replicate b draws from Philox keyed by (seed, b). Either way results don't
depend on how rows or replicates are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import check_alternative
from ..plans.moments import matrix
from ..plans.roles import checked, column, listed

#: Rows of a sample that may go to all executors.
MOST_ROWS = 2_000_000
SCHEMA = "coord int, lam double, estimate double, lower double, upper double"
#: A Mersenne prime: products of two numbers below it fit a long.
PRIME = (1 << 31) - 1
#: A hash of as many of PRIME or more weighs one more each: the distribution function of Poisson(1).
LIMITS = tuple(int(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))) for k in range(12))
#: The replicate in which all rows weigh 1, and the first of those that tune the weight of predictions.
WHOLE, TUNING = 0, 1 << 20
#: Rows that are weighed together.
TOGETHER = 2048


class MomentEstimator(NamedTuple):
    """features(x, values): a matrix with a row for each row; finish(sums of its columns, in the last axis): estimates, in the last axis."""

    features: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], np.ndarray]


def _correlation(s: np.ndarray) -> np.ndarray:
    n, a, b, aa, bb, ab = np.moveaxis(s, -1, 0)
    return ((n * ab - a * b) / np.sqrt((n * aa - a * a) * (n * bb - b * b)))[..., None]


def pair_products(x: np.ndarray) -> np.ndarray:
    """The products of all pairs of columns, the lower triangle by rows."""
    i, j = np.tril_indices(x.shape[1])
    return x[:, i] * x[:, j]


def symmetric(v: np.ndarray, d: int) -> np.ndarray:
    """The matrices whose lower triangles stand in the last axis."""
    i, j = np.tril_indices(d)
    out = np.zeros((*v.shape[:-1], d, d))
    out[..., i, j] = out[..., j, i] = v
    return out


def least_squares(d: int) -> MomentEstimator:
    """Coefficients of d covariates."""
    half = d * (d + 1) // 2
    return MomentEstimator(lambda x, v: np.concatenate([pair_products(x), x * v[:, None]], axis=1), lambda s: np.linalg.solve(symmetric(s[..., :half], d), s[..., half:, None])[..., 0])


MEAN = MomentEstimator(lambda x, v: np.stack([np.ones(len(v)), v], axis=1), lambda s: s[..., 1:] / s[..., :1])
#: Of one covariate with the values.
CORRELATION = MomentEstimator(lambda x, v: np.stack([np.ones(len(v)), x[:, 0], v, x[:, 0] ** 2, v**2, x[:, 0] * v], axis=1), _correlation)


def coefficients(seed: int, replicate: np.ndarray) -> np.ndarray:
    """(4, replicates): the polynomials' coefficients, by three rounds of a quadratic map."""
    x = (seed * 7919 + 4 * np.asarray(replicate, dtype=np.int64) + np.arange(1, 5, dtype=np.int64)[:, None]) % PRIME
    for _ in range(3):
        x = (x * x % PRIME * 48271 + 12345) % PRIME
    return x


def hashes(key: np.ndarray, seed: int, replicate: np.ndarray) -> np.ndarray:
    """(keys, replicates): the polynomials at keys."""
    k, (h, *rest) = np.mod(key.astype(np.int64), PRIME)[:, None], coefficients(seed, replicate)
    for c in rest:
        h = (h * k + c) % PRIME
    return h


def weights(key: np.ndarray, seed: int, replicate: np.ndarray) -> np.ndarray:
    out = np.searchsorted(np.array(LIMITS), hashes(key, seed, replicate), side="right").astype(float)
    out[:, np.asarray(replicate) == WHOLE] = 1.0
    return out


def keyed(df: DataFrame, key, y: list, columns: list) -> DataFrame:
    """The columns y0.. and c0.. of checked() and _key, an integer that tells rows apart."""
    if key is None:
        raise ValueError("a key column is needed to draw the weights of rows")
    return checked(df, y, columns, [column(key).cast("long").alias("_key")])


def replicate_sums(t: DataFrame, seed: int, replicate: np.ndarray, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """(replicates, width): the sums of fn(rows, weights) over all of keyed(); fn takes a matrix of the columns and (rows, replicates) of weights."""
    replicate, rest = np.asarray(replicate, dtype=np.int64), [c for c in t.columns if c != "_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            m, key = matrix(b, rest), b.column("_key").to_numpy(zero_copy_only=False)
            for at in range(0, len(m), TOGETHER):
                part = fn(m[at : at + TOGETHER], weights(key[at : at + TOGETHER], seed, replicate))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(replicate))), pa.array(list(total), pa.list_(pa.float64()))], names=["r", "v"])

    each = t.mapInArrow(run, "r long, v array<double>").select("r", F.posexplode("v").alias("k", "v"))
    rows = each.groupBy("r", "k").agg(F.sum("v").alias("v")).toPandas()  # replicates times the width, whatever the table
    if not len(rows):
        raise ValueError("no rows to resample")
    out = np.zeros((len(replicate), int(rows.k.max()) + 1))
    out[rows.r, rows.k] = rows.v
    return out


def generator(seed: int, replicate: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array([seed, replicate], dtype=np.uint64)))


def samples(df: DataFrame, columns: list, y, most_rows: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Rows with and without y as matrices of (y, columns); in the order of their values, so that partitions don't matter."""
    t = checked(df, [y], columns, [])
    rows = t.limit(most_rows + 1).toPandas().to_numpy(dtype=float)
    if len(rows) > most_rows:
        raise ValueError(f"resampling needs the sample in one place, and it has more than {most_rows} rows")
    rows = rows[np.lexsort(np.nan_to_num(rows).T[::-1])]
    known = ~np.isnan(rows[:, 0])
    return rows[known], rows[~known]


def replicates(spark: SparkSession, n: int, fn: Callable[[int], np.ndarray], width: int) -> np.ndarray:
    """(n, width): fn(b) for b in 0 .. n - 1, computed by the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield pd.DataFrame({"b": g.id, "v": [np.asarray(fn(int(b)), dtype=float).tobytes() for b in g.id]})

    parts = min(n, 4 * spark.sparkContext.defaultParallelism)
    rows = spark.range(0, n, 1, parts).mapInPandas(run, "b long, v binary").toPandas().sort_values("b")
    return np.stack([np.frombuffer(v, dtype=float) for v in rows.v]).reshape(n, width)


def interval_of(values: np.ndarray, estimate: np.ndarray, alpha: float, alternative: str, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Percentile or basic bounds by coordinate; one-sided ones end at infinity on the side of z-intervals."""
    if method not in ("percentile", "basic"):
        raise ValueError("method must be percentile or basic")
    tail = alpha / 2 if check_alternative(alternative) == "two-sided" else alpha
    low, high = np.quantile(values, tail, axis=0), np.quantile(values, 1 - tail, axis=0)
    if method == "basic":
        low, high = 2 * estimate - high, 2 * estimate - low
    return (np.full_like(low, -math.inf) if alternative == "smaller" else low), (np.full_like(high, math.inf) if alternative == "larger" else high)


def _moment_replicates(t: DataFrame, estimator: MomentEstimator, replicate: np.ndarray, seed: int) -> np.ndarray:
    """(replicates, 3, d): estimates from labels, from predictions of the same rows, and from those of other rows; columns are y0, c0 (yhat) and covariates."""

    def fn(m: np.ndarray, w: np.ndarray) -> np.ndarray:
        known, x = ~np.isnan(m[:, :1]), m[:, 2:]
        f = estimator.features(x, m[:, 1])
        return w.T @ np.concatenate([np.where(known, estimator.features(x, m[:, 0]), 0.0), f * known, f * ~known], axis=1)

    s = replicate_sums(t, seed, replicate, fn)
    return estimator.finish(s.reshape(len(replicate), 3, -1))


def bootstrap_ci(df: DataFrame, estimator: Callable | MomentEstimator, y, yhat, x=(), lam=None, n_resamples=1000, n_resamples_lam=50, alpha=0.1, alternative="two-sided", method="percentile", seed=0, most_rows=MOST_ROWS, key=None) -> DataFrame:
    """Rectified bootstrap: lam estimator(yhat unlabelled) + estimator(y) - lam estimator(yhat labelled).

    The estimator is a MomentEstimator, which needs a key column, or a function of (x, values), or of (values) where
    there are no covariates, that gives a number or a vector. lam, if None, is the covariance of the labelled
    estimates over the sum of the predicted ones' variances, not clipped.
    """
    x, spark = listed(x), df.sparkSession
    many = n_resamples_lam if lam is None else 0
    if isinstance(estimator, MomentEstimator):
        ids = np.r_[WHOLE, 1 + np.arange(n_resamples), TUNING + np.arange(many)]
        v = _moment_replicates(keyed(df, key, [y], [yhat, *x]), estimator, ids, seed)
        d = v.shape[-1]
        whole, values, some = v[0].ravel(), v[1 : 1 + n_resamples].reshape(n_resamples, -1), v[1 + n_resamples :]
    else:
        known, other = samples(df, [yhat, *x], y, most_rows)
        sent = spark.sparkContext.broadcast((known, other))
        fit = (lambda a, k: estimator(a[:, 2:], a[:, k])) if x else (lambda a, k: estimator(a[:, k]))
        three = lambda a, u: np.concatenate([np.atleast_1d(fit(a, 0)), np.atleast_1d(fit(a, 1)), np.atleast_1d(fit(u, 1))])
        whole = three(known, other)
        d = len(whole) // 3

        def one(b: int) -> np.ndarray:
            rng, (a, u) = generator(seed, b), sent.value
            return three(a[rng.integers(0, len(a), len(a))], u[rng.integers(0, len(u), len(u))])

        some = replicates(spark, many, lambda b: one(2**32 + b), 3 * d).reshape(-1, 3, d) if many else None
        values = replicates(spark, n_resamples, one, 3 * d)
    if lam is None:
        cross = sum(np.cov(some[:, 0, k], some[:, 1, k])[0, 1] for k in range(d))
        lam = float(cross / (some[:, 1].var(axis=0) + some[:, 2].var(axis=0)).sum())
    rectified = lambda v: lam * v[..., 2 * d :] + v[..., :d] - lam * v[..., d : 2 * d]
    values, estimate = rectified(values), rectified(whole)
    low, high = interval_of(values, estimate, alpha, alternative, method)
    return spark.createDataFrame([(k, float(lam), float(estimate[k]), float(low[k]), float(high[k])) for k in range(d)], SCHEMA)


def classical_bootstrap_ci(df: DataFrame, estimator: Callable | MomentEstimator, y, x=(), n_resamples=1000, alpha=0.1, alternative="two-sided", method="percentile", seed=0, most_rows=MOST_ROWS, key=None) -> DataFrame:
    """Bootstrap of the labelled rows alone."""
    x, spark = listed(x), df.sparkSession
    if isinstance(estimator, MomentEstimator):
        t = keyed(df.where(column(y).isNotNull()), key, [], [y, *x])
        v = estimator.finish(replicate_sums(t, seed, np.arange(n_resamples + 1), lambda m, w: w.T @ estimator.features(m[:, 1:], m[:, 0])))
        estimate, values = v[0], v[1:]
    else:
        known, _ = samples(df, [F.lit(0.0), *x], y, most_rows)
        sent = spark.sparkContext.broadcast(known)
        fit = (lambda a: np.atleast_1d(estimator(a[:, 2:], a[:, 0]))) if x else (lambda a: np.atleast_1d(estimator(a[:, 0])))
        estimate = fit(known)

        def one(b: int) -> np.ndarray:
            return fit(sent.value[generator(seed, b).integers(0, len(sent.value), len(sent.value))])

        values = replicates(spark, n_resamples, one, len(estimate))
    low, high = interval_of(values, estimate, alpha, alternative, method)
    return spark.createDataFrame([(k, 0.0, float(v), float(low[k]), float(high[k])) for k, v in enumerate(estimate)], SCHEMA)


def poisson_mean_ci(df: DataFrame, y, yhat, key, lam=1.0, n_resamples=200, alpha=0.1, seed=0) -> DataFrame:
    """The rectified mean at a given weight, as the mean of its replicates, with percentile bounds."""
    v = _moment_replicates(keyed(df, key, [y], [yhat]), MEAN, 1 + np.arange(n_resamples), seed)[..., 0]
    values = lam * v[:, 2] + v[:, 0] - lam * v[:, 1]
    return df.sparkSession.createDataFrame([(float(values.mean()), *map(float, np.quantile(values, [alpha / 2, 1 - alpha / 2])))], "estimate double, lower double, upper double")


def paired_bootstrap(df: DataFrame, statistic: Callable, columns: list[str], groups: list[list[str]], n_resamples=1000, seed=0, most_rows=MOST_ROWS) -> np.ndarray:
    """(n_resamples, d): statistic(columns by name) on resampled columns. Columns of a group are resampled together, each other column alone.

    Columns may be of different length: nulls are left out, and a group's columns must have theirs in the same rows.
    """
    t = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).limit(most_rows + 1).toPandas()
    if len(t) > most_rows:
        raise ValueError(f"resampling needs the sample in one place, and it has more than {most_rows} rows")
    t = t.sort_values(columns).reset_index(drop=True)  # so that partitions don't matter
    data = {c: t[c].dropna().to_numpy() for c in columns}
    together = [list(g) for g in groups] + [[c] for c in columns if not any(c in g for g in groups)]
    for g in together:
        if len({tuple(np.flatnonzero(t[c].notna())) for c in g}) > 1:
            raise ValueError(f"columns resampled together must have values in the same rows: {g}")
    sent = df.sparkSession.sparkContext.broadcast(data)

    def one(b: int) -> np.ndarray:
        rng, out = generator(seed, b), {}
        for g in together:
            n = len(sent.value[g[0]])
            pick = rng.integers(0, n, n)
            out |= {c: sent.value[c][pick] for c in g}
        return np.atleast_1d(statistic(out))

    return replicates(df.sparkSession, n_resamples, one, len(np.atleast_1d(statistic(data))))


def solved(x: np.ndarray, v: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Least squares, weighted if w is given."""
    root = 1.0 if w is None else np.sqrt(w)[:, None]
    return np.linalg.lstsq(x * root, v * (1.0 if w is None else np.sqrt(w)), rcond=None)[0]


def logit(x: np.ndarray, v: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression of responses in [0, 1], by Newton steps."""
    w, at = np.ones(len(v)) if w is None else w, np.zeros(x.shape[1])
    for _ in range(50):
        mu = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        step = np.linalg.lstsq((x * (w * mu * (1 - mu))[:, None]).T @ x, x.T @ (w * (mu - v)), rcond=None)[0]
        at = at - step
        if np.abs(step).max() < 1e-10:
            break
    return at
