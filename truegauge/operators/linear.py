"""Rectified, cross-fit and classical linear regression, for any number of covariates.

The coefficients are linear in the weight of predictions, a + lam b, so a first pass sums the Gram matrices that give
a and b, and a second one moments of gradients: with p = x a - y, r = x a - f and q = x b, whatever lam is, residuals
are p + lam q and r + lam q. They are taken row by row, so a large common offset of y cancels before it is squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.moments import joined, vector_sums
from ..plans.roles import by_names, checked, column, finished, listed
from .rectify import SCHEMA, Spread, coefficient_rows, correlation, inverse, power_weight, standard_errors

#: Of a group: rows, sums of weights, a and b, and the Gram matrices of x.
FIT = "n long, n_unlabeled long, w_l double, w_u double, a array<double>, b array<double>, gram_l array<double>, gram_u array<double>"
#: Products of residuals whose moments are summed, of labelled and of unlabelled rows.
KNOWN, OTHER = ("pp", "pr", "rr", "pq", "rq", "qq"), ("rr", "rq", "qq")


def gram_sums(d: int):
    """Rows are (y, x.., f, w): by role the count, the sum of w, x'wx, x'wf, and for labelled rows x'wy."""

    def fn(m: np.ndarray) -> np.ndarray:
        known, out = ~np.isnan(m[:, 0]), []
        for on in (known, ~known):
            y, x, f, w = m[on, 0], m[on, 1 : d + 1], m[on, d + 1], m[on, d + 2]
            xw = (x * w[:, None]).T
            out += [[on.sum(), w.sum()], (xw @ x).ravel(), xw @ f, xw @ np.nan_to_num(y)]
        return np.concatenate(out)

    return fn


def coefficients(d: int):
    """The row of FIT that the sums of gram_sums() give; none without labelled rows."""

    def rows(r: dict) -> list[tuple]:
        half = np.asarray(r["v"], dtype=float).reshape(2, -1)
        (n, wl), (big, wu) = half[:, :2]
        if not n:
            return []
        gram, xf, xy = half[:, 2 : 2 + d * d].reshape(2, d, d), half[:, 2 + d * d : 2 + d * d + d], half[0, 2 + d * d + d :]
        h = inverse(gram[0])
        b = inverse(gram[1]) @ xf[1] - h @ xf[0] if big else np.zeros(d)
        return [(int(n), int(big), float(wl), float(wu), list(map(float, h @ xy)), list(map(float, b)), *(list(map(float, g.ravel())) for g in gram))]

    return rows


def residual_sums(d: int):
    """Rows are (known, x.., w, p, r, q): by role the count, sums of w, of w x times each residual, and of w^2 x x' times their products."""

    def fn(m: np.ndarray) -> np.ndarray:
        known, out = m[:, 0] > 0, []
        for on, products in ((known, KNOWN), (~known, OTHER)):
            x, w = m[on, 1 : d + 1], m[on, d + 1]
            e = dict(zip("prq", m[on, d + 2 :].T, strict=True))
            xw = x * w[:, None]
            out += [[on.sum(), w.sum()], *(xw.T @ np.nan_to_num(e[k]) for k in "prq"), *((xw * np.nan_to_num(e[k[0]] * e[k[1]])[:, None]).T @ xw for k in products)]
        return np.concatenate([np.ravel(v) for v in out])

    return fn


class Fit:
    """A group's row: FIT, and v, the sums of residual_sums(); weights have mean 1 in each role."""

    def __init__(self, r: dict, d: int):
        self.d, self.n, self.big = d, r["n"], r["n_unlabeled"]
        self.a, self.b = (np.asarray(r[k], dtype=float) for k in "ab")
        gram = {k: np.asarray(r[f"gram_{k}"], dtype=float).reshape(d, d) for k in "lu"}
        self.gram = {"l": gram["l"] * self.n / r["w_l"], "u": gram["u"] * (self.big / r["w_u"] if self.big else 0.0)}
        v, self.mean, self.second = np.asarray(r["v"], dtype=float), {}, {}
        for role, products in (("l", KNOWN), ("u", OTHER)):
            rows, weight = v[:2]
            size = 2 + 3 * d + len(products) * d * d
            of, v = v[2:size], v[size:]
            scale = 1 / weight if weight else 0.0  # weights over their mean, and the mean over rows
            for k in range(3):
                self.mean[role + "prq"[k]] = of[k * d : (k + 1) * d] * scale
            for k, name in enumerate(products):
                self.second[role + name] = of[3 * d + k * d * d : 3 * d + (k + 1) * d * d].reshape(d, d) * scale * scale * rows

    def theta(self, lam: float) -> np.ndarray:
        return self.a + lam * self.b

    def at(self, role: str, one: str, other: str, lam: float) -> np.ndarray:
        """The second moment of gradients w x e and w x e', e and e' being p or r at lam."""
        s = lambda k: self.second[role + (k if role + k in self.second else k[::-1])]
        return s(one + other) + lam * (s(one + "q") + s(other + "q")) + lam * lam * s("qq")

    def first(self, role: str, one: str, lam: float) -> np.ndarray:
        return self.mean[role + one] + lam * self.mean[role + "q"]

    def covariance(self, role: str, one: str, other: str, lam: float) -> np.ndarray:
        return self.at(role, one, other, lam) - np.outer(self.first(role, one, lam), self.first(role, other, lam))

    def spread(self, lam: float, unlabelled: bool = True) -> Spread:
        both = unlabelled and self.big
        none = np.zeros((self.d, self.d))
        hessian = (self.gram["l"] + self.gram["u"]) / (self.n + self.big) if both else self.gram["l"] / self.n
        covs = [self.covariance("l", *k, lam) for k in ("pp", "pr", "rr")] + [self.covariance("u", "r", "r", lam) if both else none]
        return Spread(self.n, self.big, *covs, self.first("l", "r", lam), self.first("u", "r", lam) if both else np.zeros(self.d), hessian)

    def tuned(self, coord: int | None, times: int) -> float:
        """The weight, tuned at the estimate of weight 1, and again at what that gives."""
        lam = 1.0
        for _ in range(times):
            lam = power_weight(self.spread(lam), coord, clip=True) if self.big else 0.0
        return lam


def _fitted(df: DataFrame, x, y, yhat, w, by, other: DataFrame | None = None) -> tuple[DataFrame, list[str], int]:
    """Rows of FIT and v by group; the moments v are of `other`, if given, at the coefficients of df."""
    x, d = listed(x), len(listed(x))

    def rows(t: DataFrame) -> tuple[DataFrame, list[str]]:
        t, names = by_names(t, by)
        out = checked(t, [y], [*x, yhat, *([w] if w is not None else [])], names)
        return out if w is not None else out.withColumn(f"c{d + 1}", F.lit(1.0)), names

    t, names = rows(df)
    fit = finished(vector_sums(t, names, gram_sums(d)), names, FIT, coefficients(d))
    both = joined(t if other is None else rows(other)[0], fit, names)
    dot = lambda v: sum((F.col(f"c{k}") * F.col(v)[k] for k in range(d)), F.lit(0.0))
    residuals = both.select(*names, F.when(F.col("y0").isNotNull(), 1.0).otherwise(0.0).alias("known"), *[f"c{k}" for k in range(d)], F.col(f"c{d + 1}"), (dot("a") - F.col("y0")).alias("p"), (dot("a") - F.col(f"c{d}")).alias("r"), dot("b").alias("q"))
    return joined(vector_sums(residuals, names, residual_sums(d)), fit, names), names, d


def ols_ci(df: DataFrame, x, y, yhat, by=(), alpha=0.1, alternative="two-sided", lam=None, coord=None, w=None) -> DataFrame:
    """Rectified coefficients with sandwich errors, bounds and p-values. No intercept is added; coord counts from 0.

    A lam of None is tuned at the estimate of lam 1, and again at the estimate that this gives.
    """

    def rows(r: dict) -> list[tuple]:
        f = Fit(r, d)
        use = f.tuned(coord, 2) if lam is None else lam
        return coefficient_rows(f.theta(use), standard_errors(f.spread(use, bool(use)), use), f.n, f.big, use, alpha, alternative)

    fits, names, d = _fitted(df, x, y, yhat, w, by)
    return finished(fits, names, SCHEMA, rows)


def ols_estimate(df: DataFrame, x, y, yhat, by=(), lam=None, coord=None, w=None) -> DataFrame:
    """Rectified coefficients."""

    def rows(r: dict) -> list[tuple]:
        f = Fit(r, d)
        use = f.tuned(coord, 1) if lam is None else lam
        return [(k, f.n, f.big, float(use), float(v)) for k, v in enumerate(f.theta(use))]

    fits, names, d = _fitted(df, x, y, yhat, w, by)
    return finished(fits, names, "coord int, n long, n_unlabeled long, lam double, estimate double", rows)


def classical_ols_ci(df: DataFrame, x, y, by=(), alpha=0.1, alternative="two-sided", w=None) -> DataFrame:
    """Least squares on the labelled rows, weighted if w is given, with errors that allow for heteroscedasticity (HC0)."""

    def rows(r: dict) -> list[tuple]:
        f = Fit(r, d)
        h = inverse(f.gram["l"] / f.n)
        se = np.sqrt(np.maximum(np.diag(h @ f.at("l", "p", "p", 0.0) @ h), 0) / f.n)
        return coefficient_rows(f.a, se, f.n, 0, 0.0, alpha, alternative)

    fits, names, d = _fitted(df.where(column(y).isNotNull()), x, y, y, w, by)
    return finished(fits, names, SCHEMA, rows)


def mean_of(models) -> F.Column:
    """The mean of an array column of predictions."""
    a = column(models).cast("array<double>")
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def cross_ols_ci(df: DataFrame, x, y, yhat, models, by=(), alpha=0.1, alternative="two-sided", bootstrap: DataFrame | None = None) -> DataFrame:
    """Cross-fit coefficients: weight 1, and on unlabelled rows the mean of `models`, an array column of predictions.

    The rectifier's gradients are x (yhat - y), and the curvature is that of all rows. The spreads of gradients come
    from `bootstrap`, a table of the same columns, if given.
    """

    def rows(r: dict) -> list[tuple]:
        f = Fit(r, d)
        h, apart = inverse(f.spread(1.0).hessian), f.mean["lp"] - f.mean["lr"]
        rect = f.second["lpp"] - 2 * f.second["lpr"] + f.second["lrr"] - np.outer(apart, apart)
        n, big = int(r["v"][0]), int(r["v"][2 + 3 * d + len(KNOWN) * d * d])
        sigma = h @ (f.n / f.big * f.covariance("u", "r", "r", 1.0) * big / (big - 1) + rect * n / (n - 1)) @ h
        return coefficient_rows(f.theta(1.0), np.sqrt(np.diag(sigma) / f.n), f.n, f.big, 1.0, alpha, alternative)

    predicted = lambda t: t.withColumn("_f", F.when(column(y).isNotNull(), column(yhat).cast("double")).otherwise(mean_of(models)))
    fits, names, d = _fitted(predicted(df), x, y, "_f", None, by, None if bootstrap is None else predicted(bootstrap))
    return finished(fits, names, SCHEMA, rows)


def ols_correlation(df: DataFrame, x, y, yhat, coord=None, w=None) -> float:
    """The correlation of labelled and predicted gradients, for planning."""
    fits, _, d = _fitted(df.where(column(y).isNotNull()), x, y, yhat, w, ())
    f = Fit(fits.first().asDict(), d)
    s = f.spread(0.0, False)
    return correlation(s.g, s.cross, s.ghat, s.hessian, f.n, coord)
