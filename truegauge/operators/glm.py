"""Rectified and classical logistic and Poisson regression: Newton steps, each one aggregation of all rows.

The rectified loss is lam * (unlabelled loss at yhat) + labelled loss at y - lam * (labelled loss at yhat). Its
gradient needs the responses only through sums taken once; a step needs the sums of w x mu and of w v x x' by role,
with mu and v of the current coefficients. A step that raises the loss is halved. The sums don't depend on lam, so a
fit that starts where gradients' spreads were taken, in the same pass, needs no pass of its own for its first step.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement as pairs_of
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..functions.normal import expit, log1pexp
from ..plans.roles import checked, column, listed
from .linear import mean_of
from .rectify import SCHEMA, Spread, coefficient_rows, correlation, inverse, power_weight, standard_errors

STEPS = 60
#: A step this small leaves an error of its square; a fit at which only the weight is tuned may stop earlier.
TOLERANCE, ROUGH = 1e-6, 1e-4
#: Nor does it take a pass of its own to check, if the mean square move of linear predictors, weighted by variance, is below this, whatever the covariates' scale.
SURE = 1e-6


class Family(NamedTuple):
    """Of a linear predictor: mean, variance, and the part of the negative log likelihood that isn't - y * eta."""

    mean: object
    variance: object
    potential: object


FAMILIES = {
    "logistic": Family(expit, lambda eta: expit(eta) * (1 - expit(eta)), log1pexp),
    "poisson": Family(F.exp, F.exp, F.exp),
}


class Problem:
    """Rows as columns y0, c0.., w in one persisted table; sums over it reach the driver, d * d of them at most."""

    def __init__(self, df: DataFrame, x, y, yhat, w, family: str):
        x = listed(x)
        self.d, self.family = len(x), FAMILIES[family]
        t = checked(df, [y], [*x, yhat, *([w] if w is not None else [])], [])
        self.rows = t.persist(StorageLevel.MEMORY_AND_DISK)
        self.x = [F.col(f"c{k}") for k in range(self.d)]
        self.f, self.y = F.col(f"c{self.d}"), F.col("y0")
        self.last: tuple | None = None
        weight = F.col(f"c{self.d + 1}") if w is not None else F.lit(1.0)
        known = self.y.isNotNull()
        on = {"l": F.when(known, weight), "u": F.when(~known, weight)}
        sums = [F.coalesce(F.sum(on[role] * v * c), F.lit(0.0)) for role, v in (("l", self.y), ("l", self.f), ("u", self.f)) for c in self.x]
        sizes = [F.count("y0"), F.count(F.when(~known, 1)), F.sum(on["l"]), F.sum(on["u"])]
        self.n, self.big, wl, wu, *r = self.rows.agg(*[c.alias(f"s{k}") for k, c in enumerate([*sizes, *sums])]).first()
        # weights with mean 1 in each role
        scale = {"l": self.n / wl if self.n else 0.0, "u": self.big / wu if self.big else 0.0}
        self.on = {role: c * scale[role] for role, c in on.items()}
        self.xy, self.xf, self.xu = np.array(r, dtype=float).reshape(3, self.d) * np.array([[scale["l"]], [scale["l"]], [scale["u"]]])

    def __enter__(self) -> Problem:
        return self

    def __exit__(self, *_) -> None:
        self.rows.unpersist()

    def at(self, theta: np.ndarray) -> DataFrame:
        """The rows with _eta, _mu and _v. The coefficients are a row, not constants, so that all steps share one compiled plan."""
        row = self.rows.sparkSession.range(1).select(*[F.lit(float(t)).alias(f"t{k}") for k, t in enumerate(theta)])
        eta = sum((c * F.col(f"t{k}") for k, c in enumerate(self.x)), F.lit(0.0))
        t = self.rows.crossJoin(F.broadcast(row)).withColumn("_eta", eta)  # one row
        return t.withColumn("_mu", self.family.mean(F.col("_eta"))).withColumn("_v", self.family.variance(F.col("_eta"))).withColumn("_b", self.family.potential(F.col("_eta")))

    def first_sums(self) -> list[Column]:
        """By role: the sums of w * potential and of w x mu."""
        return [F.sum(on * c) for on in self.on.values() for c in (F.col("_b"), *[F.col("_mu") * c for c in self.x])]

    def sums_of(self, first: np.ndarray, curvature: list[np.ndarray]) -> tuple[dict, dict, dict]:
        """By role: the sums of w * potential, of w x mu, and of w v x x'."""
        b, m = first.reshape(2, -1)[:, 0], first.reshape(2, -1)[:, 1:]
        return dict(zip("lu", b, strict=True)), dict(zip("lu", m, strict=True)), dict(zip("lu", curvature, strict=True))

    def totals(self, theta: np.ndarray, sums: list[Column]) -> np.ndarray:
        r = self.at(theta).agg(*[c.alias(f"s{k}") for k, c in enumerate(sums)]).first()
        return np.array([0.0 if v is None else v for v in r])

    def step_sums(self, theta: np.ndarray) -> tuple[dict, dict, dict]:
        if self.last is None or not np.array_equal(self.last[0], theta):
            first = self.first_sums()
            r = self.totals(theta, first + [F.sum(on * F.col("_v") * a * b) for on in self.on.values() for a, b in pairs_of(self.x, 2)])
            upper, curvature = np.triu_indices(self.d), []
            for row in r[len(first) :].reshape(2, -1):
                h = np.zeros((self.d, self.d))
                h[upper] = row
                curvature.append(h + np.triu(h, 1).T)
            self.last = theta, self.sums_of(r[: len(first)], curvature)
        return self.last[1]

    def fit(self, lam: float, start: np.ndarray | None = None, tolerance: float = TOLERANCE) -> tuple[np.ndarray, bool]:
        """The minimiser at lam, and whether the steps converged."""
        at = np.zeros(self.d) if start is None else start
        use = lam if self.big else 0.0
        fixed = (self.xy - use * self.xf) / self.n + (use * self.xu / self.big if use else 0.0)

        def told(theta: np.ndarray):
            b, m, h = self.step_sums(theta)
            mix = lambda s: (1 - use) * s["l"] / self.n + (use * s["u"] / self.big if use else 0.0)
            return mix(b) - float(fixed @ theta), mix(m) - fixed, mix(h)

        loss, grad, hess = told(at)
        for _ in range(STEPS):
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            if np.abs(step).max() <= tolerance * (1 + np.abs(at).max()) and abs(float(grad @ step)) <= SURE:
                return at - step, True
            size = 1.0
            while True:
                new = at - size * step
                got = told(new)
                if math.isfinite(got[0]) and got[0] <= loss + 1e-12 * (1 + abs(loss)) or size < 1e-4:
                    break
                size /= 2
            moved = np.abs(size * step).max()
            at, (loss, grad, hess) = new, got
            if moved <= tolerance * (1 + np.abs(at).max()) or np.abs(grad).max() < 1e-13:
                return at, True
        return at, False

    def spread(self, theta: np.ndarray, unlabelled: bool = True, rectifier_alone: bool = False) -> Spread:
        """Gradient moments and curvature at theta, in one pass; rectifier_alone: g is then x (yhat - y)."""
        g = [self.on["l"] * c * (self.f - self.y if rectifier_alone else F.col("_mu") - self.y) for c in self.x]
        ghat = [self.on["l"] * c * (F.col("_mu") - self.f) for c in self.x]
        ghat_u = [self.on["u"] * c * (F.col("_mu") - self.f) for c in self.x]
        d, out = range(self.d), []
        for p, q in ((g, g), (g, ghat), (ghat, ghat), (ghat_u, ghat_u)):
            out += [F.covar_pop(p[i], q[j]) for i in d for j in d]
        out += [F.sum(on * F.col("_v") * p * q) for on in self.on.values() for p in self.x for q in self.x]
        out += [F.avg(c) for c in (*ghat, *ghat_u)]
        r = self.totals(theta, out + self.first_sums())
        *m, known, other = r[: 6 * self.d**2].reshape(6, self.d, self.d)
        means = r[6 * self.d**2 : len(out)].reshape(2, self.d)
        self.last = theta, self.sums_of(r[len(out) :], [known, other])
        both = unlabelled and self.big
        hessian = (known + other) / (self.n + self.big) if both else known / self.n
        return Spread(self.n, self.big if both else 0, *m, *means, hessian)

    def frame(self, spark, rows: list[tuple], schema: str, converged: bool) -> DataFrame:
        return spark.createDataFrame([(*r, bool(converged)) for r in rows], f"{schema}, converged boolean")


def glm_estimate(df: DataFrame, family: str, x, y, yhat, lam=None, coord=None, w=None) -> DataFrame:
    """Rectified coefficients of a logistic or Poisson regression. No intercept is added."""
    with Problem(df, x, y, yhat, w, family) as p:
        theta, ok = p.fit(1.0, tolerance=ROUGH) if lam is None else p.fit(lam)
        if lam is None:
            lam = power_weight(p.spread(theta), coord, clip=True)
            theta, ok = p.fit(lam, theta)
        return p.frame(df.sparkSession, [(k, p.n, p.big, float(lam), float(t)) for k, t in enumerate(theta)], "coord int, n long, n_unlabeled long, lam double, estimate double", ok)


def glm_ci(df: DataFrame, family: str, x, y, yhat, alpha=0.1, alternative="two-sided", lam=None, coord=None, w=None) -> DataFrame:
    """Rectified coefficients with sandwich errors, bounds and p-values against 0; a lam of None is tuned twice, as for linear regression."""
    with Problem(df, x, y, yhat, w, family) as p:
        theta, ok = p.fit(1.0, tolerance=ROUGH) if lam is None else p.fit(lam)
        if lam is None:
            for tolerance in (ROUGH, TOLERANCE):
                lam = power_weight(p.spread(theta), coord, clip=True)
                theta, ok = p.fit(lam, theta, tolerance)
        se = standard_errors(p.spread(theta, bool(lam)), lam)
        return p.frame(df.sparkSession, coefficient_rows(theta, se, p.n, p.big, lam, alpha, alternative), SCHEMA, ok)


def classical_glm_ci(df: DataFrame, family: str, x, y, alpha=0.1, alternative="two-sided", w=None, model_based=False) -> DataFrame:
    """The labelled rows alone, with sandwich errors, or those of the inverse Fisher information."""
    with Problem(df.where(column(y).isNotNull()), x, y, y, w, family) as p:
        theta, ok = p.fit(0.0)
        s = p.spread(theta, False)
        se = np.sqrt(np.diag(inverse(s.hessian)) / p.n) if model_based else standard_errors(s, 0.0)
        return p.frame(df.sparkSession, coefficient_rows(theta, se, p.n, 0, 0.0, alpha, alternative), SCHEMA, ok)


def cross_glm_ci(df: DataFrame, family: str, x, y, yhat, models, alpha=0.1, alternative="two-sided", bootstrap: DataFrame | None = None) -> DataFrame:
    """Cross-fit coefficients: weight 1, and the mean of the array column `models` on unlabelled rows. The spreads of gradients come from `bootstrap`, a table of the same columns, if given."""
    f = F.when(column(y).isNotNull(), column(yhat).cast("double")).otherwise(mean_of(models))
    with Problem(df.withColumn("_f", f), x, y, "_f", None, family) as p:
        theta, ok = p.fit(1.0)
        s = p.spread(theta, rectifier_alone=True)
        h, n, big = inverse(s.hessian), p.n, p.big
        if bootstrap is not None:
            with Problem(bootstrap.withColumn("_f", f), x, y, "_f", None, family) as q:
                s, n, big = q.spread(theta, rectifier_alone=True), q.n, q.big
        sigma = h @ (p.n / p.big * s.ghat_u * big / (big - 1) + s.g * n / (n - 1)) @ h
        return p.frame(df.sparkSession, coefficient_rows(theta, np.sqrt(np.diag(sigma) / p.n), p.n, p.big, 1.0, alpha, alternative), SCHEMA, ok)


def glm_correlation(df: DataFrame, family: str, x, y, yhat, coord=None, w=None) -> float:
    with Problem(df.where(column(y).isNotNull()), x, y, yhat, w, family) as p:
        theta, _ = p.fit(0.0)
        s = p.spread(theta, False)
        return correlation(s.g, s.cross, s.ghat, s.hessian, p.n, coord)
