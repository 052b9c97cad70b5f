"""The weight of predictions, and the sandwich, from small matrices of gradient moments."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from ..functions.normal import check_alternative, p_value_of, z_of


class Spread(NamedTuple):
    """Gradient moments: covariances (ddof 0) of g, of g with ghat, of ghat on labelled and unlabelled rows, and means of ghat."""

    n: int
    big: int
    g: np.ndarray
    cross: np.ndarray
    ghat: np.ndarray
    ghat_u: np.ndarray
    mean_hat: np.ndarray
    mean_hat_u: np.ndarray
    hessian: np.ndarray


def inverse(hessian: np.ndarray) -> np.ndarray:
    if not np.isfinite(hessian).all() or np.linalg.cond(hessian) > 1e14:
        raise ValueError("the covariates are linearly dependent")
    return np.linalg.inv(hessian)


def power_weight(s: Spread, coord: int | None = None, clip: bool = False, mode: str = "overall"):
    """The weight that minimises the trace (or a coordinate's variance, or each) of the rectified estimate's covariance."""
    if not s.big:
        return 0.0
    h, m = inverse(s.hessian), s.n + s.big
    cross = s.cross + s.cross.T
    apart = s.mean_hat - s.mean_hat_u
    pooled = (s.n * s.ghat + s.big * s.ghat_u + s.n * s.big / m * np.outer(apart, apart)) / (m - 1)
    left = h if coord is None else h[[coord]]
    num, den = (np.diag(left @ a @ left.T) for a in (cross, 2 * (1 + s.n / s.big) * pooled))
    if mode == "overall":
        num, den = num.sum(), den.sum()
        lam = num / den if den else 0.0
        return float(np.clip(lam, 0, 1) if clip else lam)
    if mode != "element":
        raise ValueError("mode must be overall or element")
    lam = np.divide(num, den, out=np.zeros_like(num), where=den != 0)
    return np.clip(lam, 0, 1) if clip else lam


def standard_errors(s: Spread, lam) -> np.ndarray:
    """Of each coefficient: the sandwich over labelled gradients less lam times the predicted ones, plus those of unlabelled rows (ddof 1)."""
    h = inverse(s.hessian)
    rect = (s.g - lam * (s.cross + s.cross.T) + lam * lam * s.ghat) * s.n / (s.n - 1)
    if s.big and lam:
        rect = rect + s.n / s.big * lam * lam * s.ghat_u * s.big / (s.big - 1)
    return np.sqrt(np.maximum(np.diag(h @ rect @ h), 0) / s.n)


def bounds(estimate: float, se: float, alpha: float, alternative: str) -> tuple[float, float]:
    z = z_of(alpha, alternative)
    return (-math.inf if alternative == "smaller" else estimate - z * se), (math.inf if alternative == "larger" else estimate + z * se)


#: What estimators of coefficients return, for each coordinate.
SCHEMA = "coord int, n long, n_unlabeled long, lam double, estimate double, se double, lower double, upper double, p_value double"


def coefficient_rows(theta, se, n, big, lam, alpha, alternative) -> list[tuple]:
    check_alternative(alternative)
    return [(k, int(n), int(big), float(lam), float(t), float(e), *map(float, bounds(t, e, alpha, alternative)), float(p_value_of(t / max(e, 1e-300), alternative))) for k, (t, e) in enumerate(zip(theta, se, strict=True))]


def correlation(g: np.ndarray, cross: np.ndarray, ghat: np.ndarray, hessian: np.ndarray, n: int, coord: int | None = None) -> float:
    """How much of a coefficient's gradient the predicted one explains, at most 1 - 1 / n."""
    h, k = inverse(hessian), coord or 0
    at = lambda a: (h @ a @ h)[k, k]
    return float(min(at(cross) / math.sqrt(at(g) * at(ghat)), 1 - 1 / n))
