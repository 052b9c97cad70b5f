"""Label shift: the distribution of labels of unlabelled rows, from the confusion matrix of labelled ones."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import binomial_ppf, bisect, dkw_error, max_binomial_error
from ..plans.roles import column


def class_counts(df: DataFrame, y, yhat, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows by prediction and label, and unlabelled ones by prediction; classes that don't occur count 0."""
    t = df.groupBy(column(y).cast("int").alias("y"), column(yhat).cast("int").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    known, other = np.zeros((classes, classes), dtype=np.int64), np.zeros(classes, dtype=np.int64)
    for r in t.where(F.col("f").between(0, classes - 1) & F.coalesce(F.col("y"), F.lit(0)).between(0, classes - 1)).collect():  # classes * (classes + 1) rows at most
        if r.y is None:
            other[r.f] = r.n
        else:
            known[r.f, r.y] = r.n
    return known, other


def shifted_ci(df: DataFrame, y, yhat, classes: int, nu, alpha=0.1, delta=None, counts=True) -> DataFrame:
    """Bounds on nu' q, q being the unlabelled rows' label distribution: of the expected share, or of the count.

    Labels and predictions are classes 0 .. classes - 1. delta, the part of alpha spent on the confusion matrix and
    the predictions' frequencies, is 0.95 alpha for counts and all of it otherwise.
    """
    known, other = class_counts(df, y, yhat, classes)
    n, big = known.sum(axis=0), int(other.sum())
    if (n == 0).any():
        raise ValueError("a class has no labelled row")
    matrix = known / n
    estimate = float(np.asarray(nu, dtype=float) @ np.linalg.solve(matrix, other / big))
    delta = delta if delta is not None else 0.95 * alpha if counts else alpha

    def imbalance(share: float) -> float:
        z = NormalDist().inv_cdf(1 - share * delta / (2 * classes**2))
        return math.sqrt(1 / (4 * n.min())) * 2 * z - dkw_error(big, (1 - share) * delta)

    share = bisect(imbalance, 1e-9, 1 - 1e-9)
    share = 0.999999 if share is None else share
    off = max(max_binomial_error(int(n[k]), classes, share * delta, matrix[:, k]) for k in range(classes)) + dkw_error(big, (1 - share) * delta)
    low, high = max(0.0, min(1.0, estimate - off)), max(0.0, min(1.0, estimate + off))
    if counts:
        low, high = binomial_ppf((alpha - delta) / 2, big, low), binomial_ppf(1 - (alpha - delta) / 2, big, high)
    return df.sparkSession.createDataFrame([(int(n.sum()), big, estimate, float(low), float(high))], "n long, n_unlabeled long, estimate double, lower double, upper double")
