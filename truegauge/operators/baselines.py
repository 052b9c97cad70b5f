"""Other methods to compare with: semisupervised means, post-prediction regression, and intervals for odds ratios."""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import z_of
from ..plans.moments import vector_sums
from ..plans.prefix import ranks
from ..plans.roles import checked, column, listed
from .rectify import SCHEMA, bounds, coefficient_rows, inverse
from .resample import MOST_ROWS, keyed, least_squares, pair_products, replicate_sums, samples, symmetric


def semisupervised_mean_ci(df: DataFrame, x, y, folds: int, order, alpha=0.1, alternative="two-sided", intercept=True) -> DataFrame:
    """Cross-fit linear adjustment of the labelled mean by the unlabelled covariates.

    `order` puts labelled and unlabelled rows in order; folds are stretches of int(n / folds) labelled rows, the rest
    is in none and predicted 0. A fold's slopes come from the Gram matrix of all labelled rows less its own. As in the
    method compared with, a fold's centred covariates are those of the unlabelled rows in its places, of which there
    must be as many.
    """
    t = checked(df, [y], [order, *listed(x)], [])
    t = t.withColumn("_x", F.array(*[F.lit(1.0)] * intercept, *[f"c{k + 1}" for k in range(len(listed(x)))])).withColumn("known", F.col("y0").isNotNull())
    d = len(listed(x)) + intercept
    placed = ranks(t.select("known", "c0", "y0", "_x"), ["known"], "c0")
    n, big = t.agg(F.count("y0"), F.count(F.when(~F.col("known"), 1))).first()
    size = n // folds
    fold = F.when(F.col("_rank") < folds * size, F.floor(F.col("_rank") / size) if size else F.lit(0)).otherwise(folds).cast("int")
    parts = [F.col("_x")[k].alias(f"x{k}") for k in range(d)]
    whole = placed.where("known").select(fold.alias("fold"), *parts, F.col("y0").alias("y"))
    gram = {r.fold: np.array(r.v).reshape(d, d + 1) for r in vector_sums(whole, ["fold"], lambda m: (m[:, :d].T @ m).ravel()).collect()}
    total, none = sum(gram.values()), np.zeros((d, d + 1))
    left = [total - gram.get(j, none) for j in range(folds)]
    beta = np.stack([inverse(g[:, :d]) @ g[:, d] for g in left])

    other = placed.where("NOT known")
    middle = np.array(other.agg(*[F.avg(p).alias(f"m{k}") for k, p in enumerate(parts)]).first(), dtype=float)
    centred = F.array(*[F.col("_x")[k] - float(m) for k, m in enumerate(middle)])
    about = vector_sums(other.select(*[centred[k].alias(f"x{k}") for k in range(d)]), [], lambda m: (m.T @ m).ravel()).first().v
    spread = np.array(about).reshape(d, d) / big
    slopes = F.array(*[F.array(*map(F.lit, map(float, b))) for b in beta])
    dot = lambda v: F.aggregate(F.zip_with(v, slopes[F.col("fold")], lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    opposite = other.where(F.col("_rank") < folds * size).select("_rank", centred.alias("_c"))
    pairs = placed.where("known").where(F.col("_rank") < folds * size).withColumn("fold", fold).join(opposite, "_rank").select("fold", "y0", dot(F.col("_x")).alias("fitted"), dot(F.col("_c")).alias("along"))
    rest = F.col("y0") - F.col("along")
    r = pairs.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("fitted").alias("fitted"), F.avg("along").alias("along"), F.avg(F.col("along") * rest).alias("both"), F.avg(rest).alias("rest"), F.var_pop(rest).alias("apart")).orderBy("fold").collect()
    if sum(p.n for p in r) != folds * size:
        raise ValueError("there must be as many unlabelled rows as labelled ones in folds")
    labels = t.agg(F.avg("y0")).first()[0]
    estimate = float((beta @ middle).mean() + labels - sum(p.fitted for p in r) / n)
    square = np.array([b @ spread @ b + 2 * p.both for b, p in zip(beta, r, strict=True)])
    apart = sum(p.n * (p.apart + (p.rest - estimate) ** 2) for p in r) / n + (n - folds * size) / n * estimate**2
    se = float(np.sqrt((apart + n / big * np.mean([s - 2 * p.along * estimate for s, p in zip(square, r, strict=True)])) / n))
    low, high = bounds(estimate, se, alpha, alternative)
    return df.sparkSession.createDataFrame([(n, big, estimate, se, float(low), float(high))], "n long, n_unlabeled long, estimate double, se double, lower double, upper double")


def recalibrated(df: DataFrame, y, yhat, *rest: str) -> DataFrame:
    """rest and v, the non-decreasing function of yhat that is nearest y where that is known, on all rows: linear between its knots, constant beyond."""
    t = df.select(*rest, column(y).cast("double").alias("_y"), column(yhat).cast("double").alias("_f"))
    model = IsotonicRegression(featuresCol="_f", labelCol="_y", predictionCol="v").fit(t.where("_y IS NOT NULL").select("_y", "_f"))
    return model.transform(t).select(*rest, "v")


def postprediction_ols_ci(df: DataFrame, x, y, yhat, key, n_resamples=50, alpha=0.1, alternative="two-sided", seed=0) -> DataFrame:
    """Regression of unlabelled rows on recalibrated predictions: an isotonic map fitted to the labels, then medians of bootstrap coefficients and errors (HC0).

    Rows are resampled by weights that their key draws, in two passes: of Gram matrices, then of residuals.
    """
    x, replicate = listed(x), 1 + np.arange(n_resamples)
    d, fit = len(x), least_squares(len(x))
    n, big = df.agg(F.count(column(y)), F.count(F.when(column(y).isNull(), 1))).first()
    named = df.select(column(y).alias("_l"), column(yhat).alias("_p"), column(key).cast("long").alias("_k"), *[column(c).cast("double").alias(f"_x{k}") for k, c in enumerate(x)])
    rows = recalibrated(named, "_l", "_p", "_l", "_k", *[f"_x{k}" for k in range(d)]).where("_l IS NULL")
    t = keyed(rows, "_k", [], ["v", *[f"_x{k}" for k in range(d)]])
    sums = replicate_sums(t, seed, replicate, lambda m, w: w.T @ fit.features(m[:, 1:], m[:, 0]))
    beta, h = fit.finish(sums), np.linalg.inv(symmetric(sums[:, : d * (d + 1) // 2], d))
    meat = symmetric(replicate_sums(t, seed, replicate, lambda m, w: (w * (m[:, :1] - m[:, 1:] @ beta.T) ** 2).T @ pair_products(m[:, 1:])), d)
    se = np.sqrt(np.diagonal(h @ meat @ h, axis1=1, axis2=2))
    return df.sparkSession.createDataFrame(coefficient_rows(np.median(beta, axis=0), np.median(se, axis=0), n, big, 1.0, alpha, alternative), SCHEMA)


def odds_ratio(groups: DataFrame, by: str) -> DataFrame:
    """The ratio of odds of two means (by true over by false) with (lower, upper), from their intervals at half the error level."""
    side = lambda v: groups.where(F.col(by) if v else ~F.col(by)).select(*[F.col(c).alias(f"{c}{int(v)}") for c in ("estimate", "lower", "upper")])
    odds = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) / F.nullif(1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))), F.lit(0.0))
    out = side(True).crossJoin(side(False))  # one row each
    return out.select((odds("estimate1") / odds("estimate0")).alias("estimate"), (odds("lower1") / odds("upper0")).alias("lower"), (odds("upper1") / odds("lower0")).alias("upper"))


def maritz_jarrett_ci(df: DataFrame, y, q: float, alpha=0.05, most_rows=MOST_ROWS) -> DataFrame:
    """A quantile of the labelled rows, interpolated at place (n + 1) q, with the Maritz-Jarrett error: order statistics weighted by a beta distribution."""
    from ..functions.normal import incomplete_beta

    known, _ = samples(df.where(column(y).isNotNull()), [], y, most_rows)
    v = np.sort(known[:, 0])
    n = len(v)
    m = int(n * q + 0.5)
    edge = np.array([incomplete_beta(m - 1, n - m, k / n) if 1 < m < n else float(k >= m) for k in range(n + 1)])
    w = np.diff(edge)
    mean, square = float(w @ v), float(w @ v**2)
    se, middle, z = float(np.sqrt(max(square - mean**2, 0.0))), float(np.interp((n + 1) * q, np.arange(1, n + 1), v)), z_of(alpha)
    return df.sparkSession.createDataFrame([(n, middle, se, middle - z * se, middle + z * se)], "n long, estimate double, se double, lower double, upper double")
