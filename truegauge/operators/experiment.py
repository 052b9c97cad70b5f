"""Around an estimate: weights, sampling, repeated splits, and summaries of their results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.moments import vector_sums
from ..plans.roles import column, listed
from .mean import mean_ci
from .quantile import ranked
from .rectify import bounds
from .resample import PRIME, WHOLE, coefficients, hashes, keyed


def inverse_probability(selected: Column, probability: Column | str) -> Column:
    """1 / p for selected rows, 1 / (1 - p) for the others."""
    p = column(probability).cast("double")
    return F.when(selected, 1 / p).otherwise(1 / (1 - p))


def covariate_shift_weights(df: DataFrame, group, labelled: Column) -> DataFrame:
    """df with weight: how much more often the row's group is among unlabelled rows than among labelled ones; 1 for the former."""
    t = df.withColumn("_g", column(group)).withColumn("_l", labelled)
    shares = t.groupBy("_g").agg(F.count(F.when(F.col("_l"), 1)).alias("_n"), F.count(F.when(~F.col("_l"), 1)).alias("_m"))
    totals = shares.agg(F.sum("_n").alias("_tn"), F.sum("_m").alias("_tm"))
    ratio = shares.crossJoin(F.broadcast(totals)).select(F.col("_g").alias("_h"), ((F.col("_m") / F.col("_tm")) / F.nullif(F.col("_n") / F.col("_tn"), F.lit(0.0))).alias("_w"))
    return t.join(ratio, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("weight", F.when(F.col("_l"), F.col("_w")).otherwise(1.0)).drop("_g", "_l", "_h", "_w")


def weighted_sample(df: DataFrame, k: int, weight, key, seed=0) -> DataFrame:
    """k rows drawn without replacement, with chances by weight: the least exponential times, which partitions thin first.

    A time depends on the row's key (an integer) and the seed alone, by the cubic polynomial of resample.hashes().
    """
    t, h = F.pmod(column(key).cast("long"), F.lit(PRIME)), F.lit(0).cast("long")
    for c in coefficients(seed, np.array([WHOLE]))[:, 0]:
        h = F.pmod(h * t + int(c), F.lit(PRIME))
    time = -F.log((h + 0.5) / float(PRIME)) / column(weight).cast("double")
    return df.withColumn("_t", time).where("_t IS NOT NULL").orderBy("_t", column(key)).limit(k).drop("_t")


def quantile_bins(df: DataFrame, value, bins: int, name: str = "bin") -> DataFrame:
    """df with the bin of a value, from 0: bins end at interpolated quantiles, and a bin holds its lower end; a null value is in bin 0.

    The quantiles' neighbours are found by rank over range partitions.
    """
    v = column(value).cast("double")
    upto = ranked(df, v, [])
    n = int(upto.agg(F.max("upto")).first()[0] or 0)
    places = [(n - 1) * k / bins for k in range(1, bins)]
    ends = [F.min(F.when(F.col("upto") > r, F.col("v"))) for p in places for r in (math.floor(p), math.ceil(p))]
    found = upto.agg(*[e.alias(f"e{k}") for k, e in enumerate(ends)]).first() if n else [0.0] * len(ends)
    out = F.lit(0)
    for k, p in enumerate(places):
        low, high = found[2 * k], found[2 * k + 1]
        out = out + F.when(v >= low + (p - math.floor(p)) * (high - low), 1).otherwise(0)
    return df.withColumn(name, out)


def imputed_mean_ci(df: DataFrame, yhat, threshold: float, alpha=0.1) -> DataFrame:
    """The naive interval that takes thresholded predictions for labels."""
    guess = F.when(column(yhat) > threshold, 1.0).otherwise(0.0)
    return mean_ci(df.select(guess.alias("_y")), "_y", "_y", alpha=alpha, lam=0.0).drop("n_unlabeled", "lam", "coord")


def draws(key: np.ndarray, trials: int, seed: int) -> np.ndarray:
    """(keys, trials): by which a trial orders rows; keys below 2^32 never tie."""
    return hashes(key, seed, 1 + np.arange(trials)) << 32 | np.bitwise_and(key.astype(np.int64), 0xFFFFFFFF)[:, None]


def thresholds(t: DataFrame, sizes: list[int], trials: int, seed: int) -> np.ndarray:
    """(trials, sizes): of each trial the draw of the n-th row, for each of sizes. A task gives its least draws of a trial alone, which are merged in two steps."""
    most, schema = max(sizes), "trial int, part int, least binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, part = [np.zeros(0, np.int64)] * trials, 0
        for g in batches:
            part = int(g["part"].iloc[0]) if len(g) else part
            for k, d in enumerate(draws(g["_key"].to_numpy(), trials, seed).T):
                held[k] = np.sort(np.concatenate([held[k], d]))[:most]
        yield pd.DataFrame({"trial": range(trials), "part": part, "least": [h.tobytes() for h in held]})

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        least = np.sort(np.concatenate([np.frombuffer(x, np.int64) for x in g["least"]]))[:most]
        return pd.DataFrame({"trial": [g["trial"].iloc[0]], "part": [0], "least": [least.tobytes()]})

    some = t.select("_key", F.spark_partition_id().alias("part")).mapInPandas(cut, schema)
    some = some.groupBy("trial", F.expr("part div 64")).applyInPandas(merge, schema)

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        least = np.frombuffer(merge(g)["least"][0], np.int64)
        return pd.DataFrame({"trial": [g["trial"].iloc[0]], "at": [[int(least[min(n, len(least)) - 1]) if len(least) else 0 for n in sizes]]})

    rows = some.groupBy("trial").applyInPandas(pick, "trial int, at array<long>").collect()  # trials times sizes numbers
    return np.array([r["at"] for r in sorted(rows, key=lambda r: r.trial)], dtype=np.int64).reshape(-1, len(sizes))


def trial_grid(df: DataFrame, y, yhat, key, sizes: list[int], trials: int, alpha=0.1, seed=0) -> DataFrame:
    """(trial, n, method, estimate, lower, upper, width): splits of fully labelled rows, n of them keeping their label.

    Which ones goes by a hash of key (an integer) and trial. One pass finds each trial's n-th least hash, and one sums
    moments for all trials and sizes, centred at the means of all rows; rows are neither multiplied nor sorted.
    """
    ask, spark = sorted(set(sizes)), df.sparkSession
    t = keyed(df.where(column(y).isNotNull()), key, [], [y, yhat]).withColumn("_key", F.pmod("_key", F.lit(1 << 52)))  # exact as a double
    rows, *middle = t.agg(F.count(F.lit(1)), F.avg("c0"), F.avg("c1")).first()
    if not rows:
        return spark.createDataFrame([], TRIALS)
    at, width = thresholds(t, ask, trials, seed), len(ask) + 1

    def fn(m: np.ndarray) -> np.ndarray:
        key, (a, f) = m[:, 0].astype(np.int64), (m[:, 1:] - np.array(middle)).T
        z, out = np.stack([np.ones(len(a)), a, f, a * a, f * f, a * f], axis=1), []
        for k, d in enumerate(draws(key, trials, seed).T):
            step = np.searchsorted(at[k], d)  # the first size that holds the row
            out.append(np.stack([np.bincount(step, c, width) for c in z.T], axis=1))
        return np.concatenate(out).ravel()

    sums = np.array(vector_sums(t.select(F.col("_key").cast("double"), "c0", "c1"), [], fn).first().v).reshape(trials, width, 6)
    out = []
    for trial in range(trials):
        known = np.cumsum(sums[trial], axis=0)
        for n, s in zip(ask, known[:-1], strict=True):
            for method in ("rectified", "classical"):
                estimate, se = _split(s, known[-1] - s, method == "rectified")
                low, high = bounds(estimate + middle[0], se, alpha, "two-sided")
                out.append((trial, n, method, float(estimate + middle[0]), float(low), float(high), float(high - low)))
    return spark.createDataFrame(out, TRIALS)


TRIALS = "trial int, n int, method string, estimate double, lower double, upper double, width double"


def _split(s: np.ndarray, u: np.ndarray, rectified: bool) -> tuple[float, float]:
    """(estimate, standard error) from the sums (rows, y, f, yy, ff, yf) of labelled and of other rows; the weight of predictions is tuned and clipped, or 0."""
    (n, y, f, yy, ff, yf), (big, _, uf, _, uff, _) = s, u
    va, vb, ab = yy / n - (y / n) ** 2, ff / n - (f / n) ** 2, yf / n - y * f / n**2
    lam = vu = mu = 0.0
    if rectified and big:
        mu, vu = uf / big, uff / big - (uf / big) ** 2
        pooled = (n * vb + big * vu + n * big / (n + big) * (f / n - mu) ** 2) / (n + big - 1)
        lam = float(np.clip(ab / ((1 + n / big) * pooled), 0, 1)) if pooled > 0 else 0.0
    spread = (lam * lam * vu / big if lam else 0.0) + (va + lam * lam * vb - 2 * lam * ab) / n
    return lam * mu + y / n - lam * f / n, math.sqrt(max(spread, 0.0))


def width_summary(results: DataFrame, by=("method", "n")) -> DataFrame:
    """The mean width of intervals, and how many were averaged."""
    return results.groupBy(*listed(by)).agg(F.avg("width").alias("width"), F.count(F.lit(1)).alias("trials"))


#: Sizes that a pass of rejection_search tries.
STEPS = 7


def rejection_search(df: DataFrame, y, yhat, key, null: float, power: float, sizes: list[int], trials: int, alpha=0.1, seed=0) -> DataFrame:
    """(method, n): the n at which the share of trials whose interval leaves out null reaches power, while n - 1 falls short.

    sizes, and the most that leaves two labelled rows without label, are tried first; then the step in which power is
    first reached is divided, STEPS sizes a pass. Null if even the most doesn't reach it.
    """
    most = df.where(column(y).isNotNull()).count() - 2
    rates: dict[str, dict[int, float]] = {"rectified": {1: 0.0}, "classical": {1: 0.0}}  # one label has no variance
    ask = {n for n in sizes if 1 < n < most} | ({most} if most > 1 else set())
    first: dict[str, int | None] = {}
    while ask:
        t = trial_grid(df, y, yhat, key, sorted(ask), trials, alpha, seed)
        rate = F.avg(F.when((F.col("lower") > null) | (F.col("upper") < null), 1.0).otherwise(0.0))
        for r in t.groupBy("method", "n").agg(rate.alias("rate")).collect():
            rates[r.method][r.n] = r.rate
        ask = set()
        for method, known in rates.items():
            first[method] = high = min((n for n, x in known.items() if x >= power), default=None)
            if high is not None and (low := max((n for n in known if n < high), default=high)) < high - 1:
                ask |= {low + (high - low) * k // (STEPS + 1) for k in range(1, STEPS + 1)} - {low}
    return df.sparkSession.createDataFrame([(m, first.get(m)) for m in rates], "method string, n int")


def effective_ratio(width_a: Column, width_b: Column) -> Column:
    """How many times as many labels the wider interval would need."""
    return (width_b / width_a) * (width_b / width_a)
