"""Rectified and classical means: one aggregation of central moments by group, and arithmetic on their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import interval, p_value
from ..plans.roles import by_names, checked, column, listed


def _moments(df: DataFrame, y: list, yhat: list, w, by: list) -> DataFrame:
    """n, n_unlabeled and, for each coordinate, central moments of w y (a), w f (b) and w on labelled rows, of w f (u) on the others."""
    given = w is not None
    t = checked(df, y, [*yhat, *([w] if given else [])], by)
    weight = F.col(f"c{len(yhat)}") if given else F.lit(1.0)
    on = lambda x: F.when(F.col("y0").isNotNull(), x)
    off = lambda x: F.when(F.col("y0").isNull(), x)
    out = [F.count("y0").alias("n"), (F.count(F.lit(1)) - F.count("y0")).alias("n_unlabeled")]
    if given:
        out += [F.sum(on(weight)).alias("w_l"), F.sum(off(weight)).alias("w_u"), F.var_pop(on(weight)).alias("vw"), F.var_pop(off(weight)).alias("vwu")]
    for k in range(len(y)):
        a, b = weight * F.col(f"y{k}"), weight * F.col(f"c{k}")
        moments = {"ma": F.avg(a), "mb": F.avg(on(b)), "mu": F.avg(off(b)), "va": F.var_pop(a), "vb": F.var_pop(on(b)), "vu": F.var_pop(off(b)), "ab": F.covar_pop(a, on(b))}
        if given:
            moments |= {"aw": F.covar_pop(a, on(weight)), "bw": F.covar_pop(on(b), on(weight)), "uw": F.covar_pop(off(b), off(weight))}
        out += [v.alias(f"{c}{k}") for c, v in moments.items()]
    return t.groupBy(*by).agg(*out) if by else t.agg(*out)


def _weights(d: int, given: bool, lam, clip: bool, mode: str, coord: int | None) -> list[Column]:
    """The weight of predictions for each coordinate, from a row of moments."""
    m = lambda name, k: F.coalesce(F.nanvl(F.col(f"{name}{k}"), F.lit(0.0)), F.lit(0.0))
    n, big = F.col("n").cast("double"), F.col("n_unlabeled").cast("double")
    if lam is not None:
        fixed = list(lam) if hasattr(lam, "__len__") else [lam] * d
        return [F.when(big > 0, F.lit(float(x))).otherwise(0.0) for x in fixed]
    s, t = _scales(given)
    cross, spread = [], []
    for k in range(d):
        c, vl, vu = m("ab", k), m("vb", k), m("vu", k)
        if given:  # gradients are w (y - theta), theta being the estimate at weight 1
            theta = t * m("mu", k) + s * (m("ma", k) - m("mb", k))
            vw, vwu = F.coalesce("vw", F.lit(0.0)), F.coalesce("vwu", F.lit(0.0))
            c = c - theta * (m("aw", k) + m("bw", k)) + theta * theta * vw
            vl = vl - 2 * theta * m("bw", k) + theta * theta * vw
            vu = vu - 2 * theta * m("uw", k) + theta * theta * vwu
        apart = s * m("mb", k) - t * m("mu", k)
        pooled = (n * s * s * vl + big * t * t * vu + n * big / (n + big) * apart * apart) / (n + big - 1)
        cross.append(s * s * c)
        spread.append((1 + n / big) * pooled)
    if mode == "overall":
        some = range(d) if coord is None else [coord]
        cross, spread = ([sum((x[k] for k in some), F.lit(0.0))] * d for x in (cross, spread))
    elif mode != "element":
        raise ValueError("mode must be overall or element")
    lams = [F.when((big > 0) & (v != 0), c / v).otherwise(0.0) for c, v in zip(cross, spread, strict=True)]
    return [F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in lams] if clip else lams


def _scales(given: bool) -> tuple[Column, Column]:
    """What makes weights have mean 1, on labelled and on other rows."""
    if not given:
        return F.lit(1.0), F.lit(1.0)
    return F.col("n") / F.col("w_l"), F.coalesce(F.col("n_unlabeled") / F.nullif(F.col("w_u"), F.lit(0.0)), F.lit(0.0))


def _estimated(df, y, yhat, by, lam, coord, w, mode, clip) -> DataFrame:
    """(by, coord, n, n_unlabeled, lam, estimate, se): arithmetic on each group's row of moments; a group without labels gives none."""
    y, yhat = listed(y), listed(yhat)
    if len(y) != len(yhat):
        raise ValueError("y and yhat must be as many")
    df, names = by_names(df, by)
    d, given = len(y), w is not None
    told = _moments(df, y, yhat, w, names).where("n > 0").withColumns({f"_lam{k}": x for k, x in enumerate(_weights(d, given, lam, clip, mode, coord))})
    m = lambda name, k: F.coalesce(F.nanvl(F.col(f"{name}{k}"), F.lit(0.0)), F.lit(0.0))
    (s, t), out = _scales(given), []
    for k in range(d):
        x = F.col(f"_lam{k}")
        estimate = x * t * m("mu", k) + s * (m("ma", k) - x * m("mb", k))
        spread = x * x * t * t * m("vu", k) / F.greatest(F.col("n_unlabeled"), F.lit(1)) + s * s * (m("va", k) + x * x * m("vb", k) - 2 * x * m("ab", k)) / F.col("n")
        out.append(F.struct(F.lit(k).alias("coord"), x.alias("lam"), estimate.alias("estimate"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("se")))
    rows = told.select(*names, "n", "n_unlabeled", F.explode(F.array(*out)).alias("_r"))
    return rows.select(*names, "_r.coord", "n", "n_unlabeled", "_r.lam", "_r.estimate", "_r.se")


def mean_estimate(df: DataFrame, y, yhat, by=(), lam=None, coord=None, w=None, mode="overall") -> DataFrame:
    """Power-tuned rectified means by group and coordinate."""
    return _estimated(df, y, yhat, by, lam, coord, w, mode, True).drop("se")


def mean_ci(df: DataFrame, y, yhat, by=(), alpha=0.1, alternative="two-sided", lam=None, coord=None, w=None, mode="overall") -> DataFrame:
    """Rectified means with standard errors and bounds. lam 0 is the classical mean, None is tuned and clipped to [0, 1]."""
    out = _estimated(df, y, yhat, by, lam, coord, w, mode, True)
    low, high = interval(F.col("estimate"), F.col("se"), alpha, alternative)
    return out.withColumn("lower", low).withColumn("upper", high)


def mean_pval(df: DataFrame, y, yhat, by=(), null=0.0, alternative="two-sided", lam=None, coord=None, w=None, mode="overall") -> DataFrame:
    """P-values against null; a tuned lam is not clipped here."""
    out = _estimated(df, y, yhat, by, lam, coord, w, mode, False)
    return rectified_p_value(out, F.lit(0.0), F.lit(0.0), F.col("estimate"), F.col("se"), null, alternative)


def rectified_p_value(df: DataFrame, rectifier: Column, rectifier_se: Column, imputed: Column, imputed_se: Column, null=0.0, alternative="two-sided") -> DataFrame:
    """df with p_value of imputed + rectifier; the standard error is 1e-16 at least."""
    se = F.greatest(F.sqrt(imputed_se * imputed_se + rectifier_se * rectifier_se), F.lit(1e-16))
    return df.withColumn("p_value", p_value((imputed + rectifier - null) / se, alternative))


def classical_mean_ci(df: DataFrame, y, by=(), alpha=0.1, alternative="two-sided", w=None) -> DataFrame:
    """The mean of the labelled rows alone."""
    ys = listed(y)
    return mean_ci(df.where(column(ys[0]).isNotNull()), y, ys, by, alpha, alternative, lam=0.0, w=w).drop("n_unlabeled", "lam")
