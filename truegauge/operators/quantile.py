"""Rectified, cross-fit and classical quantiles, by histograms over a grid.

An indicator y <= g over all rows and all grid points is never made: sums of weights by grid bin, run up along the
grid, give the distribution functions, and three of them the spread of their difference, since for a row the product
of 1{y <= g} and 1{f <= g} is 1{max(y, f) <= g}.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.normal import check_alternative, z_of
from ..plans.prefix import running
from ..plans.roles import by_names, column

GRID = 5000
SUMS = ("y", "f", "y2", "f2", "m2", "u", "u2", "p", "p2")


def _events(df: DataFrame, y, yhat, w, by: list[str], models) -> DataFrame:
    """(by, v, and the sums to which a row's values add): what changes at value v."""
    weight = column(w).cast("double") if w is not None else F.lit(1.0)
    yy = column(y).cast("double")
    zero = dict.fromkeys(SUMS, F.lit(0.0))
    event = lambda at, **x: F.struct(at.alias("v"), *[c.alias(k) for k, c in (zero | x).items()])
    t = df.select(*by, yy.alias("_y"), column(yhat).cast("double").alias("_f"), (column(models).cast("array<double>") if models is not None else F.lit(None)).alias("_k"), weight.alias("_w"))
    y_, f_, w_ = F.col("_y"), F.col("_f"), F.col("_w")
    known = F.array(event(y_, y=w_, y2=w_ * w_), event(f_, f=w_, f2=w_ * w_), event(F.greatest(y_, f_), m2=w_ * w_))
    if models is None:
        other = F.array(event(f_, u=w_, u2=w_ * w_, p=w_, p2=w_ * w_))
    else:  # the distribution function averages the models, its spread is that of their mean
        mean = F.aggregate("_k", F.lit(0.0), lambda a, x: a + x) / F.size("_k")
        other = F.concat(F.transform("_k", lambda x: event(x, u=w_ / F.size("_k"))), F.array(event(mean, p=w_, p2=w_ * w_)))
    return t.select(*by, F.explode(F.when(y_.isNotNull(), known).otherwise(other)).alias("e")).select(*by, "e.*")


def _sizes(df: DataFrame, y, w, by: list[str]) -> DataFrame:
    weight = column(w).cast("double") if w is not None else F.lit(1.0)
    t = df.select(*by, column(y).isNotNull().alias("_known"), weight.alias("_w"))
    on = F.col("_known")
    return t.groupBy(*by).agg(F.count(F.when(on, 1)).alias("n"), F.count(F.when(~on, 1)).alias("n_unlabeled"), F.sum(F.when(on, F.col("_w"))).alias("w_l"), F.sum(F.when(~on, F.col("_w"))).alias("w_u"))


def rectified_cdf(df: DataFrame, y, yhat, by=(), exact_grid=False, w=None, models=None, bootstrap: DataFrame | None = None) -> DataFrame:
    """(by, grid, n, n_unlabeled, cdf, se, imputed, rectifier): the rectified distribution function at grid points.

    The grid is GRID points from the least to the greatest value, or with exact_grid all the values. models: an array
    column of predictions on unlabelled rows, instead of yhat there. The spreads come from `bootstrap`, a table of the
    same columns, if given; this takes the even grid.
    """
    if bootstrap is not None and exact_grid:
        raise ValueError("spreads of a bootstrap table need the even grid")
    df, names = by_names(df, by)
    out, ends = _steps(df, y, yhat, names, exact_grid, w, models)
    spread = lambda t: F.greatest(F.sqrt(F.col(f"{t}var_l") / F.col("n") + F.col(f"{t}var_u") / F.col("n_unlabeled")), F.lit(1e-16))
    if bootstrap is None:
        return out.withColumn("se", spread("")).drop("var_l", "var_u")
    other = _steps(by_names(bootstrap, by)[0], y, yhat, names, False, w, models, ends)[0]
    other = other.select(*[F.col(b).alias(f"_{b}") for b in names], F.col("grid").alias("_grid"), F.col("var_l").alias("_var_l"), F.col("var_u").alias("_var_u"))
    both = out.join(other, [F.col("grid") == F.col("_grid"), *[F.col(b).eqNullSafe(F.col(f"_{b}")) for b in names]])
    return both.withColumn("se", spread("_")).select(*names, "grid", "n", "n_unlabeled", "cdf", "se", "imputed", "rectifier")


def _steps(df: DataFrame, y, yhat, by: list[str], exact_grid: bool, w, models, ends: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(by, grid, n, n_unlabeled, cdf, var_l, var_u, imputed, rectifier), and the even grid's ends, which may be given; var_: the variance of a row's part, of labelled and of other rows."""
    events = _events(df, y, yhat, w, by, models)
    if exact_grid:
        steps = events.groupBy(*by, F.col("v").alias("grid")).agg(*[F.sum(c).alias(c) for c in SUMS])
        steps = running(steps, "grid", list(SUMS), by)
    else:
        ends = events.groupBy(*by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")) if ends is None else ends
        step = (F.col("_hi") - F.col("_lo")) / (GRID - 1)
        point = lambda g: F.when(g >= GRID - 1, F.col("_hi")).otherwise(F.col("_lo") + g * step)
        at = F.ceil((F.col("v") - F.col("_lo")) / F.nullif(step, F.lit(0.0)))
        guess = F.when(step > 0, F.greatest(F.least(at, F.lit(GRID)), F.lit(0))).otherwise(0).cast("int")  # values of another table may lie beyond the ends
        fixed = F.when((guess > 0) & (F.col("v") <= point(guess - 1)), guess - 1).when(F.col("v") > point(guess), guess + 1).otherwise(guess)
        same = [F.col(f"_{b}").eqNullSafe(F.col(b)) for b in by]
        ends_of = ends.select(*[F.col(b).alias(f"_{b}") for b in by], "_lo", "_hi")
        binned = (events.join(ends_of, same) if by else events.crossJoin(F.broadcast(ends_of))).withColumn("_bin", fixed)
        sums = binned.groupBy(*by, "_bin").agg(*[F.sum(c).alias(c) for c in SUMS])
        grid = ends.withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))).withColumn("grid", point(F.col("_bin"))).drop("_lo", "_hi")
        on = [F.col("s._bin") == F.col("r._bin"), *[F.col(f"s.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by]]
        upto = W.partitionBy(*[f"r.{b}" for b in by]).orderBy("r._bin")  # GRID rows for each group
        steps = grid.alias("r").join(sums.alias("s"), on, "left").select(*[f"r.{b}" for b in by], "r._bin", "r.grid", *[F.coalesce(F.sum(f"s.{c}").over(upto), F.lit(0.0)).alias(c) for c in SUMS])
    sizes = _sizes(df, y, w, by)
    both = steps.join(sizes.select(*[F.col(b).alias(f"_{b}") for b in by], "n", "n_unlabeled", "w_l", "w_u"), [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]) if by else steps.crossJoin(F.broadcast(sizes))
    n, big = F.col("n").cast("double"), F.col("n_unlabeled").cast("double")
    imputed, means = F.col("u") / F.col("w_u"), F.col("p") / F.col("w_u")
    rectifier = (F.col("y") - F.col("f")) / F.col("w_l")
    square = n / (F.col("w_l") * F.col("w_l")) * (F.col("y2") + F.col("f2") - 2 * F.col("m2"))
    var_l, var_u = F.greatest(square - rectifier * rectifier, F.lit(0.0)), F.greatest(F.col("p2") * big / (F.col("w_u") * F.col("w_u")) - means * means, F.lit(0.0))
    return both.select(*by, "grid", "n", "n_unlabeled", (imputed + rectifier).alias("cdf"), var_l.alias("var_l"), var_u.alias("var_u"), imputed.alias("imputed"), rectifier.alias("rectifier")), ends


def quantile_estimate(df: DataFrame, y, yhat, q: float, by=(), exact_grid=False, w=None, models=None) -> DataFrame:
    """The first grid point at which the rectified distribution function is nearest q."""
    names = by_names(df, by)[1]
    cdf = rectified_cdf(df, y, yhat, by, exact_grid, w, models)
    return cdf.groupBy(*names).agg(F.max("n").alias("n"), F.max("n_unlabeled").alias("n_unlabeled"), F.min_by("grid", F.struct(F.round(F.abs(F.col("cdf") - q), 12), "grid")).alias("estimate"))


def quantile_ci(df: DataFrame, y, yhat, q: float, by=(), alpha=0.1, exact_grid=False, w=None, models=None, alternative="two-sided", bootstrap: DataFrame | None = None) -> DataFrame:
    """The least and the greatest grid point at which q isn't rejected; null if there is none."""
    names = by_names(df, by)[1]
    cdf = rectified_cdf(df, y, yhat, by, exact_grid, w, models, bootstrap)
    z, most = (F.col("cdf") - q) / F.col("se"), z_of(alpha, alternative)
    inside = {"two-sided": F.abs(z) < most, "larger": z < most, "smaller": z > -most}[check_alternative(alternative)]
    return cdf.groupBy(*names).agg(F.max("n").alias("n"), F.max("n_unlabeled").alias("n_unlabeled"), F.min(F.when(inside, F.col("grid"))).alias("lower"), F.max(F.when(inside, F.col("grid"))).alias("upper"))


def ranked(df: DataFrame, v: Column | str, by: list[str]) -> DataFrame:
    """(by, v, upto): distinct values with how many rows of the group are not above them."""
    return running(df.select(*by, column(v).cast("double").alias("v")).where("v IS NOT NULL").groupBy(*by, "v").agg(F.count(F.lit(1)).cast("double").alias("upto")), "v", ["upto"], by)


def classical_quantile_ci(df: DataFrame, y, q: float, by=(), alpha=0.1) -> DataFrame:
    """Order statistics at the ranks n q -+ z sqrt(n q (1 - q)), cut to whole numbers within the sample."""
    df, by = by_names(df, by)
    r = ranked(df, y, by)
    sizes = r.groupBy(*by).agg(F.max("upto").alias("n"))
    z = z_of(alpha) * (q * (1 - q)) ** 0.5
    place = lambda sign: F.least(F.greatest((F.col("n") * q + sign * z * F.sqrt("n")).cast("long"), F.lit(0)), F.col("n").cast("long") - 1)
    both = r.join(sizes.select(*[F.col(b).alias(f"_{b}") for b in by], "n"), [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]) if by else r.crossJoin(F.broadcast(sizes))
    return both.groupBy(*by).agg(F.max("n").cast("long").alias("n"), F.min(F.when(F.col("upto") > place(-1), F.col("v"))).alias("lower"), F.min(F.when(F.col("upto") > place(1), F.col("v"))).alias("upper"))


def conformal_mean_ci(df: DataFrame, y, yhat, alpha=0.1, bonferroni=True) -> DataFrame:
    """The mean prediction of unlabelled rows, give or take a conformal quantile of the labelled errors; infinite if there are too few labels."""
    yy, f = column(y).cast("double"), column(yhat).cast("double")
    known = yy.isNotNull()
    sizes = df.agg(F.count(F.when(known, 1)).alias("n"), F.count(F.when(~known, 1)).alias("n_unlabeled"), F.avg(F.when(~known, f)).alias("estimate"))
    level = (1 - alpha / F.col("n_unlabeled") if bonferroni else F.lit(1 - alpha)) * (1 + 1 / F.col("n"))
    r = ranked(df, F.when(known, F.abs(yy - f)), []).crossJoin(F.broadcast(sizes.withColumn("_level", level)))
    rank = F.ceil(F.round(F.col("_level") * (F.col("n") - 1), 9))
    out = r.groupBy("n", "n_unlabeled", "estimate").agg(F.min(F.when((F.col("_level") < 1) & (F.col("upto") > rank), F.col("v"))).alias("_q"))
    half = F.coalesce("_q", F.lit(float("inf")))
    return out.select("n", "n_unlabeled", "estimate", (F.col("estimate") - half).alias("lower"), (F.col("estimate") + half).alias("upper"))


def discrete_distribution(df: DataFrame, value, by=(), sorted_by_frequency=False) -> DataFrame:
    """(by, value, frequency) of the values that occur."""
    df, names = by_names(df, by)
    counts = df.groupBy(*names, column(value).alias("value")).agg(F.count(F.lit(1)).alias("_n"))
    out = counts.withColumn("frequency", F.col("_n") / F.sum("_n").over(W.partitionBy(*names))).drop("_n")
    return out.orderBy(*names, F.desc("frequency")) if sorted_by_frequency else out.orderBy(*names, "value")
