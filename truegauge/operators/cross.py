"""Cross-fit means: unlabelled rows carry an array of predictions, one for each model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import interval
from ..plans.roles import by_names, column
from .linear import mean_of


def cross_mean_ci(df: DataFrame, y, yhat, models, by=(), alpha=0.1, alternative="two-sided", bootstrap: DataFrame | None = None) -> DataFrame:
    """Mean of the models' mean prediction plus the mean labelled error; spreads come from `bootstrap`, a table of the same columns, if given."""

    def moments(t: DataFrame) -> tuple[DataFrame, list[str]]:
        t, names = by_names(t, by)
        yy = column(y).cast("double")
        u, e = F.when(yy.isNull(), mean_of(models)), yy - column(yhat).cast("double")
        return t.groupBy(*names).agg(F.count(yy).alias("n"), F.count(u).alias("n_unlabeled"), (F.avg(u) + F.avg(e)).alias("estimate"), F.var_pop(u).alias("vu"), F.var_pop(e).alias("ve")), names

    m, names = moments(df)
    if bootstrap is not None:
        other = moments(bootstrap)[0].select(*[F.col(b).alias(f"_{b}") for b in names], F.col("vu").alias("_vu"), F.col("ve").alias("_ve"))
        m = m.join(other, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in names]) if names else m.crossJoin(other)
        m = m.withColumn("vu", F.col("_vu")).withColumn("ve", F.col("_ve"))
    m = m.withColumn("se", F.sqrt(F.col("vu") / F.col("n_unlabeled") + F.col("ve") / F.col("n")))
    low, high = interval(F.col("estimate"), F.col("se"), alpha, alternative)
    return m.select(*names, "n", "n_unlabeled", "estimate", "se", low.alias("lower"), high.alias("upper"))
