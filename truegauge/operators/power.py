"""Planning: how many labels and predictions to buy, from the correlation of labels with predictions."""

from __future__ import annotations

import math
import warnings
from statistics import NormalDist
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normal import bisect
from ..plans.roles import column
from .glm import glm_correlation
from .linear import ols_correlation

SCHEMA = "n long, n_unlabeled long, cost double, effective_n long, correlation double"


class Costs(NamedTuple):
    """Of a row's covariates, of its label, and of its prediction."""

    x: float
    y: float
    yhat: float

    def of(self, n: float, big: float) -> float:
        return n * (self.x + self.y + self.yhat) + big * (self.x + self.yhat)

    @property
    def ratio(self) -> float:
        return (self.x + self.yhat) / self.y

    @property
    def classical(self) -> float:
        return self.x + self.y


class Plan(NamedTuple):
    n: int
    n_unlabeled: int
    cost: float
    effective_n: int
    correlation: float


def effective_size(n: float, big: float, correlation: float) -> float:
    """The number of labels that alone would be as good."""
    return n * (n + big) / (n + (1 - correlation**2) * big)


def rectified_cost(correlation: float, costs: Costs) -> float:
    """The least cost of what one label alone would be worth."""
    r = correlation**2
    return costs.y * (1 - r + costs.ratio * r + 2 * math.sqrt(costs.ratio * r * (1 - r)))


def best_pair(size: float, correlation: float, costs: Costs) -> Plan:
    """The cheapest sizes that are worth `size` labels, rounded half to even."""
    r = correlation**2
    n = size * (1 - r + math.sqrt(costs.ratio * r * (1 - r)))
    big = n * (size - n) / (n - (1 - r) * size) if r else 0
    n, big = round(n), round(big)
    return Plan(n, big, costs.of(n, big), round(effective_size(n, big, correlation)), correlation)


def labels_only(n: int, correlation: float, costs: Costs) -> Plan:
    return Plan(n, 0, n * costs.classical, n, correlation)


def plan(correlation: float, cost_x: float, cost_y: float, cost_yhat: float, budget: float | None = None, effective_n: float | None = None, n_max: int | None = None) -> Plan:
    """The most powerful sizes within a budget, or the cheapest that are worth effective_n labels; of n_max rows at most, if given.

    A budget goes first when both are given. Where predictions don't pay, only labels are bought.
    """
    if budget is None and effective_n is None:
        raise ValueError("budget or effective_n must be given")
    if not -1 < correlation < 1:
        raise ValueError("the correlation must be between -1 and 1")
    costs, r = Costs(cost_x, cost_y, cost_yhat), correlation**2
    each = rectified_cost(correlation, costs)
    size = budget / each if budget is not None else effective_n
    out = best_pair(size, correlation, costs)
    if costs.classical < each or out.n_unlabeled < 0:
        out = labels_only(round(size if budget is None else budget / costs.classical), correlation, costs)
    if n_max is None or out.n + out.n_unlabeled <= n_max:
        return out
    if budget is not None:
        if n_max * costs.classical <= budget:
            return labels_only(n_max, correlation, costs)
        n = round(budget / cost_y - n_max * costs.ratio)
    else:
        if effective_n > n_max:
            warnings.warn("effective_n can't be reached with n_max rows; all of them are labelled", stacklevel=2)
            return labels_only(n_max, correlation, costs)
        n = round(size * n_max * (1 - r) / (n_max - r * size))
    return Plan(n, n_max - n, costs.of(n, n_max - n), round(effective_size(n, n_max - n, correlation)), correlation)


def as_frame(spark: SparkSession, *plans: Plan) -> DataFrame:
    return spark.createDataFrame([(int(p.n), int(p.n_unlabeled), float(p.cost), int(p.effective_n), float(p.correlation)) for p in plans], SCHEMA)


def mean_correlation(df: DataFrame, y, yhat, w=None) -> float:
    """Of w (y - mean) with w (yhat - mean) over labelled rows, at most 1 - 1 / n; the means are those of y."""
    yy, f = column(y).cast("double"), column(yhat).cast("double")
    t = df.where(yy.isNotNull())
    weight = column(w).cast("double") if w is not None else F.lit(1.0)
    centre = t.agg((F.sum(weight * yy) / F.sum(weight)).alias("m"))
    g, h = weight * (yy - F.col("m")), weight * (f - F.col("m"))
    r = t.crossJoin(F.broadcast(centre)).agg(F.corr(g, h), F.count(F.lit(1))).first()
    return min(r[0], 1 - 1 / r[1])


def mean_power(df: DataFrame, y, yhat, cost_y, cost_yhat, budget=None, effective_n=None, n_max=None, w=None) -> DataFrame:
    return as_frame(df.sparkSession, plan(mean_correlation(df, y, yhat, w), 0, cost_y, cost_yhat, budget, effective_n, n_max))


def ols_power(df: DataFrame, x, y, yhat, cost_x, cost_y, cost_yhat, coord, budget=None, effective_n=None, n_max=None, w=None) -> DataFrame:
    return as_frame(df.sparkSession, plan(ols_correlation(df, x, y, yhat, coord, w), cost_x, cost_y, cost_yhat, budget, effective_n, n_max))


def glm_power(df: DataFrame, family, x, y, yhat, cost_x, cost_y, cost_yhat, coord, budget=None, effective_n=None, n_max=None, w=None) -> DataFrame:
    return as_frame(df.sparkSession, plan(glm_correlation(df, family, x, y, yhat, coord, w), cost_x, cost_y, cost_yhat, budget, effective_n, n_max))


def size_for_effect(effect: float, sd: float, power: float = 0.8, alpha: float = 0.05) -> int:
    """The labels with which a two-sided z-test finds an effect with this power."""
    z = NormalDist().inv_cdf(1 - alpha / 2)
    phi = NormalDist().cdf
    reach = bisect(lambda t: phi(t - z) + phi(-t - z) - power, 0.0, 50.0)
    return math.ceil((reach * sd / effect) ** 2)
