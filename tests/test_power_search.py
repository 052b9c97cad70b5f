"""The search for a sample size gives the size itself, not one of a few given ones."""

import numpy as np
from pyspark.sql import functions as F

from truegauge.operators.experiment import rejection_search, trial_grid


def test_search_ends_where_power_is_reached(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(0.3, 1, 300)
    df = spark.createDataFrame([(i, float(a), float(a + e)) for i, (a, e) in enumerate(zip(y, rng.normal(0, 0.8, 300)))], "id long, y double, yhat double")
    for sizes in ([25, 200], [10]):
        got = {r.method: r.n for r in rejection_search(df, "y", "yhat", "id", 0.0, 0.8, sizes, 20).collect()}
        tried = [n + d for n in got.values() for d in (-1, 0)]
        t = trial_grid(df, "y", "yhat", "id", sorted(set(tried)), 20)
        rate = {(r.method, r.n): r.rate for r in t.groupBy("method", "n").agg(F.avg(((F.col("lower") > 0) | (F.col("upper") < 0)).cast("double")).alias("rate")).collect()}
        for method, n in got.items():
            assert 10 < n < 298 and n not in (25, 200) and rate[method, n] >= 0.8 > rate[method, n - 1]
    assert all(r.n is None for r in rejection_search(df, "y", "yhat", "id", 0.3, 1.01, [25], 5).collect())
