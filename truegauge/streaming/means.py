"""Rectified means of a stream: central moments merge, so a batch adds its own to those kept, and an estimate is due at any time."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of labelled rows: their number, means of y and f, and sums of squares and products about them; of others: number, mean of f and its squares.
STATE = ("n", "y", "f", "yy", "ff", "yf", "big", "u", "uu")


def batch_moments(df: DataFrame, y: str, yhat: str) -> dict[str, float]:
    yy, f = F.col(y).cast("double"), F.col(yhat).cast("double")
    on, off = F.when(yy.isNotNull(), f), F.when(yy.isNull(), f)
    n, big = F.count(yy), F.count(off)
    r = df.agg(n, F.avg(yy), F.avg(on), F.var_pop(yy) * n, F.var_pop(on) * n, F.covar_pop(yy, on) * n, big, F.avg(off), F.var_pop(off) * big).first()
    return {k: float(v or 0.0) for k, v in zip(STATE, r, strict=True)}


def merged(a: dict[str, float], b: dict[str, float]) -> dict[str, float]:
    """The moments of two sets of rows together."""
    out = {}
    for size, means, squares in (("n", ("y", "f"), ("yy", "ff", "yf")), ("big", ("u",), ("uu",))):
        out[size] = n = a[size] + b[size]
        apart = {m: b[m] - a[m] for m in means}
        for m in means:
            out[m] = a[m] + apart[m] * b[size] / n if n else 0.0
        for s in squares:
            out[s] = a[s] + b[s] + (apart[s[0]] * apart[s[1]] * a[size] * b[size] / n if n else 0.0)
    return out


class StreamingMean:
    """Use `update` in writeStream.foreachBatch; a batch that comes again (after a failure) is not counted twice.

    With a folder, the state is written there after each batch, and a new StreamingMean goes on from the last.
    """

    def __init__(self, y: str, yhat: str, spark: SparkSession | None = None, folder: str | None = None):
        self.y, self.yhat, self.folder, self.last = y, yhat, folder, -1
        self.total = dict.fromkeys(STATE, 0.0)
        if folder is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
            whole = [p for p in (fs.listStatus(path) if fs.exists(path) else []) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p.getPath(), "_SUCCESS"))]
            if whole:
                self.last = max(int(p.getPath().getName().split("-")[1]) for p in whole)
                self.total = json.loads(spark.read.text(f"{folder}/batch-{self.last}").first()[0])

    def update(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        self.total, self.last = merged(self.total, batch_moments(batch, self.y, self.yhat)), batch_id
        if self.folder is not None:
            batch.sparkSession.createDataFrame([(json.dumps(self.total),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/batch-{batch_id}")

    def estimate(self) -> tuple[float, float, float]:
        """(estimate, standard error, weight of predictions), the weight tuned and clipped."""
        t = self.total
        n, big = t["n"], t["big"]
        vy, vf, cov = (t[k] / n for k in ("yy", "ff", "yf"))
        if not big:
            return t["y"], math.sqrt(vy / n), 0.0
        vu, every = t["uu"] / big, n + big
        pooled = (t["ff"] + t["uu"] + n * big / every * (t["f"] - t["u"]) ** 2) / (every - 1)
        lam = min(1.0, max(0.0, cov / ((1 + n / big) * pooled))) if pooled > 0 else 0.0
        return lam * t["u"] + t["y"] - lam * t["f"], math.sqrt(max(lam * lam * vu / big + (vy + lam * lam * vf - 2 * lam * cov) / n, 0.0)), lam
