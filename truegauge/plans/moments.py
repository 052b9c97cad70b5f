"""Sums of vectors that NumPy makes of batches of rows: one row for each task and group, then one for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups that a task holds sums of before it gives them away.
HELD = 4096


def matrix(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """The named double columns of a batch, nulls as NaN, a row for each row."""
    return np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names], axis=1) if names else np.zeros((b.num_rows, 0))


def groups_of(b: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """The values of `by` and the rows of each group of a batch; nulls are a value."""
    if not by:
        yield (), np.arange(b.num_rows)
        return
    codes = np.stack([b.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in by], axis=1)
    _, first, group = np.unique(codes, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(group.reshape(-1), kind="stable")
    for at, rows in zip(first, np.split(order, np.cumsum(np.bincount(group.reshape(-1)))[:-1]), strict=True):
        yield tuple(b.column(c)[int(at)].as_py() for c in by), rows


def vector_sums(df: DataFrame, by: list[str], fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(by, v): for each group the sum of fn(rows) over batches; fn takes a matrix of the other columns of df, all double, and gives a vector of fixed length."""
    rest = [c for c in df.columns if c not in by]
    schema = T.StructType([T.StructField(c, df.schema[c].dataType) for c in by] + [T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        kinds = None

        def given() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in total], t) for i, t in enumerate(kinds)]
            out = pa.RecordBatch.from_arrays([*keys, pa.array(list(total.values()), pa.list_(pa.float64()))], names=[*by, "v"])
            total.clear()
            return out

        for b in batches:
            if not b.num_rows:
                continue
            kinds, m = [b.column(c).type for c in by], matrix(b, rest)
            for key, rows in groups_of(b, by):
                v = fn(m[rows] if by else m)
                total[key] = total[key] + v if key in total else v
            if len(total) >= HELD:
                yield given()
        if total:
            yield given()

    each = df.mapInArrow(run, schema).select(*by, F.posexplode("v").alias("_k", "_v"))
    sums = each.groupBy(*by, "_k").agg(F.sum("_v").alias("_v"))
    whole = F.sort_array(F.collect_list(F.struct("_k", "_v")))  # as many as a vector has numbers
    out = sums.groupBy(*by).agg(whole.alias("_all")) if by else sums.agg(whole.alias("_all"))
    return out.select(*by, F.transform("_all", lambda s: s["_v"]).alias("v"))


def joined(df: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Rows of df with the columns of their group's row in other; without groups, other is one row."""
    if not by:
        return df.crossJoin(F.broadcast(other))
    renamed = other.select(*[F.col(b).alias(f"_of_{b}") for b in by], *[c for c in other.columns if c not in by])
    return df.join(renamed, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]).drop(*[f"_of_{b}" for b in by])
