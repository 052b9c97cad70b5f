"""Embedding near-dedup by int8 tile products with rigorous bounds.

A unit vector u is held as codes q (int8) and a scale s, with the exact length e of u - s q. For two of them,
u.v differs from s s' q.q' by at most e + e' + e e', whatever the vectors; so only pairs whose code product comes
within that of the threshold can reach it, and those are computed again in double precision.

Tiles that can't hold a link are left out. Every vector has the cell of its nearest pivot, and blocks are cut from the
vectors in order of cells. If y is nearer to the pivot q than to x's own p, then x's angle to the plane between p and q
is a lower bound of that between x and y; so x goes only to the blocks of cells whose plane is within the threshold's
angle. This holds for any vectors and pivots; how much it leaves out depends on how clustered the vectors are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_of, row_ids, stored
from .components import components
from .sharding import starts
from .tiles import roots, tiled

THRESHOLD = 0.9
BLOCK = 4096
#: Rows of a tile that are multiplied at once.
STRIP = 1024
#: Dimensions whose products of codes stay below 2^24.
PART = (1 << 24) // 127**2
#: Over what the float operations on bounds and exact integer products can be off: a few parts in 2^24 of numbers below 4.
SLACK = 2e-6
#: Pivots for each block, and of all at most: with distances, some 16 MB for 1,024 dimensions. More would only leave out more tiles.
PIVOTS, MOST_PIVOTS = 8, 1024
#: What angles to planes between pivots may be off, and pivots nearer to each other than CLOSE have no plane to tell by.
ANGLE_SLACK, CLOSE = 1e-9, 1e-2


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' of int8 codes. Float products of whole numbers are exact below 2^24, so dimensions go in parts that can't reach it, and their sums are rounded once."""
    if a.shape[1] <= PART:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], PART):
        out += a[:, k : k + PART].astype(np.float32) @ b[:, k : k + PART].astype(np.float32).T
    return out.astype(np.float32)


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8, -127..127), scales, and lengths of the errors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes.astype(np.int8), scale, error


def links(left: np.ndarray, right: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of unit vectors with a product of threshold or more; right None: of left with itself, each pair once."""
    other = left if right is None else right
    if not len(left) or not len(other):
        return np.zeros(0, int), np.zeros(0, int)
    a = quantise(left)
    b = a if right is None else quantise(right)
    found = []
    for at in range(0, len(left), STRIP):
        codes, scale, error = (x[at : at + STRIP] for x in a)
        first = at if right is None else 0
        product = exact_products(codes, b[0][first:])
        # s s' q.q' + e' (1 + e) >= threshold - e, divided by s
        product *= b[1][first:].astype(np.float32)
        product += np.multiply.outer(((1 + error) / scale).astype(np.float32), b[2][first:].astype(np.float32))
        i, j = np.divmod(np.flatnonzero(product >= ((threshold - error - SLACK) / scale)[:, None].astype(np.float32)), product.shape[1])
        j = j + first
        if right is None:
            i, j = i[i + at < j], j[i + at < j]
        near = np.concatenate([np.einsum("ij,ij->i", left[at + i[k : k + 100_000]], other[j[k : k + 100_000]]) >= threshold for k in range(0, len(i), 100_000)] or [np.zeros(0, dtype=bool)])
        found.append((at + i[near], j[near]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def units(e: pd.Series) -> np.ndarray:
    x = np.stack(e.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
    return x / np.linalg.norm(x, axis=1)[:, None]


def chained(p: np.ndarray) -> np.ndarray:
    """The rows of p, each followed by the nearest of those left, so that a block with several cells holds near ones."""
    order, left = [0], np.ones(len(p), dtype=bool)
    left[0] = False
    while left.any():
        order.append(int(np.where(left, p @ p[order[-1]], -2).argmax()))
        left[order[-1]] = False
    return p[order]


class Cells:
    """Numbered cells around pivots. A vector is in the cell of the nearest pivot of its dimension; without one, in the last cell."""

    def __init__(self, pivots: pd.Series):
        self.n, self.of = 0, {}
        for dim, e in sorted(pivots.groupby(pivots.map(len)), key=lambda g: g[0]):
            p = chained(units(e))
            apart = np.sqrt(np.maximum(2 - 2 * p @ p.T, 0))
            self.of[dim] = self.n, p, apart
            self.n += len(p)

    def strips(self, e: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Dimensions, places and products with the pivots of at most STRIP vectors of one dimension that has pivots."""
        size = e.map(len).to_numpy()
        for dim in set(size) & set(self.of):
            every = np.flatnonzero(size == dim)
            for k in range(0, len(every), STRIP):
                at = every[k : k + STRIP]
                yield dim, at, units(e.iloc[at]) @ self.of[dim][1].T

    def home(self, e: pd.Series) -> np.ndarray:
        out = np.full(len(e), self.n, dtype=np.int32)
        for dim, at, dots in self.strips(e):
            out[at] = self.of[dim][0] + dots.argmax(axis=1)
        return out

    def reached(self, e: pd.Series, home: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of vectors, and for each a row of flags: the cells that may hold vectors with a cosine of threshold or more."""
        sine = np.sqrt(1 - (threshold - ANGLE_SLACK) ** 2) + ANGLE_SLACK
        for dim, at, dots in self.strips(e):
            first, _, apart = self.of[dim]
            own = home[at] - first
            flags = np.zeros((len(at), self.n + 1), dtype=bool)
            flags[:, first : first + dots.shape[1]] = (dots[np.arange(len(at)), own][:, None] - dots <= sine * apart[own]) | (apart[own] < CLOSE)
            yield at, flags
        last = np.flatnonzero(home == self.n)
        yield last, np.broadcast_to(np.arange(self.n + 1) == self.n, (len(last), self.n + 1))


def in_tiles(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """classes (_k, _l, e, ...) once for each tile in which they may meet a link, with lo, hi and block."""
    spark = classes.sparkSession
    blocks = -(-classes.count() // block) or 1
    cells = Cells(pd.Series([np.array(r.e) for r in classes.orderBy("_k", "_l").select("e").limit(min(PIVOTS * blocks, MOST_PIVOTS)).collect()], dtype=object))
    sent = spark.sparkContext.broadcast(cells)

    @F.pandas_udf("int")
    def home(e: pd.Series) -> pd.Series:
        return pd.Series(sent.value.home(e))

    table = stored(row_ids(classes.withColumn("cell", home("e")), "cell", "_k", "_l"), "cells")
    number = F.col("_before") + F.col("_at") - F.col("_lo")
    placed = table.join(F.broadcast(starts(table.select("_part", "_at"))), "_part").withColumn("block", F.floor(number / block).cast("int")).drop("_part", "_at", "_lo", "_rows", "_before")
    lo, hi = np.zeros((2, cells.n + 1), dtype=np.int64) + [[0], [-1]]
    for r in placed.groupBy("cell").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).collect():
        lo[r.cell], hi[r.cell] = r.lo, r.hi

    @F.pandas_udf("array<int>")
    def others(e: pd.Series, cell: pd.Series) -> pd.Series:
        out, made = np.empty(len(e), dtype=object), {}
        for at, flags in sent.value.reached(e, cell.to_numpy(), threshold):
            for k, f in zip(at, flags, strict=True):
                if (key := f.tobytes()) not in made:
                    size = (hi - lo + 1)[f]
                    every = np.repeat(lo[f] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    made[key] = every[np.diff(every, prepend=-1) > 0].astype(np.int32)  # a block can hold the end of a cell and the next one's start
                out[k] = made[key]
        return pd.Series(out)

    return tiled(placed, others("e", "cell")).drop("cell")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding, ...) without embedding, with n_links, component_id and kept.

    Two rows link when the cosine of their embeddings is threshold (above 0) or more. An embedding that is null,
    empty, zero or holds a null or non-finite component links with nothing, nor does a row with a null vec_id; only
    embeddings of one length link. Equal embeddings are compared once, as one of their number. Every row comes back,
    also a repeated one; columns that clash with the new names are left out; an empty table gives no rows.
    """
    kind = "f4" if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else "f8"
    e = F.col("embedding").cast("array<float>" if kind == "f4" else "array<double>")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rest = free_of(vectors, "embedding", "n_links", "component_id", "kept", "_k", "_l", "_e", "_same", "_links", "_component")
    told = vectors.select(*rest, F.when(F.coalesce(whole, F.lit(False)) & F.col("vec_id").isNotNull(), e).alias("_e"))
    told = told.withColumn("_k", F.when(F.col("_e").isNotNull(), F.xxhash64("_e"))).withColumn("_l", F.when(F.col("_e").isNotNull(), F.xxhash64(F.lit(1), "_e")))
    classes = told.where("_e IS NOT NULL").groupBy("_k", "_l").agg(F.min("vec_id").cast("long").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("_e").alias("e"))
    classes = stored(classes.withColumn("dim", F.size("e")), "classes")

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block", kind="stable")
        unit = units(g.e)
        cut = int((g.block == g.lo.iloc[0]).sum())
        i, j = links(unit, None, threshold) if g.lo.iloc[0] == g.hi.iloc[0] else links(unit[:cut], unit[cut:], threshold)
        if g.lo.iloc[0] != g.hi.iloc[0]:
            j = j + cut
        n, rep = g.n.to_numpy(), g.rep.to_numpy()
        count = np.bincount(i, n[j], len(g)) + np.bincount(j, n[i], len(g))
        root = roots(len(g), i, j)
        hit = count > 0
        return pd.DataFrame({"_k": g._k[hit], "_l": g._l[hit], "rep": rep[hit], "root": rep[root[hit]], "links": count[hit].astype(np.int64)})

    found = in_tiles(classes, threshold, block).groupBy("dim", "lo", "hi").applyInPandas(compare, "_k long, _l long, rep long, root long, links long")
    found = stored(found, "links")
    copies = told.where("_e IS NOT NULL").select("vec_id", "_k", "_l").join(classes.where("n > 1").select("_k", "_l", "rep"), ["_k", "_l"])
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(copies.select("vec_id", "rep")))
    sums = classes.select("_k", "_l", (F.col("n") - 1).alias("_same")).join(found.groupBy("_k", "_l").agg(F.sum("links").alias("_links")), ["_k", "_l"], "left")
    sums = sums.where("_same > 0 OR _links > 0")
    out = told.join(sums, ["_k", "_l"], "left").join(parts.select(F.col("node").alias("vec_id"), F.col("component").alias("_component")), "vec_id", "left")
    component = F.coalesce("_component", F.col("vec_id").cast("long"))
    return out.select(*rest, (F.coalesce("_same", F.lit(0)) + F.coalesce("_links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.9
), r(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
"""
