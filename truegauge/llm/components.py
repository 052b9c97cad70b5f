"""Connected components by contraction with pointer jumping, all of it in distributed tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .tiles import roots

#: So few edges (8 MB) are finished by one task.
FEW_EDGES = 1 << 19


def contracted(left: DataFrame, salt: int) -> DataFrame:
    """(name, low) of the ends of edges: each points at the first of itself and its neighbours in a salted hash order, and pointers are doubled until they reach their roots."""
    place = lambda c: F.struct(F.xxhash64(F.lit(salt), c), F.col(c).alias("v"))
    both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(place("b")).alias("m"))
    low: Column = F.least(place("a"), F.col("m")).v
    at = stored(first.select(F.col("a").alias("name"), low.alias("low"), F.lit(True).alias("moved")), "low")
    while True:
        to = at.select(F.col("name").alias("via"), F.col("low").alias("next"))
        new = at.join(to, F.col("low") == F.col("via")).select("name", F.col("next").alias("low"), (F.col("next") != F.col("low")).alias("moved"))
        new = stored(new, "low")
        discard(at)
        at = new
        if at.where("moved").isEmpty():
            return at


def finished(left: DataFrame) -> DataFrame:
    """(name, low) of a bounded number of edges, by one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = pd.concat([pd.DataFrame({"a": [], "b": []}, dtype=np.int64), *batches])
        name, place = np.unique(edges[["a", "b"]].to_numpy(dtype=np.int64), return_inverse=True)
        a, b = place.reshape(-1, 2).T
        yield pd.DataFrame({"name": name, "low": name[roots(len(name), a, b)]})

    return left.coalesce(1).mapInPandas(run, "name long, low long")


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node reachable.

    In a round every node points at the first of itself and its neighbours, in an order that a salted hash draws anew,
    pointers are followed to their ends by doubling, and edges are renamed. In a random order at most half of the nodes
    are their own first, so rounds grow with the logarithm of the number of nodes, whatever the names and the shape;
    tables are written between rounds. Once at most `few` edges are left, one task finishes them.
    Self loops, repeated edges and nulls are harmless; an edge with a null end is ignored; no edges give no rows.
    """
    clean = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL")
    clean = stored(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = clean.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("name"))
    left, salt, made = clean.where("a <> b"), 0, []
    while n := left.count():
        low = contracted(left, salt) if n > few else finished(left)
        if n > few:
            ends = left.join(low.select(F.col("name").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("name").alias("b"), F.col("low").alias("lb")), "b")
            left = stored(ends.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
            made.append(left)
        nodes = stored(nodes.join(low.select("name", "low"), "name", "left").select("node", F.coalesce("low", "name").alias("name")), "names")
        made.append(nodes)
        salt += 1
        if n <= few:
            break
    first = nodes.groupBy("name").agg(F.min("node").alias("component"))
    out = stored(nodes.join(first, "name").select("node", "component"), "parts")
    discard(clean, *made)
    return out
