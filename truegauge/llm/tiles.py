"""Pairs of a table's rows in bounded tasks: rows are in blocks, and every pair of blocks is a tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tiled(rows: DataFrame, others: Column | None = None) -> DataFrame:
    """rows (with block) once for each tile that holds them: lo and hi name the tile, and block tells the side.

    A row meets the blocks in the array `others`; without it, all below its column blocks.
    """
    met = F.sequence(F.lit(0), F.col("blocks") - 1) if others is None else others
    return rows.withColumn("_other", F.explode(met)).withColumn("lo", F.least("block", "_other")).withColumn("hi", F.greatest("block", "_other")).drop("_other")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the pairs a, b connect it with."""
    name = np.arange(n)
    while True:
        new = name.copy()
        np.minimum.at(new, a, name[b])
        np.minimum.at(new, b, name[a])
        np.minimum.at(new, name, new)  # also for those that had the same name
        while (new[new] != new).any():
            new = new[new]
        if (new == name).all():
            return name
        name = new
