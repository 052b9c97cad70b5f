"""Running sums over a whole ordered table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import stored


def running(df: DataFrame, order: str, columns: list[str], by: list[str]) -> DataFrame:
    """df with each of columns replaced by its running sum in `order`, ties together, within `by`.

    Ranges of the order are summed on their own; what came before a range is a sum over as many rows as there are
    ranges and groups. Equal values of `order` must be one row of a group. The ranges are written before they are
    read twice, so that a lost executor can't have them dealt anew.
    """
    parts = stored(df.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*by, "_part").agg(*[F.sum(c).alias(c) for c in columns])
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    start = sums.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("_part").alias("_before_part"), *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(f"_{c}") for c in columns])
    upto = W.partitionBy(*by, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = parts.select(*by, order, "_part", *[F.sum(c).over(upto).alias(c) for c in columns])
    on = [F.col("_part") == F.col("_before_part"), *[F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]]
    return inner.join(start, on).select(*by, order, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in columns])


def ranks(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df, stored, with _rank: the place of a row, from 0, in `order` among those of `by`; ties stand as they were read."""
    mid = F.monotonically_increasing_id()
    parts = df.repartitionByRange(*by, order).sortWithinPartitions(*by, order).withColumn("_mid", mid)
    parts = stored(parts.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid"), "ranks")
    begin = parts.groupBy(*by, "_part").agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    begin = begin.select(*[F.col(b).alias(f"_of_{b}") for b in by], F.col("_part").alias("_of_part"), "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = [F.col("_part") == F.col("_of_part"), *[F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]]
    return parts.join(begin, on).select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_lo")).alias("_rank"))
