"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; the row of rank r of n gets the fraction
(r + 1/2) / n. Sorted by fraction, every stretch of rows holds the sources in the proportion of the whole, so
equal stretches make shards that match the mixture, with counts at most one apart (the law `rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, documents, free_of, hash60, row_ids, stored

SEED = 20240607


def starts(table: DataFrame, *by: str) -> DataFrame:
    """For each part (and group of `by`) of a table of row_ids(): _lo, its first place, and _before, the rows of the group in earlier parts."""
    n = table.groupBy("_part", *by).agg(F.min("_at").alias("_lo"), F.count(F.lit(1)).alias("_rows"))
    w = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    return n.withColumn("_before", F.coalesce(F.sum("_rows").over(w), F.lit(0)))


def interleave(docs: DataFrame, n_shards: int = 40, seed: int = SEED) -> DataFrame:
    """docs with size, text_crc32, shard and slot; text is left out.

    size is the text's UTF-8 bytes (null: none) plus 16, text_crc32 that of the text (null: of nothing). Rows with a
    null source are a source of their own, and null doc_ids tie. Any row counts, also a repeated one; ties of the
    shuffle go by doc_id and checksum, and between equal rows by place of reading. An empty table gives no rows.
    Columns of docs that clash with the new names are left out.
    """
    rest = free_of(docs, "text", "size", "text_crc32", "shard", "slot", "_h", "_tie", "_mid", "_part", "_at", "_frac", "_place")
    rows = docs.select(*rest, (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"))
    rows = rows.withColumn("_tie", F.monotonically_increasing_id()).withColumn("_h", hash60(F.lit(seed), "doc_id"))
    order = ["_h", F.col("doc_id"), "text_crc32", "_tie"]
    ranked = stored(row_ids(rows, "source", *order), "ranked")
    begin = starts(ranked, "source")
    total = begin.groupBy("source").agg(F.sum("_rows").alias("_n"))
    begin = begin.alias("b").join(total.alias("t"), F.expr("b.source <=> t.source")).select("b.source", "_part", "_lo", "_before", "_n")
    both = ranked.alias("r").join(begin.alias("b"), F.expr("r._part = b._part AND r.source <=> b.source"))
    frac = (2 * (F.col("_before") + F.col("_at") - F.col("_lo")) + 1) / (2 * F.col("_n"))
    spread = stored(row_ids(both.select(*[F.col(f"r.{c}") for c in [*rest, "size", "text_crc32", "_h", "_tie"]], frac.alias("_frac")), "_frac", *order), "spread")
    discard(ranked)
    begin = starts(spread.select("_part", "_at"))
    n = spread.count()
    place = F.col("_before") + F.col("_at") - F.col("_lo")
    out = spread.join(begin.drop("_rows"), "_part").withColumn("_place", place).withColumn("shard", F.expr(f"(_place * {n_shards}) div {max(n, 1)}").cast("int"))
    first = F.expr(f"-((-(shard * {n}L)) div {n_shards}) + CASE WHEN (shard * {n}L) % {n_shards} > 0 THEN 1 ELSE 0 END")
    return out.withColumn("slot", F.col("_place") - first).select(*rest, "size", "text_crc32", "shard", "slot")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


#: The checksum goes byte by byte through the table that its polynomial gives.
OP9_SQL = rf"""
WITH c AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda a, x: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY i) AS c FROM range(256) r(i)
), d AS (
  SELECT doc_id, source, (coalesce(strlen(text), 0) + 16)::BIGINT AS size, ('0x' || md5(concat_ws(':', '{SEED}', doc_id::VARCHAR))[1:15])::BIGINT AS h,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda z: ('0x' || z)::BIGINT)), lambda a, x: xor(a >> 8, c[(xor(a, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32
  FROM documents, c
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1)::DOUBLE / (2 * n), h, doc_id, text_crc32) - 1 AS place, count(*) OVER () AS every FROM r
), s AS (
  SELECT *, (place * 40) // every AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard, source FROM s
"""
