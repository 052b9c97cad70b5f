"""Reading named tables, and the prediction problems that the registered queries are about."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A named dataset of a folder."""
    if name not in TABLES:
        raise NotImplementedError(f"no dataset {name!r}; there are {', '.join(TABLES)}")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, lang, source, n_chars, quality, toxic, yhat, lx, w): every document, its labels or null, and how varied its words are."""
    words = F.split("text", " ")
    docs = load(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars", (F.size(F.array_distinct(words)) / F.size(words)).alias("yhat"))
    labels = load(spark, folder, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return docs.join(labels, "doc_id", "left").withColumn("lx", F.log("n_chars") - 7).withColumn("w", 1 + F.col("n_chars") % 3)


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(o, items, price, yhat_items, yhat_price, x, y, z): orders with their lines; every tenth is labelled, with items and price (in 10,000s)."""
    lines = load(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o"))
    out = lines.agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("l_quantity").alias("quantity"), (F.sum("l_extendedprice") / 10000).alias("money"))
    known = F.col("o") % 10 == 0
    return out.select(
        "o", F.when(known, F.col("k")).alias("items"), F.when(known, F.col("money")).alias("price"), (F.col("quantity") / 25.5).alias("yhat_items"), (F.col("quantity") * 0.148).alias("yhat_price"), (F.col("quantity") / 100).alias("x"), F.col("k").alias("count"), F.col("money")
    )
