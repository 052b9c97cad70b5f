"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from truegauge.llm.common import SPACE, stored, without_ids
from truegauge.llm.line_dedup import dedup_lines
from truegauge.llm.mixing import mixed
from truegauge.llm.ngram_join import ngram_join
from truegauge.llm.packing import pack
from truegauge.llm.quality_rules import RULES_BY_LANG, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates, unless a contract says otherwise: shingles of five words, similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: No source comes more often than this; every document comes once at least.
MAX_EPOCHS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; a null text is rejected, as it has no words.

    Stop words are asked for only in languages that have a list of them (en, de, es, fr).
    """
    return quality(docs.select(*COLUMNS), RULES_BY_LANG).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds go, and so do documents of which no word is left; n_chars follows the text."""
    out = dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_dropped") == 0) | (F.btrim("kept", F.lit(SPACE)) != "")
    return out.where(left).select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; rows of one doc_id are one document, a null doc_id stays."""
    docs = docs.select(*COLUMNS)
    classes = ngram_join(docs.select("doc_id", "text"), NEAR_WORDS, NEAR_PERCENT)
    copies = stored(classes.where("component_id < doc_id").select("doc_id").distinct(), "copies")
    return without_ids(docs, copies)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the temperature mixture repeats their source, never fewer than once."""
    return mixed(docs.select(*COLUMNS), max_epochs=MAX_EPOCHS).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_documents", pack_documents),
]

#: Tokenization isn't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
