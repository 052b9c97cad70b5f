"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, free_of

WINDOW = 8
#: Common words of the languages at hand, lower case.
STOP_WORDS = {
    "en": "the be to of and that have with is in it was for on are as at this by from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "es": "de la que el en y a los del se las por un para con no una su al lo es",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur",
}


class Rule(NamedTuple):
    """A document fails if the metric is below `least` or above `most`; a null bound doesn't bind. The metric is SQL over the base columns."""

    name: str
    metric: str
    least: float | None = None
    most: float | None = None


#: The production table. Ratios are to words, to lines with a word, or to characters in words.
RULES = (
    Rule("word_length", "word_chars / n_words", 2.0, 15.0),
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("shouting", "n_marks / n_words", None, 0.3),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
    Rule("repeated_lines", "n_dup_lines / n_lines", None, 0.4),
)

#: The same for documents with a column lang: the stop-word rule binds only where the language has a list.
LISTED = f"substring_index(lower(replace(lang, '_', '-')), '-', 1) IN ({', '.join(map(repr, STOP_WORDS))})"
RULES_BY_LANG = tuple(r._replace(metric=f"CASE WHEN {LISTED} THEN {r.metric} END") if r.name == "stop_words" else r for r in RULES)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def n_of(text: Column, chars: str) -> Column:
    """How many characters of text are among these ASCII ones."""
    rest = text
    for c in chars:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def base_columns(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with what the rules and the contract count; n_repeat_words is the words in windows that the text holds
    twice or more (windows of a power of two words), told apart by 64-bit hashes sorted with their places: a text of n words costs n log n."""
    rest = free_of(docs, "text", *BASE, "n_lines", "n_marks", "n_stop_words", "failed_rules")
    text = F.coalesce("text", F.lit(""))
    one = docs.select(*rest, "text", F.array_remove(F.split(text, f"[{SPACE}]+"), "").alias("_words"), F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "").alias("_lines"), text.alias("_text"))
    two = one.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    # the hash of a window of 2 k words is that of its halves' hashes; near the end halves are missing, which is cut off below
    width = 1
    while width < window:
        half = F.slice("_hashes", width + 1, F.greatest(F.size("_hashes") - width, F.lit(0)))
        two, width = two.withColumn("_hashes", F.zip_with("_hashes", half, lambda a, b: F.xxhash64(a, b))), 2 * width
    three = two.withColumn("_windows", F.slice("_hashes", 1, F.greatest(F.size("_hashes") - window + 1, F.lit(0))))
    # most texts repeat nothing, which the number of distinct windows tells at once
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    four = three.withColumn("_order", F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: ((i > 0) & (F.get("_order", i - 1)["h"] == x["h"])) | F.coalesce(F.get("_order", i + 1)["h"] == x["h"], F.lit(False))
    five = four.withColumn("_at", F.sort_array(F.transform(F.filter("_order", same), lambda x: x["i"])))
    last = F.get("_at", F.size("_at") - 1)
    covered = F.aggregate(F.slice("_at", 2, F.greatest(F.size("_at") - 1, F.lit(0))), F.struct(F.get("_at", F.lit(0)).alias("p"), F.lit(0).alias("n")), lambda s, x: F.struct(x.alias("p"), (s.n + F.least(x - s.p, F.lit(window))).alias("n"))).n + window
    text, stop = F.col("_text"), sorted({w for v in STOP_WORDS.values() for w in v.split()})
    return five.select(
        *rest,
        "text",
        # a part that Spark can't move keeps it from copying these expressions into filters, where they would be computed over and over
        (F.size("_words") + F.least(F.spark_partition_id(), F.lit(0))).cast("long").alias("n_words"),
        (F.length(text) - n_of(text, SPACE)).cast("long").alias("word_chars"),
        n_of(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(last.isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").alias("n_lines"),
        n_of(text, "!?").alias("n_marks"),
        F.size(F.filter("_words", lambda w: w.isin(*stop))).alias("n_stop_words"),
    )


def compiled(rules=RULES) -> Column:
    """The names of the rules that a row fails, in the table's order."""
    out = []
    for r in rules:
        bounds = [f"{r.metric} < {r.least}" for _ in (1,) if r.least is not None] + [f"{r.metric} > {r.most}" for _ in (1,) if r.most is not None]
        out.append(F.expr(f"CASE WHEN {' OR '.join(bounds)} THEN '{r.name}' END"))
    return F.array_compact(F.array(*out))


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs with the base columns, failed_rules, base_failed and kept; every row stays.

    A null text has no words, and so fails the base. Rows are judged each on its own, whatever repeats; columns of
    docs that clash with the new names are left out.
    """
    base = base_columns(docs)
    failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    out = base.withColumn("base_failed", failed).withColumn("failed_rules", F.when(F.col("n_words") > 0, compiled(rules)).otherwise(F.array().cast("array<string>")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *BASE)


def _verdict_sql() -> str:
    out = []
    for r in RULES:
        metric = r.metric.replace(" / ", "::DOUBLE / ")
        out += [f"{metric} >= {r.least}"] * (r.least is not None) + [f"{metric} <= {r.most}"] * (r.most is not None)
    return " AND ".join(out)


_STOP = ", ".join(f"'{w}'" for w in sorted({w for v in STOP_WORDS.values() for w in v.split()}))
_COUNT = "(length(t) - length(regexp_replace(t, '{}', '', 'g')))"

OP2_SQL = rf"""
WITH a AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),  lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), win AS (
  SELECT doc_id, r.i AS i, w[r.i:r.i + {WINDOW - 1}] AS g FROM a, unnest(range(1, len(w) - {WINDOW - 2})) AS r(i) WHERE len(w) >= {WINDOW}
), twice AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win
), gap AS (
  SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS n FROM twice WHERE n > 1
), rep AS (
  SELECT doc_id, sum(n) AS n FROM gap GROUP BY doc_id
), base AS (
  SELECT a.doc_id, len(w)::BIGINT AS n_words, (length(t) - {_COUNT.format(r'[\x20\x09-\x0D]')})::BIGINT AS word_chars, {_COUNT.format('[#*$%&|<>]')}::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         {_COUNT.format('[!?]')} AS n_marks, len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop_words
  FROM a LEFT JOIN rep ON a.doc_id = rep.doc_id
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ({_verdict_sql()}) AS kept FROM failed
"""
