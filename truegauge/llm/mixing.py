"""Mixing sources to target weights by temperature.

With p the sources' shares of all tokens, weights are p ** t over their sum: t = 1 is the natural mixture, t = 0
gives all sources the same. t is bisected to the smallest that keeps within a repetition limit, or to the largest
that reaches an entropy. A budget of tokens then gives each source so many epochs: whole ones repeat every document,
and the last, broken one takes blocks of a seeded permutation until the source's budget is used up.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, discard, documents, free_of, hash60, stored

MAX_EPOCHS = 4.0
SEED = 8191
#: Rows in a block of a source's permutation, on average, and the most blocks of a source; beyond, blocks are larger.
BLOCK_ROWS, MOST_BLOCKS = 1000, 1 << 16
#: Halvings of the exponent's range in one job, and jobs.
HALVINGS, JOBS = 5, 6
#: Up to so many sources, their table goes to all executors; beyond, documents are joined to it by source.
SENT_SOURCES = 100_000


class Mixture(NamedTuple):
    """exponent; budget: tokens in all; sources: a stored table (source, tokens, rows, weight, epochs)."""

    exponent: float
    budget: float
    sources: DataFrame


def n_tokens() -> Column:
    """Words of the text, but at least one token for every document."""
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), f"[{SPACE}]+"), ""))
    return F.greatest(words, F.lit(1)).cast("long")


def place(docs: DataFrame, *salts) -> Column:
    """A seeded hash of a row's doc_id and text; with it rows stand in a permutation."""
    return hash60(*salts, "doc_id", *(["text"] if "text" in docs.columns else []))


def mixture(rows: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: float | None = None) -> Mixture:
    """The mixture of rows (source, n_tokens).

    entropy (nats), if given, is reached if it can be; else no source may come more than max_epochs times. Without a
    budget it is the least that leaves no document out: every source comes once at least.
    """
    sources = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    sources = stored(sources, "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    p = F.col("tokens") / float(total)

    def told(exponents: list[float]) -> list[tuple[float, float, float]]:
        """For each exponent: the sum of p ** t, the entropy, and the most epochs of a source."""
        aggregates = []
        for k, t in enumerate(exponents):
            x = F.pow(p, F.lit(t))
            aggregates += [F.sum(x).alias(f"z{k}"), F.sum(x * t * F.log(p)).alias(f"e{k}"), F.max(x / F.col("tokens")).alias(f"hi{k}"), F.min(x / F.col("tokens")).alias(f"lo{k}")]
        r = sources.agg(*aggregates).first()
        out = []
        for k in range(len(exponents)):
            z, e, hi, lo = (r[f"{c}{k}"] or 1.0 for c in ("z", "e", "hi", "lo"))
            out.append((z, math.log(z) - e / z, hi / lo if budget is None else budget * hi / z))
        return out

    def tempered(z: float, h: float, epochs: float) -> bool:
        """Whether the exponent may be lower still (for epochs), or must be (for entropy)."""
        return h < entropy if entropy is not None else epochs <= max_epochs * (1 + 1e-12)

    low, high = 0.0, 1.0  # the exponent: at high it is certainly large enough for epochs; for entropy too large or just right
    for _ in range(JOBS):
        grid = [low + (high - low) * k / 2**HALVINGS for k in range(2**HALVINGS + 1)]
        seen = [tempered(*x) for x in told(grid)]
        a, b = 0, len(grid) - 1
        while b - a > 1:  # bisection over what this job has computed
            mid = (a + b) // 2
            a, b = (a, mid) if seen[mid] else (mid, b)
        if seen[0]:
            a = b = 0
        low, high = grid[a], grid[b]
        if low == high:
            break
    t = high if entropy is None else low
    (z, _, _), = told([t])
    x = F.pow(p, F.lit(t))
    if budget is None:
        budget = sources.agg(F.max(F.col("tokens") * z / x)).first()[0] or 0.0
    weight = x / z
    epochs = F.lit(budget) * weight / F.col("tokens")
    epochs = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
    return Mixture(t, budget, sources.select("source", "tokens", "rows", weight.alias("weight"), epochs.alias("epochs")))


def mixed(docs: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """docs, each row as often as the mixture repeats it, with n_tokens, epoch (from 0), block and order: sorted by these two, an epoch of a source is a permutation.

    Tokens are words here. Null sources are a source of their own; a null text counts one token. The permutation goes
    by seeded hashes of doc_id and text, null ones included; rows alike in both tie, and share their fate in the broken
    epoch, which never goes over its budget. Repeated rows are rows like others; an empty table gives no rows. Columns
    of docs that clash with the new names are left out.
    """
    rest = free_of(docs, "n_tokens", "epoch", "block", "order", "_h", "_whole", "_blocks", "_cut", "_cut_h", "_n")
    h = place(docs, F.lit(seed))
    rows = stored(docs.select("source", n_tokens().alias("n_tokens"), h.alias("h")), "tokens")
    mix = mixture(rows, max_epochs, entropy, budget)
    whole = F.floor("epochs")
    sources = stored(mix.sources.select("source", whole.cast("int").alias("_whole"), F.floor((F.col("epochs") - whole) * F.col("tokens")).alias("left"), F.least(F.ceil(F.col("rows") / BLOCK_ROWS), F.lit(MOST_BLOCKS)).alias("_blocks")), "epochs")
    sent = F.broadcast if sources.count() <= SENT_SOURCES else lambda x: x
    same = lambda a, b, *more: F.expr(" AND ".join(f"{a}.{c} <=> {b}.{c}" for c in ("source", *more)))
    dealt = rows.alias("r").join(sent(sources).alias("s"), same("r", "s")).select("r.source", "n_tokens", "h", F.pmod("h", "_blocks").alias("block"), "left")
    blocks = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.first("left").alias("left"))
    upto = F.sum("n").over(W.partitionBy("source").orderBy("block"))
    cut = blocks.withColumn("upto", upto).where("upto > left").groupBy("source").agg(F.min(F.struct("block", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))).alias("cut"))
    cut = stored(cut.select("source", F.col("cut.block").alias("_cut"), F.col("cut.left").alias("rest")), "cuts")  # every source has one: left is below its tokens
    some = dealt.drop("left").alias("r").join(sent(cut).alias("c"), F.expr("r.source <=> c.source AND r.block = c._cut")).groupBy("r.source", "h").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    taken = some.withColumn("upto", F.sum("n").over(W.partitionBy("source").orderBy("h"))).where("upto <= rest").groupBy("source").agg(F.max("h").alias("_cut_h"))
    plan = sources.alias("s").join(cut.alias("c"), same("s", "c")).select("s.source", "_whole", "_blocks", "_cut")
    plan = plan.alias("s").join(taken.alias("t"), same("s", "t"), "left").select(F.col("s.source").alias("_source"), "_whole", "_blocks", "_cut", "_cut_h")
    plan = stored(plan, "plan")
    discard(rows)
    out = docs.select(*rest).withColumn("_h", h).withColumn("_n", n_tokens() if "text" in docs.columns else F.lit(1)).join(sent(plan), F.expr("source <=> _source"))
    block = F.pmod("_h", "_blocks").cast("int")
    broken = (block < F.col("_cut")) | ((block == F.col("_cut")) & (F.col("_h") <= F.coalesce("_cut_h", F.lit(-1))))
    copies = F.col("_whole") + F.when(broken, 1).otherwise(0)
    out = out.withColumn("epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    # the broken epoch, a source's last, takes blocks in order; whole epochs are dealt anew
    order = F.when(F.col("epoch") < F.col("_whole"), hash60(F.lit(seed), "epoch", "_h")).otherwise(F.col("_h"))
    out = out.withColumn("order", order)
    return out.select(*rest, F.col("_n").alias("n_tokens"), "epoch", F.pmod("order", "_blocks").cast("int").alias("block"), "order")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text")


OP7_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, greatest(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')), 1)::BIGINT AS n_tokens,
         ('0x' || md5(concat_ws(':', '{SEED}', doc_id::VARCHAR, text))[1:15])::BIGINT AS h FROM documents
), p AS (
  SELECT source, tokens, n, tokens / sum(tokens) OVER () AS p FROM (SELECT source, sum(n_tokens)::DOUBLE AS tokens, count(*) AS n FROM docs GROUP BY source)
), l AS (
  SELECT list(struct_pack(p := p, tokens := tokens)) AS l FROM p
), t(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, (CASE WHEN max(tokens) / min(tokens) <= {MAX_EPOCHS} * (1 + 1e-12) THEN 0 ELSE 1 END)::DOUBLE FROM p
  UNION ALL SELECT i + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END FROM (
    SELECT i, lo, hi, m, list_max(list_transform(l, lambda s: pow(s.p, m) / s.tokens)) / list_min(list_transform(l, lambda s: pow(s.p, m) / s.tokens)) <= {MAX_EPOCHS} * (1 + 1e-12) AS ok
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m FROM t WHERE i < {HALVINGS * JOBS}), l)
), x AS (
  SELECT p.*, pow(p, hi) AS x FROM p, t WHERE i = {HALVINGS * JOBS}
), z AS (
  SELECT *, sum(x) OVER () AS z FROM x
), e AS (
  SELECT source, tokens, n, max(tokens * z / x) OVER () * (x / z) / tokens AS e FROM z
), w AS (
  SELECT source, floor(e)::INTEGER AS whole, floor((e - floor(e)) * tokens) AS rest, least(ceil(n / {BLOCK_ROWS}.0), {MOST_BLOCKS})::BIGINT AS blocks
  FROM (SELECT source, tokens, n, CASE WHEN abs(e - round(e)) < 1e-9 THEN round(e) ELSE e END AS e FROM e)
), dealt AS (
  SELECT d.*, whole, rest, blocks, h % blocks AS block FROM docs d JOIN w ON d.source IS NOT DISTINCT FROM w.source
), upto AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY block) AS upto FROM (SELECT source, block, sum(n_tokens) AS n, max(rest) AS rest FROM dealt GROUP BY source, block)
), cut AS (
  SELECT source, min(block) AS cut, arg_min(rest - upto + n, block) AS spare FROM upto WHERE upto > rest GROUP BY source
), taken AS (
  SELECT source, max(h) AS last FROM (
    SELECT source, h, spare, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM (
      SELECT d.source, h, sum(n_tokens) AS n, max(spare) AS spare FROM dealt d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source AND block = cut GROUP BY d.source, h)
  ) WHERE upto <= spare GROUP BY source
), copies AS (
  SELECT d.*, whole + (block < cut OR block = cut AND h <= coalesce(last, -1))::INTEGER AS copies FROM dealt d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source LEFT JOIN taken k ON d.source IS NOT DISTINCT FROM k.source
), out AS (
  SELECT *, CASE WHEN epoch < whole THEN ('0x' || md5(concat_ws(':', '{SEED}', epoch::VARCHAR, h::VARCHAR))[1:15])::BIGINT ELSE h END AS place FROM copies, unnest(range(copies)) u(epoch)
)
SELECT doc_id, source, n_tokens, epoch::INTEGER AS epoch, (place % blocks)::INTEGER AS block, place AS "order" FROM out
"""
