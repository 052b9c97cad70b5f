"""Quality classifier: an interpolated modified Kneser-Ney model of pairs of words, trained on trusted text.

Words, letters unfolded, are numbered by a hash below WORD_NUMBERS. All pairs of the trusted documents are counted, in
shards by a hash of the pair: these tables grow with the corpus. What belongs to a single word (how many words it
follows, and the mass its context leaves to unseen pairs) is arrays of WORD_NUMBERS numbers, which go to all executors.

With log p(c | b) = w(bc) + log bow(b) + log p(c) for counted pairs, and without w(bc) for others, a text's score falls
into a sum over its words, taken where the text is read, and one over its pairs, which meet the counts shard by shard
and are summed by document. A document's perplexity is over its whole text, and is held against an exact quantile of
the trusted documents of its language that weren't counted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, free_of, has_bit, id_bits, id_slot, mix64, row_ids, short_batches, stored
from .sharding import starts

#: A document may be as perplexing as this quantile of the held-out trusted ones of its language.
QUANTILE = 0.99
#: Runs of letters; digits, marks, line ends, and the letters of scripts without spaces one by one. Nothing is folded.
ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff"
WORDS = re.compile(rf"[^\W\d_{ALONE}]+|[^\s]|\n")
START, END = 0, 1
WORD_BITS = 19
WORD_NUMBERS = 1 << WORD_BITS
#: Words in a chunk of texts, and characters of all texts for each shard; fewer shards than LEAST_SHARDS leave cores idle.
CHUNK, SHARD_CHARS, LEAST_SHARDS = 1 << 21, 1 << 26, 8
#: One in so many trusted documents isn't counted; the limits come from these.
HELD_OUT = 5
#: Up to so many trusted ids (some 30 MB) go to all executors; beyond, the texts that a filter lets pass are joined with them.
SENT_IDS = 1 << 20
#: Per-word counts travel in slices: followed contexts; pairs of it counted 1, 2, 3, 4 times, and oftener than twice; occurrences.
SLICE, STATS = 1 << 13, 7


class _Numbers(dict):
    """Numbers of words, remembered; forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        self[word] = n = 2 + xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % (WORD_NUMBERS - 2)
        return n


_NUMBER = _Numbers()


def numbers(text: str) -> np.ndarray:
    """START, the numbers of the words of text, END."""
    return np.array([START, *map(_NUMBER.__getitem__, WORDS.findall(text)), END], dtype=np.uint64)


def pairs(s: np.ndarray) -> np.ndarray:
    return s[:-1] << np.uint64(WORD_BITS) | s[1:]


def packed(a: np.ndarray) -> bytes:
    """An array, bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def gaps(grams: np.ndarray) -> bytes:
    return packed(np.diff(grams, prepend=np.uint64(0)))


def ungaps(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw, np.uint64), dtype=np.uint64)


def dealt(grams: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each shard that has some, the places of its grams, in order."""
    shard = (mix64(grams) % np.uint64(shards)).astype(np.uint16)
    by = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[by], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(ends)):
        yield int(k), by[ends[k] : ends[k + 1]]


def n_shards(texts: DataFrame) -> int:
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max(LEAST_SHARDS, math.ceil(chars / SHARD_CHARS)), 1 << 16)


class Model(NamedTuple):
    """shards: a stored table (shard, grams, n) of counted pairs; of words: the sum of log p and log bow, p, and the mass that contexts leave; discounts."""

    shards: DataFrame
    n_shards: int
    word: np.ndarray
    p: np.ndarray
    left: np.ndarray
    off: list[float]


def pair_counts(texts: DataFrame, shards: int) -> DataFrame:
    """(shard, grams, n) of texts, plain (text) or compressed (packed): for each chunk of texts and shard its distinct pairs and how often they come."""

    def flush(held: list) -> pa.RecordBatch:
        g, n = np.unique(np.concatenate(held), return_counts=True)
        rows = [(k, gaps(g[at]), packed(n[at].astype(np.uint32))) for k, at in dealt(g, shards)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "grams", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, held, size = zstandard.ZstdDecompressor().decompress, [], 0
        for b in batches:
            for text in b.column(0).to_pylist():
                held.append(pairs(numbers(text if isinstance(text, str) else unpack(text).decode("utf-8", "surrogatepass"))))
                size += len(held[-1])
                if size >= CHUNK:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return short_batches(texts).mapInArrow(run, "shard int, grams binary, n binary")


def merged(counts: DataFrame) -> DataFrame:
    """(shard, grams, n, slice, stats): each shard's pairs with their counts over all chunks; and rows with slices of the per-word counts that they make."""

    def merge(t: pa.Table) -> pa.Table:
        g, place = np.unique(np.concatenate([ungaps(x) for x in t.column("grams").to_pylist()]), return_inverse=True)
        n = np.bincount(place, np.concatenate([unpacked(x, np.uint32) for x in t.column("n").to_pylist()])).astype(np.uint64)
        del place
        b, c = (g >> np.uint64(WORD_BITS)).astype(np.int64), (g & np.uint64(WORD_NUMBERS - 1)).astype(np.int64)
        of = lambda which: np.bincount(b[which], minlength=WORD_NUMBERS)
        stats = np.stack([np.bincount(c, minlength=WORD_NUMBERS), *(of(n == k) for k in (1, 2, 3, 4)), of(n > 2), np.bincount(b, n, WORD_NUMBERS).astype(np.int64)])
        rows = [(t.column("shard")[0].as_py(), gaps(g), packed(n), None, None)]
        for k in range(WORD_NUMBERS // SLICE):
            part = np.ascontiguousarray(stats[:, k * SLICE : (k + 1) * SLICE])
            if part.any():
                rows.append((None, None, None, k, packed(part.reshape(-1))))
        names, kinds = ("shard", "grams", "n", "slice", "stats"), (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary())
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return counts.groupBy("shard").applyInArrow(merge, "shard int, grams binary, n binary, slice int, stats binary")


def word_counts(rows: DataFrame) -> np.ndarray:
    """(STATS, WORD_NUMBERS): the sums over shards; that many numbers reach the driver, whatever the corpus."""

    def add(t: pa.Table) -> pa.Table:
        total = np.sum([unpacked(x, np.int64) for x in t.column("stats").to_pylist()], axis=0)
        return pa.table({"slice": pa.array([t.column("slice")[0].as_py()], pa.int32()), "stats": pa.array([packed(total)], pa.binary())})

    out = np.zeros((STATS, WORD_NUMBERS), dtype=np.int64)
    for r in rows.where("slice IS NOT NULL").select("slice", "stats").groupBy("slice").applyInArrow(add, "slice int, stats binary").collect():
        out[:, r.slice * SLICE : (r.slice + 1) * SLICE] = unpacked(bytes(r.stats), np.int64).reshape(STATS, SLICE)
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What modified Kneser-Ney takes off counts of 1, 2, and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    off = [k - (k + 1) * y * b / a if a else k * 0.5 for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1)]
    return [min(max(d, 0.0), float(k)) for k, d in enumerate(off, 1)]


def taken(n: np.ndarray, off: list[float]) -> np.ndarray:
    return np.array([0.0, *off])[np.minimum(n, 3).astype(np.int64)]


def fit(texts: DataFrame, shards: int) -> Model:
    """The model of texts; without any, all words and pairs weigh nothing."""
    rows = stored(merged(pair_counts(texts, shards)), "model")
    after, n1, n2, n3, n4, more, every = word_counts(rows)
    table = rows.where("slice IS NULL").select("shard", "grams", "n")
    size, total = int((after > 0).sum()), int(after.sum())
    zero = np.zeros(WORD_NUMBERS)
    if not size:
        return Model(table, shards, zero, zero + 1, zero + 1, [0.0] * 3)
    d2, d1 = discounts(*(int(x.sum()) for x in (n1, n2, n3, n4))), discounts(*(int((after == k).sum()) for k in (1, 2, 3, 4)))
    spare = taken(after, d1)
    p = (after - spare) / total + max(spare.sum() / total, 1e-9) / (size + 1)  # the last part is that of a word that was never counted
    left = np.maximum(d2[0] * n1 + d2[1] * n2 + d2[2] * more, 1e-9)
    bow = np.log(np.where(every > 0, left / np.maximum(every, 1), 1.0))
    word = np.log(p) + bow
    word[START], word[END] = bow[START], np.log(p[END])
    return Model(table, shards, word, p, left, d2)


def occurrences(texts: DataFrame, model: Model) -> DataFrame:
    """For each chunk of texts (h, text) and shard: the pairs, and which of the chunk's texts hold them how often. Of a task's copies of a text, one.

    about, once for each chunk: h, the number of words and the sum over them, for each text.
    """
    sent, shards = texts.sparkSession.sparkContext.broadcast(model.word), model.n_shards
    names = ["shard", "chunk", "docs", "about", "grams", "runs", "doc", "times"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def flush(chunk: int, about: list, held: list) -> pa.RecordBatch:
        place = np.repeat(np.arange(len(held), dtype=np.uint64), [len(x) for x in held])
        both, times = np.unique(np.concatenate(held) << np.uint64(64 - 2 * WORD_BITS) | place, return_counts=True)
        gram, doc = both >> np.uint64(64 - 2 * WORD_BITS), (both & np.uint64((1 << (64 - 2 * WORD_BITS)) - 1)).astype(np.uint32)
        rows = []
        for k, at in dealt(gram, shards):
            g = gram[at]
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            of_texts = b"".join(np.array(x, dtype=t).tobytes() for x, t in zip(zip(*about, strict=True), ("<i8", "<i8", "<f8"), strict=True)) if not rows else None
            rows.append((k, chunk, len(held), of_texts, gaps(g[first]), packed(np.diff(np.r_[first, len(g)]).astype(np.uint32)), packed(doc[at]), packed(times[at].astype(np.uint32))))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, about, held, size, had = TaskContext.get().partitionId() << 32, [], [], 0, set()
        for b in batches:
            for h, text in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                if h in had:
                    continue
                if len(had) >= 1 << 17:
                    had.clear()
                had.add(h)
                s = numbers(text)
                about.append((h, len(s) - 2, float(sent.value[s.astype(np.int64)].sum())))
                held.append(pairs(s))
                size += len(s)
                if size >= CHUNK or len(held) >= 1 << 16:
                    yield flush(chunk, about, held)
                    chunk, about, held, size = chunk + 1, [], [], 0
        if held:
            yield flush(chunk, about, held)

    return short_batches(texts).mapInArrow(run, "shard int, chunk long, docs int, about binary, grams binary, runs binary, doc binary, times binary")


def text_scores(texts: DataFrame, model: Model) -> DataFrame:
    """(h, n, _nll) of texts (h, text): the number of words, and the mean of -log p; copies of a text weigh alike, so they leave its mean."""
    sent, off = texts.sparkSession.sparkContext.broadcast((model.p.astype(np.float32), model.left.astype(np.float32))), model.off

    def look_up(found: pa.Table, counted: pa.Table) -> pa.Table:
        key, w = np.zeros(0, np.uint64), np.zeros(0)
        if counted.num_rows:
            key, n = ungaps(counted.column("grams")[0].as_py()), unpacked(counted.column("n")[0].as_py(), np.uint64)
            p, left = sent.value
            w = np.log1p((n - taken(n, off)) / (left[(key >> np.uint64(WORD_BITS)).astype(np.int64)] * p[(key & np.uint64(WORD_NUMBERS - 1)).astype(np.int64)].astype(float)))
        out = []
        for chunk, docs, about, grams, runs, doc, times in zip(*(found.column(c) for c in ("chunk", "docs", "about", "grams", "runs", "doc", "times")), strict=True):
            g = ungaps(grams.as_py())
            at = np.minimum(np.searchsorted(key, g), max(len(key) - 1, 0))
            got = np.where(key[at] == g, w[at], 0.0) if len(key) else np.zeros(len(g))
            each = np.repeat(got, unpacked(runs.as_py(), np.uint32)) * unpacked(times.as_py(), np.uint32)
            total = np.bincount(unpacked(doc.as_py(), np.uint32), each, docs.as_py()).astype(np.float32)
            some = np.flatnonzero(total).astype(np.uint32)
            if 2 * len(some) > len(total):
                some = np.arange(len(total), dtype=np.uint32)
            out.append((chunk.as_py(), docs.as_py(), about.as_py(), packed(some), total[some].tobytes()))
        names, kinds = ("chunk", "docs", "about", "at", "sums"), (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)

    def add(t: pa.Table) -> pa.Table:
        about = next(x for x in t.column("about").to_pylist() if x is not None)
        size = t.column("docs")[0].as_py()
        h, n = np.frombuffer(about, "<i8", 2 * size).reshape(2, -1)
        total = np.frombuffer(about, "<f8", size, 16 * size).copy()
        for at, sums in zip(t.column("at").to_pylist(), t.column("sums").to_pylist(), strict=True):
            total[unpacked(at, np.uint32)] += np.frombuffer(sums, np.float32)
        return pa.table({"h": h, "n": n, "total": -total})

    found = occurrences(texts, model)
    sums = found.groupBy("shard").cogroup(model.shards.groupBy("shard")).applyInArrow(look_up, "chunk long, docs int, about binary, at binary, sums binary")
    each = sums.groupBy("chunk").applyInArrow(add, "h long, n long, total double")
    return each.groupBy("h").agg(F.max("n").alias("n"), (F.sum("total") / F.sum(F.col("n") + 1)).alias("_nll"))


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts (text, or compressed as packed) of the doc_ids in ids: ids go to the texts where they are few, else a bounded filter thins these before a join."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    if ids.count() <= SENT_IDS:
        return texts.join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    sent = docs.sparkSession.sparkContext.broadcast(id_bits(ids))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            b = b.filter(pa.array(has_bit(sent.value, b.column("slot").to_numpy())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([pack(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "packed"])

    some = short_batches(texts.withColumn("slot", id_slot())).mapInArrow(thin, "doc_id long, packed binary")
    return some.join(ids, "doc_id", "left_semi").select("packed")


def quantiles(scores: DataFrame, by: list[str], quantile: float) -> DataFrame:
    """(by, _limit): of each group the least _nll that `quantile` of the group's rows don't exceed; exact, by rank over a range-sorted table."""
    sorted_ = stored(row_ids(scores.select(*by, "_nll"), *by, "_nll"), "sorted")
    begin = starts(sorted_, *by)
    same = " AND ".join(["r._part = b._part", *(f"r.{c} <=> b.{c}" for c in by)])
    ranked = sorted_.alias("r").join(begin.alias("b"), F.expr(same)).select(*(f"r.{c}" for c in by), "_nll", (F.col("_before") + F.col("_at") - F.col("_lo") + 1).alias("_rank"))
    total = begin.groupBy(*by).agg(F.ceil(F.sum("_rows") * F.lit(quantile) - 1e-9).alias("_need"))
    need = ranked.alias("r").join(total.alias("t"), F.expr(" AND ".join(["_rank = greatest(_need, 1)", *(f"r.{c} <=> t.{c}" for c in by)])))
    return need.select(*(F.col(f"r.{c}") for c in by), F.col("_nll").alias("_limit"))


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """docs without text, with n_symbols, perplexity and kept; trusted: the doc_ids (column doc_id) of trusted text.

    A null or empty text has no perplexity (null) and isn't kept. Null languages are a language; one without trusted
    documents held out is held against those of all languages; without any trusted text at all everything with a text
    is kept. Every row stays, repeated ones too; null doc_ids are never trusted; an empty table gives no rows; columns
    that clash with the new names are left out.
    """
    ids = stored(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "ids")
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    rest = free_of(docs, "text", "n_symbols", "perplexity", "kept", "_nll", "_limit", "_trusted", "_all", "_h")
    texts = docs.select(F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    model = fit(of_ids(docs, ids.where(~held_out)), n_shards(texts))
    each = stored(text_scores(texts, model), "texts").select(F.col("h").alias("_h"), F.col("n").alias("n_symbols"), F.when(F.col("n") > 0, F.col("_nll")).alias("_nll"))
    hashed = docs.select(*rest, F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_h"))
    scored = stored(hashed.join(each, "_h", "left").select(*rest, F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols"), "_nll"), "scores")
    known = scored.select("doc_id", "lang", "_nll").where("_nll IS NOT NULL")
    spared = known.join(ids.where(held_out), "doc_id", "left_semi")
    known = stored(spared if spared.head(1) else known.join(ids, "doc_id", "left_semi"), "known")  # a handful of trusted texts, none held out
    limits = stored(quantiles(known, ["lang"], quantile).withColumnRenamed("lang", "_lang"), "limits")
    overall = quantiles(known.select("_nll", F.lit(0).alias("every")), ["every"], quantile).first()
    few = limits.count() <= 100_000
    out = scored.join(F.broadcast(limits) if few else limits, F.expr("lang <=> _lang"), "left")
    kept = F.col("_nll").isNotNull() & (F.col("_nll") <= F.coalesce("_limit", F.lit(overall["_limit"] if overall else math.inf)))
    discard(ids, known)
    return out.select(*rest, "n_symbols", F.exp("_nll").alias("perplexity"), kept.alias("kept"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(documents(spark, sf_dir).select("doc_id", "lang", "text"), labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id"))
