"""Line dedup: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the stripped, ASCII-lower-cased line, held as a 128-bit digest. The reference tables hold, for
each document, its keys (postings), and for each key the number of documents holding it and the smallest of
them. A key held twice or more is *shared*; the shared keys' fingerprints are in cuckoo filters, one for each
shard. Inserting documents adds postings and, where a count passes from one to two, a fingerprint; deleting
documents takes both back, so a text can be restored when the earlier holder of its lines goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, documents, free_of, mix64, short_batches, stored, with_columns

MIN_CHARS = 10
SLOTS = 4
#: Shared keys in a shard's filter, on average.
SHARD_KEYS = 1 << 16
#: Filters are sent to all executors up to so many bytes; beyond that, postings are dealt to the filters by shard.
FILTER_BYTES = 32 << 20
#: Postings that a shard's task gets then, on average.
SHARD_POSTINGS = 1 << 20
#: Keys held by more than 1 / HOT_SHARE of all postings go to all executors: fewer than HOT_SHARE of them can be.
HOT_SHARE = 1000

POSTING = "doc_id long, k1 long, k2 long"


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The 16-byte digest of a line's key; None if the key is too short to count."""
    key = line.strip(SPACE)
    return xxhash.xxh3_128_digest(key.encode().lower()) if len(key) >= min_chars else None


class CuckooFilter:
    """16-bit fingerprints in buckets of four; all operations on arrays of key halves. Holds several copies of a fingerprint.

    An alternate bucket is the bucket xor a hash of the fingerprint, so it needs no key. When an insertion finds no
    room, the table is rebuilt at twice the size from `keys`, the exact table's keys: none is ever lost.
    """

    def __init__(self, capacity: int):
        self.bits = max(1, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((1 << self.bits, SLOTS), dtype=np.uint16)

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (k2.astype(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (mix64(k1.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, first, self.other(mark, first)

    def other(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def put(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Place what finds a free slot in its bucket; which of the marks were placed."""
        done = np.zeros(len(mark), dtype=bool)
        for slot in range(SLOTS):
            todo = np.flatnonzero(~done & (self.table[bucket, slot] == 0))
            _, lead = np.unique(bucket[todo], return_index=True)  # one for each bucket at a time
            lead = todo[lead]
            self.table[bucket[lead], slot] = mark[lead]
            done[lead] = True
        return done

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> bool:
        """Whether all found room; if not, rebuild a larger filter."""
        mark, first, second = self.places(k1, k2)
        left = ~self.put(mark, first)
        mark, at = mark[left], second[left]
        left = ~self.put(mark, at)
        mark, at = mark[left], at[left]
        rng = np.random.default_rng(7)
        for _ in range(500):
            if not len(mark):
                return True
            bucket, lead = np.unique(at, return_index=True)
            slot = rng.integers(0, SLOTS, len(lead))
            out = self.table[bucket, slot].copy()
            self.table[bucket, slot] = mark[lead]
            rest = np.ones(len(mark), dtype=bool)
            rest[lead] = False
            mark, at = np.concatenate([mark[rest], out]), np.concatenate([at[rest], self.other(out, bucket)])
            done = self.put(mark, at)
            mark, at = mark[~done], at[~done]
        return False

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, first, second = self.places(k1, k2)
        return (self.table[first] == mark[:, None]).any(1) | (self.table[second] == mark[:, None]).any(1)

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Take one copy of each key's fingerprint out; only for keys that were inserted."""
        mark, first, second = self.places(k1, k2)
        left = np.arange(len(mark))
        while len(left):
            before = len(left)
            for bucket in (first, second):
                # of keys with one fingerprint in one bucket, one at a time
                _, lead = np.unique(bucket[left] << 16 | mark[left], return_index=True)
                lead = left[lead]
                slots = self.table[bucket[lead]] == mark[lead, None]
                some = slots.any(axis=1)
                self.table[bucket[lead[some]], slots[some].argmax(axis=1)] = 0
                left = np.setdiff1d(left, lead[some], assume_unique=True)
            if len(left) == before:
                return  # these weren't there

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def of_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, dtype=np.uint16).reshape(-1, SLOTS).copy()
        out.bits = int(np.log2(len(out.table)))
        return out

    @classmethod
    def build(cls, k1: np.ndarray, k2: np.ndarray, capacity: int = 0) -> CuckooFilter:
        capacity = max(capacity, len(k1))
        while not (out := cls(capacity)).insert(k1, k2):
            capacity *= 2
        return out


def shard_of(n_shards: int):
    return F.pmod(F.xxhash64("k1", "k2"), F.lit(n_shards)).cast("int")


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, k2): the keys of each document, each once. Documents without an id hold nothing."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(d, k) for d, t in zip(b.doc_id, b.text, strict=True) for k in {line_key(line, min_chars) for line in t.split("\n")} if k]
            half = np.frombuffer(b"".join(k for _, k in found), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": np.array([d for d, _ in found], dtype=np.int64), "k1": half[:, 0], "k2": half[:, 1]})

    return short_batches(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")).mapInPandas(keys, POSTING)


@dataclass
class LineState:
    """The tables of a deduplicated set of documents; see the module."""

    postings: DataFrame
    refs: DataFrame  # k1, k2, refs, first_doc, shard
    filters: DataFrame  # shard, filter
    n_shards: int
    held: int  # postings

    @classmethod
    def empty(cls, spark: SparkSession) -> LineState:
        return cls(*(spark.createDataFrame([], s) for s in (POSTING, "k1 long, k2 long, refs long, first_doc long, shard int", "shard int, filter binary")), 1, 0)

    def counted(self, held: DataFrame) -> LineState:
        """The state whose postings are `held` (stored). Filters of shards whose shared keys are unchanged stay as they are."""
        refs = held.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("first_doc"))
        refs = stored(refs, "refs")
        n_shared, n_held = refs.agg(F.count(F.when(F.col("refs") > 1, 1)), F.coalesce(F.sum("refs"), F.lit(0))).first()
        n = max(1, -(-n_shared // SHARD_KEYS), -(-n_held // SHARD_POSTINGS))
        n_shards = self.n_shards if self.n_shards / 2 <= n <= self.n_shards * 2 else n
        refs = refs.withColumn("shard", shard_of(n_shards))
        schema = "shard int, filter binary"
        now = refs.where("refs > 1").select("shard", "k1", "k2", F.lit(True).alias("fresh"))
        if n_shards != self.n_shards or self.filters.isEmpty():

            def build(g: pd.DataFrame) -> pd.DataFrame:
                return pd.DataFrame({"shard": [g.shard.iloc[0]], "filter": [CuckooFilter.build(g.k1.to_numpy(), g.k2.to_numpy()).to_bytes()]})

            return LineState(held, refs, stored(now.groupBy("shard").applyInPandas(build, schema), "filters"), n_shards, n_held)
        before = self.refs.where("refs > 1").select("shard", "k1", "k2", F.lit(True).alias("stale"))
        changed = now.join(before, ["shard", "k1", "k2"], "full").where("fresh IS NULL OR stale IS NULL")

        def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = (old if len(old) else new).shard.iloc[0]
            f = CuckooFilter.of_bytes(old["filter"].iloc[0]) if len(old) else CuckooFilter(1)
            gone, come = new[new.fresh.isna()], new[new.stale.isna()]
            f.delete(gone.k1.to_numpy(), gone.k2.to_numpy())
            full = not f.insert(come.k1.to_numpy(), come.k2.to_numpy())
            return pd.DataFrame({"shard": [shard], "filter": [b"" if full else f.to_bytes()]})

        fresh = stored(self.filters.groupBy("shard").cogroup(changed.groupBy("shard")).applyInPandas(update, schema), "filters")
        if fresh.where(F.length("filter") == 0).isEmpty():
            return LineState(held, refs, fresh, n_shards, n_held)
        return LineState(held, self.refs, fresh.limit(0), n_shards, n_held).counted(held)  # a shard has no room: all filters anew from the exact table

    def insert(self, docs: DataFrame, min_chars: int = MIN_CHARS) -> LineState:
        """With these documents too. A document id that comes again adds its lines to those it has."""
        return self.counted(stored(self.postings.union(postings(docs, min_chars)).distinct(), "postings"))

    def delete(self, ids: DataFrame) -> LineState:
        """Without the documents of these ids (column doc_id)."""
        return self.counted(stored(self.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_anti"), "postings"))

    def hot(self) -> DataFrame:
        """(k1, k2, first_doc) of shared keys that hold more than 1 / HOT_SHARE of all postings: fewer than HOT_SHARE rows."""
        return self.refs.where((F.col("refs") > 1) & (F.col("refs") > self.held // HOT_SHARE)).select("k1", "k2", "first_doc")

    def screened(self) -> DataFrame:
        """The postings that the filters let pass: all of shared keys, and a few others.

        Filters that are small together go to all executors. Larger ones meet the postings of their shard in one task;
        postings of hot keys, which the table itself calls shared, aren't dealt out then.
        """
        size = self.filters.agg(F.sum(F.length("filter"))).first()[0] or 0
        marked = self.postings.withColumn("shard", shard_of(self.n_shards))

        def passing(k1: np.ndarray, k2: np.ndarray, data: bytes | None) -> np.ndarray:
            return CuckooFilter.of_bytes(data).contains(k1, k2) if data else np.zeros(len(k1), dtype=bool)

        if size <= FILTER_BYTES:
            sent = self.postings.sparkSession.sparkContext.broadcast({r.shard: bytes(r["filter"]) for r in self.filters.collect()})

            def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for b in batches:
                    hit = np.zeros(len(b), dtype=bool)
                    for shard, at in b.groupby("shard").indices.items():
                        hit[at] = passing(b.k1.to_numpy()[at], b.k2.to_numpy()[at], sent.value.get(shard))
                    yield b.loc[hit, ["doc_id", "k1", "k2"]]

            return marked.mapInPandas(probe, POSTING)

        def meet(found: pa.Table, filters: pa.Table) -> pa.Table:
            data = filters.column("filter")[0].as_py() if filters.num_rows else None
            hit = passing(found.column("k1").to_numpy(), found.column("k2").to_numpy(), data)
            return found.select(["doc_id", "k1", "k2"]).filter(pa.array(hit))

        hot = F.broadcast(self.hot().select("k1", "k2"))
        cold = marked.join(hot, ["k1", "k2"], "left_anti").select("doc_id", "k1", "k2", "shard")
        met = cold.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(meet, POSTING)
        return met.union(self.postings.join(hot, ["k1", "k2"], "left_semi").select("doc_id", "k1", "k2"))

    def dropped(self) -> DataFrame:
        """(doc_id, _drops): the keys whose lines a document loses to a smaller id."""
        shared = self.refs.where("refs > 1").select("k1", "k2", "refs", "first_doc")
        found = self.screened().join(F.broadcast(self.hot().withColumnRenamed("first_doc", "hot_doc")), ["k1", "k2"], "left")
        cold = found.where("hot_doc IS NULL").join(shared.where(F.col("refs") <= self.held // HOT_SHARE).drop("refs"), ["k1", "k2"]).where("doc_id > first_doc")
        lost = found.where("doc_id > hot_doc").select("doc_id", "k1", "k2").union(cold.select("doc_id", "k1", "k2"))
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct("k1", "k2")).alias("_drops"))

    def save(self, path: str) -> None:
        """Write the state under a new folder, to go on from in another session."""
        for name in ("postings", "refs", "filters"):
            getattr(self, name).write.parquet(f"{path}/{name}")
        self.postings.sparkSession.createDataFrame([(self.n_shards, self.held)], "n_shards int, held long").write.parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LineState:
        about = spark.read.parquet(f"{path}/about").first()
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "refs", "filters")), about.n_shards, about.held)

    def kept(self, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
        """docs with kept (the text without the dropped lines, '' for null), n_lines and n_dropped instead of text; all rows stay."""
        rest = free_of(docs, "text", "kept", "n_lines", "n_dropped", "_drops")
        both = docs.select(*rest, F.coalesce("text", F.lit("")).alias("text")).join(self.dropped(), "doc_id", "left")

        def rebuild(batch: pa.RecordBatch) -> list:
            out = []
            for text, drops in zip(batch.column("text").to_pylist(), batch.column("_drops").to_pylist(), strict=True):
                lines = text.split("\n")
                gone = {np.array([d["k1"], d["k2"]], dtype="<i8").tobytes() for d in drops or ()}
                stay = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
            return list(zip(*out, strict=True)) if out else [[], [], []]

        return with_columns(both, rest, "kept string, n_lines long, n_dropped long", rebuild)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with kept, n_lines and n_dropped instead of text: a key of min_chars code points or more that several
    documents hold keeps its lines only in the smallest doc_id.

    Null text is one empty line; rows with a null doc_id neither hold keys nor lose lines; rows of the same doc_id
    are one document, and every row stays; an empty table gives no rows; other columns go through but for those whose
    names clash with the new ones.
    """
    state = LineState.empty(docs.sparkSession).insert(docs, min_chars)
    return state.kept(docs, min_chars)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, t.i AS pos, s[t.i] AS line,
         translate(trim(s[t.i], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents) d, unnest(range(1, len(s) + 1)) AS t(i)
), held AS (
  SELECT k, min(doc_id) AS first_doc, count(DISTINCT doc_id) AS refs FROM lines WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT l.*, coalesce(h.refs > 1 AND l.doc_id > h.first_doc, false) AS gone
  FROM lines l LEFT JOIN held h ON l.k = h.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(CASE WHEN gone THEN 1 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
