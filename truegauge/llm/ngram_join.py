"""N-gram Jaccard join by set-relation skipping.

A document is the set of its word shingles, held as 64-bit hashes. Sets of Jaccard similarity t or more share l of
the first n - ceil(t n) + l of their shingles in any common order; the order here is by how often a sketch of all
documents has counted a shingle, rarest first. The shingles there with two or more sets are index lists.

* Equal sets are one set: their answers are the same.
* Index lists say which sets may have to do with each other. After the bounds on size and position, linked sets meet l
  times. In long lists they meet no oftener than either has shingles there, so the rest of the l must be met in short
  ones. Only sets with l shingles or more in long lists may meet there alone, and then in one of the first of these: just
  such sets are connected by a long list. The groups that this connects are regions.
* A region is compared tile by tile, and every link comes out of a tile: its index lists are cut into blocks by
  position, skipped whole where no entry can reach the threshold; and where a set differs little from one whose
  overlaps with all others are known, its own follow from these by the shingles that differ.

A tile reports, for each set, one it is connected with, so no step makes all pairs of a group; documents' classes
are connected components over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, documents, free_of, has_bit, id_bits, id_slot, mix64, short_batches, stored
from .components import components
from .tiles import roots, tiled

WORDS = 3
PERCENT = 90
#: Most and fewest bits of the numbers of the counters that order shingles, how many shingles a counter should get, and
#: the slices that counters travel in. Only speed depends on them.
SKETCH_BITS, LEAST_BITS, LOAD = 25, 20, 32
SLICES = 64
#: Slots that a task collects before it sends them.
SLOTS = 1 << 22
#: Lists of more sets than this are long: they connect sets that may meet in such lists alone.
LONG_LIST = 16
#: A shingle that the sketch has counted oftener than this has its list dealt out to several tasks, by set.
HOT_LIST = 4096
#: How often (l) two sets of enough shingles must meet in the index lists.
MEETINGS = 8
#: Sets of a region, and their shingles, in a block of its tiles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
#: Words of 64 bits in the parity bitmap of a set.
PARITY = 8


class _WordHashes(dict):
    """Hashes of words, remembered; forgets all when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORD_HASH = _WordHashes()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, as sorted uint64 hashes. bytes.lower() and split() are just A-Z and the contract's white space."""
    said = text.encode().lower().split()
    if not said:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_WORD_HASH.__getitem__, said), dtype=np.uint64, count=len(said))
    width = min(words, len(h))
    mixed = np.full(len(h) - width + 1, width if width < words else 0, dtype=np.uint64)
    for k in range(width):
        mixed = mix64(mixed + h[k : len(h) - width + 1 + k])
    return np.unique(mixed)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def identity(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    a = signed(np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)]))
    return int(a[0]), int(a[1])


def need(n, m, percent: int = PERCENT):
    """The least overlap with which sets of n and m shingles link: percent * union <= 100 * overlap, in whole numbers."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT, meetings: int = 1) -> int:
    least = -(-percent * n // 100)
    return n - least + min(meetings, least)


def parity(s: np.ndarray) -> np.ndarray:
    """A bitmap whose distance to another set's is at most the number of shingles that differ."""
    bits = np.bincount((s % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def slots_of(s: np.ndarray, bits: int) -> np.ndarray:
    """The counters of shingles in a sketch of 2^bits: neighbours in a larger sketch share one in a smaller."""
    return (s % np.uint64(1 << SKETCH_BITS) >> np.uint64(SKETCH_BITS - bits)).astype(np.int64)


#: Slots of a slice, and how many of these differ in their lowest byte only.
SLICE_BITS = SKETCH_BITS - (SLICES - 1).bit_length()
PAGES = 1 << SLICE_BITS - 8


def packed_slots(slots: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slice, bytes) of slots, repeated ones too: how many each page of 256 has, then their lowest bytes."""
    slots = np.sort(slots)
    ends = np.searchsorted(slots, np.arange(SLICES + 1) << SLICE_BITS)
    for k in np.flatnonzero(np.diff(ends)):
        own = slots[ends[k] : ends[k + 1]]
        pages = np.bincount(own >> 8 & PAGES - 1, minlength=PAGES).astype(np.uint32)
        yield int(k), pages.tobytes() + (own & 255).astype(np.uint8).tobytes()


def unpacked_slots(packed: bytes) -> np.ndarray:
    """The slots in a slice, from their bytes."""
    pages = np.frombuffer(packed, dtype=np.uint32, count=PAGES)
    return np.repeat(np.arange(PAGES) << 8, pages) | np.frombuffer(packed, dtype=np.uint8, offset=4 * PAGES)


class Sketch:
    """How often shingles occur, in a byte a counter: in steps of `step` up to 127 of them, then in eighths of a doubling."""

    def __init__(self, shingles: int):
        self.bits = min(max(LEAST_BITS, (shingles // LOAD).bit_length()), SKETCH_BITS)
        self.step = max(1, (shingles >> self.bits) // LOAD)
        self.codes = np.zeros(1 << self.bits, dtype=np.uint8)

    @staticmethod
    def coded(counts: np.ndarray, step: int) -> np.ndarray:
        q = counts // step
        return np.where(q < 128, q, np.minimum(128 + 8 * np.log2(np.maximum(q, 128) / 128), 255)).astype(np.uint8)

    def order(self, s: np.ndarray) -> np.ndarray:
        return self.codes[slots_of(s, self.bits)]

    def about(self, s: np.ndarray) -> np.ndarray:
        """The counts themselves, rounded down."""
        c = np.arange(256)
        return np.where(c < 128, c * self.step, 128 * self.step * 2.0 ** ((c - 128) / 8)).astype(np.int64)[self.order(s)]


def summed_slices(parts: DataFrame, shingles: int) -> Sketch:
    """The sketch of that many shingles, from rows (task, slice, packed slots); at most 2^SKETCH_BITS bytes reach the driver."""
    out = Sketch(shingles)
    size, fold, step = len(out.codes) // SLICES, SKETCH_BITS - out.bits, out.step

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, dtype=np.uint64)
        for c in g.counts:
            total += np.bincount(unpacked_slots(c) >> fold, minlength=size).astype(np.uint64)
        return pd.DataFrame({"slice": [g.slice.iloc[0]], "counts": [np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32).tobytes()]})

    def coded(g: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, dtype=np.uint32).astype(np.int64) for c in g.counts)
        return pd.DataFrame({"slice": [g.slice.iloc[0]], "counts": [Sketch.coded(total, step).tobytes()]})

    schema = "slice int, counts binary"
    some = parts.groupBy("slice", F.expr("task div 256")).applyInPandas(add, schema)
    for r in some.groupBy("slice").applyInPandas(coded, schema).collect():
        out.codes[r.slice * size : (r.slice + 1) * size] = np.frombuffer(r.counts, dtype=np.uint8)
    return out


INNER = ("_n", "_s1", "_s2", "_task", "_slice", "_counts")


def read_sets(docs: DataFrame, words: int) -> DataFrame:
    """The columns of docs but text, with each document's set's size and identity; and, for each task, packed slots of all its shingles by slice."""
    rest = [c for c in docs.columns if c != "text"]
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in rest] + T._parse_datatype_string("_n long, _s1 long, _s2 long, _task int, _slice int, _counts binary").fields)
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, slots, held = TaskContext.get().partitionId(), [], 0

        def sent() -> pa.RecordBatch:
            full = list(packed_slots(np.concatenate(slots)))
            about = [pa.array([task] * len(full), pa.int32()), pa.array([k for k, _ in full], pa.int32()), pa.array([c for _, c in full], pa.binary())]
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(full), t) for t in kinds[:-3]), *about], names=schema.names)

        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                s = shingles(text or "", words)
                rows.append((len(s), *identity(s)))
                slots.append(slots_of(s, SKETCH_BITS).astype(np.uint32))
                held += len(s)
                if held >= SLOTS:
                    yield sent()
                    slots, held = [], 0
            found = np.array(rows, dtype=np.int64).reshape(-1, 3).T
            none = [pa.nulls(len(rows), t) for t in kinds[-3:]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), *map(pa.array, found), *none], schema=pa.schema(list(zip(schema.names, [*(b.column(c).type for c in rest), *kinds[-6:]], strict=True))))
        if held:
            yield sent()

    return docs.mapInArrow(run, schema)


def first_shingles(s: np.ndarray, sketch: Sketch, percent: int) -> np.ndarray:
    """The prefix of a set in the common order: by the sketch's count, then by hash."""
    p = prefix_length(len(s), percent, MEETINGS)
    often = sketch.order(s)
    if p < len(s):
        few = often <= np.partition(often, p - 1)[p - 1]
        s, often = s[few], often[few]
    return s[np.lexsort((s, often))[:p]]


def index_entries(docs: DataFrame, sketch: Sketch, words: int, percent: int) -> DataFrame:
    """(token, salts, salt, s1, n, pos): each set's first shingles in the common order; a hot shingle's list is in `salts` parts. A task leaves out equal sets that it has just had."""
    sent = docs.sparkSession.sparkContext.broadcast(sketch)
    names = ["token", "salts", "salt", "s1", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had = set()
        for b in batches:
            tokens, rows = [np.zeros(0, dtype=np.uint64)], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingles(text or "", words)
                key = identity(s)
                if not len(s) or doc is None or key in had:
                    continue
                if len(had) >= 1 << 17:
                    had.clear()
                had.add(key)
                tokens.append(first_shingles(s, sent.value, percent))
                rows.append((key[0], len(s), len(tokens[-1])))
            s1, n, p = np.array(rows, dtype=np.int64).reshape(-1, 3).T
            pos = np.concatenate([np.arange(k) for k in p]) if len(p) else p
            token, s1 = np.concatenate(tokens), np.repeat(s1, p)
            salts = 1 + sent.value.about(token) // HOT_LIST
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(token), salts, np.mod(s1, salts), s1, np.repeat(n, p), pos)], names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def index_lists(entries: DataFrame) -> DataFrame:
    """(token, salt, s1, n, pos, frequent): entries of lists with two sets or more; a hot list, all parts of it, is long whatever its length."""
    w = W.partitionBy("token", "salt")
    some = entries.withColumn("_lo", F.min("s1").over(w)).withColumn("_hi", F.max("s1").over(w)).where("_lo < _hi OR salts > 1")
    once = some.groupBy("token", "salt", "salts", "s1", "n").agg(F.min("pos").alias("pos"))
    return once.withColumn("frequent", (F.col("salts") > 1) | (F.count(F.lit(1)).over(w) > LONG_LIST)).drop("salts")


def least_meetings(n: str, percent: int) -> str:
    """How often sets, the smaller of n shingles, meet at least if they link."""
    return f"least({MEETINGS}, ({percent} * {n} + 99) div 100)"


def long_lists(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges that connect the sets of each long list which may meet in long lists alone.

    Such sets have as many shingles in long lists as linked sets meet, with the smallest set that they may link with; the
    first shingle that both have is followed by all but one of these. Parts of hot lists are connected by their first sets.
    """
    own = W.partitionBy("s1")
    entries = index.where("frequent").withColumn("_all", F.count(F.lit(1)).over(own)).withColumn("_at", F.row_number().over(own.orderBy("pos")))
    met = F.expr(least_meetings(f"(({percent} * n + 99) div 100)", percent))
    first = entries.where(F.col("_at") <= F.col("_all") - met + 1).withColumn("first", F.min("s1").over(W.partitionBy("token", "salt")))
    stars = first.where("s1 <> first").select(F.col("s1").alias("a"), F.col("first").alias("b"))
    parts = first.groupBy("token", F.col("first").alias("a")).agg(F.lit(1))
    ends = parts.groupBy("token").agg(F.min("a").alias("b"))
    return stars.union(parts.join(ends, "token").where("a <> b").select("a", "b"))


def short_list_pairs(index: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets that meet in short lists, and often enough with what they may meet in long ones."""
    short = index.where("NOT frequent")
    a, b = short.alias("a"), short.alias("b")
    least = f"({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent}"
    bounds = f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) AND least(a.pos, b.pos) + least(a.n - a.pos, b.n - b.pos) >= {least}"
    met = a.join(b, F.expr(f"a.token = b.token AND a.s1 < b.s1 AND {bounds}")).groupBy(F.col("a.s1").alias("a"), F.col("b.s1").alias("b"))
    counted = met.agg(F.count(F.lit(1)).alias("times"), F.min(F.least("a.n", "b.n")).alias("n"))
    held = index.where("frequent").groupBy("s1").agg(F.count(F.lit(1)).alias("k"))
    both = counted
    for end in ("a", "b"):
        both = both.join(held.select(F.col("s1").alias(end), F.col("k").alias(f"k{end}")), end, "left")
    return both.where(f"times + least(coalesce(ka, 0), coalesce(kb, 0)) >= {least_meetings('n', percent)}").select("a", "b")


def placed_sets(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """(s1, s2, doc_id, region, cell, block, blocks): the sets that regions hold, one document of each, and the tiles they go to.

    Small regions share cells, so that a task gets many of them; large ones are cut into blocks by sets and shingles.
    """
    regions = components(edges)
    member = classes.join(regions.select(F.col("node").alias("s1"), F.col("component").alias("region")), "s1")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = stored(member.groupBy("region").agg(blocks.alias("blocks"), F.sum("n").alias("all")), "regions")
    cells = max(8, -(-(sizes.agg(F.sum("all")).first()[0] or 0) // BLOCK_SHINGLES))
    cell = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("region"), F.lit(cells))).otherwise(F.xxhash64("region"))
    block = F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int")
    return member.join(sizes, "region").select("s1", "s2", F.col("first").alias("doc_id"), "region", cell.alias("cell"), block.alias("block"), "blocks")


def wanted_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """wanted with the shingles of its documents' texts, which a bounded filter picks out before the exact join; each set once."""
    sent = docs.sparkSession.sparkContext.broadcast(id_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(has_bit(sent.value, b.column("slot").to_numpy()))))
            sets = [shingles(t or "", words) for t in b.column("text").to_pylist()]
            both = np.array([identity(s) for s in sets], dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, both), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "s1", "s2", "shingles"])

    found = docs.where("doc_id IS NOT NULL").withColumn("slot", id_slot()).mapInArrow(run, "doc_id long, s1 long, s2 long, shingles binary")
    # rows of one doc_id may differ in text, hence all three keys
    return found.join(wanted, ["s1", "s2", "doc_id"]).dropDuplicates(["s1", "s2"])


class Tile:
    """The sets of a tile, as sorted arrays of ranks in the tile's own order (rarest first), and its index lists."""

    #: Entries of an index list in a block.
    ENTRIES = 32
    #: With more candidates than this, the overlaps with all sets are counted at once, and others may derive theirs from them.
    MANY = 2

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(often), dtype=np.int64)
        rank[np.lexsort((np.arange(len(often)), often))] = np.arange(len(often))
        owner, token = np.repeat(np.arange(len(sets)), self.size), rank[token]
        by_set = np.lexsort((token, owner))
        ends = np.cumsum(self.size)
        self.ranks = np.split(token[by_set], ends[:-1])
        by_token = np.lexsort((owner, token))
        self.holders, self.begin = owner[by_token], np.searchsorted(token[by_token], np.arange(len(often) + 1))
        pos = np.arange(len(flat)) - np.repeat(ends - self.size, self.size)
        prefix = pos < np.repeat([prefix_length(n, percent) for n in self.size], self.size)
        entry = np.stack([token[by_set], pos, owner[by_set]])[:, prefix]
        self.entry = entry[:, np.lexsort((entry[2], entry[1], entry[0]))]  # a list's entries by position
        self.list = np.searchsorted(self.entry[0], np.arange(len(often) + 1))
        self.bits = np.stack([parity(r.astype(np.uint64)) for r in self.ranks])
        self.leaders: list[int] = []
        self.known: list[np.ndarray] = []
        self.derived = np.zeros(len(sets), dtype=bool)
        self.skipped = 0

    def counted(self, ranks: np.ndarray) -> np.ndarray:
        """For every set, how many of these shingles it holds, by the shingles' index lists."""
        n = self.begin[ranks + 1] - self.begin[ranks]
        at = np.repeat(self.begin[ranks] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.holders[at], minlength=len(self.size))

    def candidates(self, x: int) -> np.ndarray:
        """Sets that share a first shingle of x at positions that still allow the overlap; blocks that don't are skipped."""
        n, found = self.size[x], []
        for pos, rank in enumerate(self.ranks[x][: prefix_length(n, self.percent)]):
            low, high = self.list[rank], self.list[rank + 1]
            for at in range(low, high, self.ENTRIES):
                end = min(at + self.ENTRIES, high)
                q, who = self.entry[1, at:end], self.entry[2, at:end]
                m = self.size[who]
                most = 1 + min(pos, q[-1]) + min(n - pos - 1, (m.max() - q[0] - 1))
                if most < need(n, m.min(), self.percent):
                    self.skipped += 1
                    continue  # the whole block
                fits = (1 + np.minimum(pos, q) + np.minimum(n - pos - 1, m - q - 1) >= need(n, m, self.percent)) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))
                found.append(who[fits])
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def overlaps(self, x: int) -> np.ndarray | None:
        """x's overlaps with all sets, derived from those of a leader that differs in few shingles; None without such a leader."""
        if not self.leaders:
            return None
        apart = np.bitwise_count(self.bits[self.leaders] ^ self.bits[x]).sum(axis=1)
        k = int(apart.argmin())
        if 4 * apart[k] > self.size[x]:
            return None
        mine, its = self.ranks[x], self.ranks[self.leaders[k]]
        more, less = np.setdiff1d(mine, its, assume_unique=True), np.setdiff1d(its, mine, assume_unique=True)
        if 2 * (len(more) + len(less)) > len(mine):
            return None
        self.derived[x] = True
        return self.known[k] + self.counted(more) - self.counted(less)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of linked sets, each once or twice."""
        found = []
        for x in range(len(self.size)):
            if (both := self.overlaps(x)) is not None:
                hit = np.flatnonzero(both >= need(self.size[x], self.size, self.percent))
            else:
                near = self.candidates(x)
                if len(near) > self.MANY:
                    both = self.counted(self.ranks[x])
                    self.leaders.append(x)
                    self.known.append(both)
                    hit = np.flatnonzero(both >= need(self.size[x], self.size, self.percent))
                else:
                    both = np.array([len(np.intersect1d(self.ranks[x], self.ranks[j], assume_unique=True)) for j in near], dtype=np.int64)
                    hit = near[both >= need(self.size[x], self.size[near], self.percent)]
            found.append((np.full(len(hit), x), hit))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def region_links(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b, derived): documents a, with a document b that they are linked with directly or by a path; derived: whether a's answers came from a similar set's."""

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in g.groupby("region").indices.values():
            doc, tile = g.doc_id.to_numpy()[at], Tile([np.frombuffer(x, dtype=np.uint64) for x in g.shingles.to_numpy()[at]], percent)
            root = roots(len(at), *tile.links())
            rest = root != np.arange(len(at))
            out.append(pd.DataFrame({"a": doc[rest], "b": doc[root[rest]], "derived": tile.derived[rest]}))
        return pd.concat(out)

    return tiled(placed).groupBy("cell", "lo", "hi").applyInPandas(compare, "a long, b long, derived boolean")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text, ...) without text, with n_shingles and component_id.

    Words are split at the contract's white space and A-Z lower-cased; a document with fewer than `words` words has
    the whole sequence as its one shingle, and one without any (or with null text) has none and links with nothing.
    A row with a null doc_id has its n_shingles, no component and no links. Rows of one doc_id are one document in
    components, whatever their texts, but each has its own n_shingles; every row comes back, repeated ones too;
    columns that clash with the new names are left out; an empty table gives no rows. Shingles are told apart by
    64-bit hashes, equal sets by 128 bits.
    """
    rest = free_of(docs, "doc_id", "text", "n_shingles", "component_id", *INNER)
    texts = short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    read = stored(read_sets(short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *rest, "text")), words), "sets")
    rows = stored(read.where("_task IS NULL").drop("_task", "_slice", "_counts"), "rows")
    ids = rows.select("doc_id", F.col("_n").alias("n"), F.col("_s1").alias("s1"), F.col("_s2").alias("s2")).where("doc_id IS NOT NULL")
    shingled = rows.agg(F.sum("_n")).first()[0] or 0
    sketch = summed_slices(read.where("_task IS NOT NULL").select(*(F.col(f"_{c}").alias(c) for c in ("task", "slice", "counts"))), shingled)
    discard(read)
    index = stored(index_lists(index_entries(texts, sketch, words, percent)), "index")
    edges = stored(short_list_pairs(index, percent).union(long_lists(index, percent)), "near")
    discard(index)
    classes = stored(ids.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max("n").alias("n")), "classes")
    wanted = stored(placed_sets(classes, edges), "wanted")
    links = region_links(wanted_sets(texts, wanted, words), percent)
    # documents whose rows differ in text are in several classes
    several = ids.groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("one"), F.max(F.struct("s1", "s2")).alias("other")).where("one <> other").select("doc_id")
    several = stored(ids.where("n > 0").join(several, "doc_id").distinct().join(classes.select("s1", "s2", "first"), ["s1", "s2"]).select("doc_id", "first"), "several")
    links = stored(links.select("a", "b", "derived").union(several.select("doc_id", "first", F.lit(False))), "links")
    parts = components(links)
    discard(edges, wanted)
    # only rows of classes that are linked, or that several documents are in, can have another component than their own
    named = classes.join(parts.select(F.col("node").alias("first"), "component"), "first", "left").where("component IS NOT NULL OR first < last")
    named = named.select(F.col("s1").alias("_s1"), F.col("s2").alias("_s2"), F.coalesce("component", "first").alias("_linked"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("_linked", "doc_id"))
    out = rows.join(named, ["_s1", "_s2"], "left").select("doc_id", *rest, F.col("_n").alias("n_shingles"), own.alias("component_id"))
    if several.isEmpty():
        return out
    again = several.join(parts, F.col("first") == F.col("node")).groupBy(F.col("doc_id").alias("_doc")).agg(F.min("component").alias("_whole"))
    return out.join(again, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", *rest, "n_shingles", F.coalesce("_whole", "component_id").alias("component_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir).select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[r.i:r.i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 1, 2))) AS r(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 90 * (x.n + y.n - k)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT c.a AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM c LEFT JOIN n ON n.doc_id = c.a
"""
