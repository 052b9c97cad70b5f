"""Best-fit packing planned on the histogram of lengths.

Only how many pieces have each length goes to the driver: at most `capacity` numbers. Best-fit decreasing runs
over these counts, filling whole ranges of like sequences at once, and gives planned slots: so many pieces of a
length, by rank within the length, go to consecutive sequences at one offset. Pieces take their slots by rank.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, short_batches, stored

CAPACITY = 2048
SEPARATOR = 0
#: Beyond these characters the two libraries might split differently, so such texts go to `tokenizers` itself.
UNUSUAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0ɐ-\U0010ffff]")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long"


@functools.cache
def encoder(ranks_path: str, tokenizer_path: str):
    """A function from a text to its ids: those of the tokenizer, by the faster library over the same vocabulary where the text is usual."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path)
    special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if UNUSUAL.search(text) or any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32)

    return encode


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole if they fit, else full pieces after a first one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """The pieces of every text's ids and a separator; chunk and nth: the task that made a piece, and its place among that task's pieces of its length."""
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen, chunk = encoder(*paths), np.zeros(capacity + 1, dtype=np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            for doc, text in zip(b.doc_id, b.text, strict=True):
                ids = np.append(encode(text), np.uint32(separator)).astype("<u4")
                for k, (start, n) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), chunk, seen[n]))
                    seen[n] += 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"])
            yield out.assign(doc_id=out.doc_id.astype("Int64"))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return short_batches(texts).mapInPandas(cut, PIECES)


class Slots(NamedTuple):
    """The pieces of `length` with ranks rank .. rank + n - 1 go to sequences sequence .. sequence + n - 1, at `offset`."""

    length: int
    rank: int
    n: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best-fit decreasing over counts: a length goes to the fullest sequences that have room, else to new ones."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space: ranges (first sequence, how many)
    spaces: list[int] = []  # the keys of room, sorted
    out, opened = [], 0

    def leave(space: int, first: int, n: int) -> None:
        if n and space:
            if space not in room:
                bisect.insort(spaces, space)
            room[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect.bisect_left(spaces, length)
            if k < len(spaces):
                space = spaces[k]
                first, n = room[space].pop()
                if not room[space]:
                    del room[space], spaces[k]
            else:
                space, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            deep = space // length  # what best fit would put into the same sequence before it takes another
            whole = min(n, left // deep)
            for j in range(deep if whole else 0):
                out.append(Slots(length, rank, whole, first, capacity - space + j * length))
                rank, left = rank + whole, left - whole
            leave(space - deep * length, first, whole)
            if whole < n and left:
                for j in range(left):  # fewer than deep
                    out.append(Slots(length, rank, 1, first + whole, capacity - space + j * length))
                    rank += 1
                leave(space - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            leave(space, first + whole, n - whole)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, separator: int = SEPARATOR) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all pieces of all rows, in sequences of at most capacity ids.

    Null text is empty, an empty text is the separator alone; a doc_id may be null or come again, and each row is
    packed on its own; an empty table gives no rows. Other columns are ignored.
    """
    cut = stored(pieces(docs, capacity, separator), "pieces")
    counts = cut.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    base = counts.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("chunk")) - F.col("n")).drop("n")
    histogram = {r["length"]: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    slots = sorted(plan(histogram, capacity))
    table = np.array(slots, dtype=np.int64).reshape(-1, 5)
    shift = 1 << 44
    keys = table[:, 0] * shift + table[:, 1]

    sent = docs.sparkSession.sparkContext.broadcast((table, keys))  # as many rows as lengths and ranges of them, not pieces

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, keys = sent.value
        for b in batches:
            rank = b.base.to_numpy() + b.nth.to_numpy()
            k = np.searchsorted(keys, b.length.to_numpy() * shift + rank, side="right") - 1
            yield b[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(doc_id=b.doc_id.astype("Int64"), sequence_id=table[k, 3] + rank - table[k, 1], offset=table[k, 4])

    return cut.join(base, ["length", "chunk"]).mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))
