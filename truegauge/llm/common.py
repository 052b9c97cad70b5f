"""Shared folder, scratch tables and small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..plans.scratch import discard, shared_dir, stored  # noqa: F401


#: The white space of the contracts: space and the control characters 9 to 13.
SPACE = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Rows in an Arrow batch of texts: at Spark's usual 10,000, a few long texts more fill an executor.
BATCH_ROWS = 512


def short_batches(df: DataFrame) -> DataFrame:
    """df, in whose session Arrow batches hold BATCH_ROWS rows at most from now on."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def row_ids(df: DataFrame, *order: Column | str) -> DataFrame:
    """df dealt by range of `order`, sorted, with _part and _at: its partition and its place there. Store it before two reads."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    return out.withColumn("_part", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid")


def hash60(*cols: Column | str) -> Column:
    """A hash below 2^60 of the columns' texts, nulls left out; other engines have its parts, too."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 15), 16, 10).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_columns(df: DataFrame, rest: list[str], new: str, fn: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """The columns `rest` of df, untouched, and those of the DDL `new`, which fn makes from each Arrow batch of df."""
    added = T._parse_datatype_string(new)
    schema = T.StructType([df.schema[c] for c in rest] + added.fields)
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [pa.array(x, k) for x, k in zip(fn(b), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + made, names=schema.names)

    return short_batches(df).mapInArrow(run, schema)


def free_of(df: DataFrame, *names: str) -> list[str]:
    """The columns of df whose names don't clash with `names`, in any case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


#: Bits of a filter of document ids: 4 MB, which may go to all executors. Fuller filters let more ids pass, but lose none.
ID_BITS = 1 << 25
ID_PAGE = 1 << 15


def id_slot() -> Column:
    return F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(ID_BITS))


def id_bits(ids: DataFrame) -> np.ndarray:
    """A bitmap of the slots of ids (doc_id), made in pages; ID_BITS bits reach the driver, whatever the input."""

    def mark(g: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(ID_PAGE, dtype=np.uint8)
        bits[g.slot.to_numpy() % ID_PAGE] = 1
        return pd.DataFrame({"page": [g.slot.iloc[0] // ID_PAGE], "bits": [np.packbits(bits).tobytes()]})

    slots = ids.where("doc_id IS NOT NULL").select(id_slot().alias("slot")).distinct()
    out = np.zeros((ID_BITS // ID_PAGE, ID_PAGE // 8), dtype=np.uint8)
    for r in slots.groupBy(F.expr(f"slot div {ID_PAGE}")).applyInPandas(mark, "page long, bits binary").collect():
        out[r.page] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.reshape(-1)


def has_bit(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """rows whose doc_id isn't in the stored table ids (doc_id); a null doc_id stays.

    A filter of ID_BITS bits goes to all tasks, at most 2^19 rows of 64 bits; only rows that it can't tell from ids are
    shuffled for the exact join.
    """
    page, bit = F.expr("slot div 64"), F.expr("shiftleft(1L, cast(slot % 64 as int))")
    some = ids.where("doc_id IS NOT NULL").select(id_slot().alias("slot"))
    pages = stored(some.groupBy(page.alias("_page")).agg(F.bit_or(bit).alias("_bits")), "pages")
    slots = rows.withColumn("_slot", id_slot()).withColumn("_page", F.expr("_slot div 64"))
    met = slots.join(F.broadcast(pages), "_page", "left").withColumn("_met", F.expr("coalesce(_bits & shiftleft(1L, cast(_slot % 64 as int)), 0L) <> 0"))
    apart = met.where("NOT _met").select(*rows.columns)
    return apart.union(met.where("_met").select(*rows.columns).join(ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*rows.columns))
