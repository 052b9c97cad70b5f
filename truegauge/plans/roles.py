"""Labelled and unlabelled rows of one table, and sums over either."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def one_table(labelled: DataFrame, unlabelled: DataFrame, y: list[str] | str) -> DataFrame:
    """Both samples as one table whose labels are null on unlabelled rows."""
    for c in [y] if isinstance(y, str) else y:
        unlabelled = unlabelled.drop(c)
    return labelled.unionByName(unlabelled, allowMissingColumns=True)


def listed(x) -> list:
    return [] if x is None else [x] if isinstance(x, (str, Column)) else list(x)


def column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def checked(df: DataFrame, y: list, needed: list, by: list) -> DataFrame:
    """df with by, y0.., and the needed columns as c0.. in double; a null or NaN among the needed ones raises when read."""
    whole = []
    for k, c in enumerate(needed):
        v = column(c).cast("double")
        whole.append(F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"null or NaN in input {k}")).cast("double")).otherwise(v).alias(f"c{k}"))
    return df.select(*[column(b) for b in by], *[column(c).cast("double").alias(f"y{k}") for k, c in enumerate(y)], *whole)


def by_names(df: DataFrame, by) -> tuple[DataFrame, list[str]]:
    """df and the names of its grouping columns; expressions get names by0, by1, .."""
    by = listed(by)
    names = [b if isinstance(b, str) else f"by{k}" for k, b in enumerate(by)]
    return df.withColumns({n: b for n, b in zip(names, by, strict=True) if not isinstance(b, str)}), names


def finished(moments: DataFrame, by: list[str], schema: str, fn) -> DataFrame:
    """The rows (tuples after `schema`) that fn makes of each row of aggregated moments, after the grouping columns.

    moments has a row for each group, however much was aggregated, so this is the cheap end of a plan.
    """
    kinds = T.StructType([moments.schema[b] for b in by] + T._parse_datatype_string(schema).fields)

    def run(batches):
        for g in batches:
            rows = [(*(r[b] for b in by), *x) for r in g.to_dict("records") for x in fn(r)]
            yield pd.DataFrame(rows, columns=kinds.names)

    return moments.mapInPandas(run, kinds)
