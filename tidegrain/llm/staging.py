"""Shared-folder tables, running sums over a global order, and ids for Python workers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import Scratch, partitions, shared_dir, small_side, written

__all__ = ["Scratch", "id_columns", "ids", "partitions", "running_sums", "shared_dir", "small_side", "unused", "written"]


def id_columns(docs: DataFrame) -> list[Column]:
    """doc_id for a Python worker: pandas turns a batch of longs with nulls into floats, so nulls travel as a flag."""
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("no_id")]


def ids(batch: pd.DataFrame) -> pd.arrays.IntegerArray:
    """The doc_ids of a batch of id_columns(), nulls in place and every digit kept."""
    return pd.arrays.IntegerArray(batch.doc_id.to_numpy(np.int64), batch.no_id.to_numpy(bool))


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column], within: str | None = None, name: str = "runs", scratch: Scratch | None = None) -> DataFrame:
    """Adds, for each (alias, value) of sums, the exclusive running sum of value over `order`; `within` restarts it for
    each value of that column, which must then lead the order.

    Range partitions of the whole order, one written table, totals by partition, and windows inside the partitions: a
    hot key is spread over as many tasks as its rows need.  Equal rows share no position; which gets which is the same
    to any reader, as they are equal.
    """
    spark = df.sparkSession
    base = df.select("*", *[v.cast("long").alias(f"__v_{a}") for a, v in sums.items()])
    dealt = base.repartitionByRange(partitions(spark), *order).withColumn("__part", F.spark_partition_id())
    dealt = (scratch.written if scratch else written)(dealt, name)
    keys = [within] if within else []
    totals = dealt.groupBy("__part", *keys).agg(*[F.sum(f"__v_{a}").alias(f"__t_{a}") for a in sums])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition (and for each key that it holds)
    offsets = totals.select(F.col("__part").alias("__p"), *[F.col(k).alias("__k") for k in keys], *[F.coalesce(F.sum(f"__t_{a}").over(before), F.lit(0)).alias(f"__o_{a}") for a in sums])
    at = F.col("__part") == F.col("__p")
    if within:
        at &= F.col(within).eqNullSafe(F.col("__k"))
    inner = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumns({f"__r_{a}": F.coalesce(F.sum(f"__v_{a}").over(inner), F.lit(0)) for a in sums})
    out = run.join(small_side((scratch.written if scratch else written)(offsets, f"{name}-offsets")), at)
    return out.withColumns({a: F.col(f"__r_{a}") + F.col(f"__o_{a}") for a in sums}).select(*df.columns, *sums)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with a prefix that no column of df has, in upper or lower case."""
    prefix = "__"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    return [prefix + n for n in names]
