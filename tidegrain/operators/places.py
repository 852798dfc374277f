"""Points that stand at one place are measured once.

Households, clinics and rounded coordinates put many episodes at one place.  Whatever is measured at a place is the same for all of them, so
operators measure distinct places and give each point the rows of its place at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Scratch, small_side


def spots_of(points: DataFrame, key: str = "episode_id") -> tuple[DataFrame, DataFrame]:
    """(rows, keys): rows(key, x, y) are the distinct places of points(key, x, y) under a bigint in place of the key, keys(key, __spot) says which
    key is where.  Keys without a place share one, whose x and y are missing; a key with several places has them to itself."""
    scratch = Scratch(points.sparkSession, "places", lean=True)
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    at = points.select(key, F.when(known, F.col("x")).alias("x"), F.when(known, F.col("y")).alias("y"))
    ends = at.groupBy(key).agg(F.min("x").alias("x"), F.max("x").alias("x1"), F.min("y").alias("y"), F.max("y").alias("y1"))
    ends = scratch.written(ends.select(key, "x", "y", (~(F.col("x").eqNullSafe(F.col("x1")) & F.col("y").eqNullSafe(F.col("y1")))).alias("several")), "ends")
    one = ends.filter("not several").select(key, "x", "y")
    spots = scratch.written(one.select("x", "y").distinct().withColumn("__spot", F.monotonically_increasing_id()), "spots")
    named = spots.select("__spot", F.col("x").alias("__x"), F.col("y").alias("__y"))
    keys = one.join(small_side(named), F.col("x").eqNullSafe(F.col("__x")) & F.col("y").eqNullSafe(F.col("__y"))).select(key, "__spot")
    rows = spots.select(F.col("__spot").alias(key), "x", "y")
    several = ends.filter("several").select(key)
    if not several.isEmpty():
        several = scratch.written(several.withColumn("__spot", -1 - F.monotonically_increasing_id()), "several")
        keys = keys.unionByName(several)
        rows = rows.unionByName(at.filter(known).join(several, key).select(F.col("__spot").alias(key), "x", "y"))
    return rows, keys


def by_place(points: DataFrame, measure: Callable[[DataFrame], DataFrame], key: str = "episode_id") -> DataFrame:
    """measure(points(key, x, y)) with its rows for every key, measured once for each distinct place; see spots_of()."""
    rows, keys = spots_of(points, key)
    measured = measure(rows)
    return keys.join(measured.withColumnRenamed(key, "__spot"), "__spot").select(*measured.columns)
