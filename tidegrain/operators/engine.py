"""The six operators of the exposure engine over DataFrames; nothing here triggers a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import length_days, overlap_days
from ..functions.weighted import contributing, weighted_mean


def join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join that keeps the left keys only; rows without a left partner get theirs from the right."""
    renamed = right.withColumnsRenamed({k: f"__r{i}" for i, k in enumerate(right_keys)})
    on = F.lit(True)
    for i, k in enumerate(left_keys):
        on = on & (left[k] == renamed[f"__r{i}"])
    out = left.join(renamed, on, how)
    if how in ("right", "full", "outer", "full_outer", "right_outer"):
        out = out.withColumns({k: F.coalesce(F.col(k), F.col(f"__r{i}")) for i, k in enumerate(left_keys)})
    return out.drop(*[f"__r{i}" for i in range(len(right_keys))])


def weighted_aggregate(data: DataFrame, keys: list[str], columns: list[str], weight: str, policy: str = "skip", suffix: str = "") -> DataFrame:
    return data.groupBy(*keys).agg(*[weighted_mean(F.col(c), F.col(weight), policy).alias(c + suffix) for c in columns])


def temporal_aggregate(data: DataFrame, keys: list[str], columns: list[str], days: str = "overlap_days", policy: str = "skip", suffix: str = "", days_suffix: str | None = None) -> DataFrame:
    """Day-weighted means; with days_suffix also the days that took part."""
    more = [contributing(F.col(c), F.col(days), policy).cast("long").alias(c + suffix + days_suffix) for c in columns] if days_suffix else []
    return data.groupBy(*keys).agg(*[weighted_mean(F.col(c), F.col(days), policy).alias(c + suffix) for c in columns], *more)


def simple_aggregate(data: DataFrame, keys: list[str], columns: dict[str, str], order: str | None = None) -> DataFrame:
    """{column: min|max|sum|count|mean|first}; first needs an order column, and takes the least value on a tie."""
    pick = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "mean": F.avg}
    if "first" in columns.values() and order is None:
        raise ValueError("first needs an order column")
    made = [F.min_by(c, F.struct(order, c)).alias(f"{c}_first") if how == "first" else pick[how](c).alias(f"{c}_{how}") for c, how in columns.items()]
    return data.groupBy(*keys).agg(*made)


def date_range_join(episodes: DataFrame, values: DataFrame, key: str, date: str | None = None, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Episodes with the values of their days (date) or of the periods that they meet, and overlap_days.  The episode is an
    equality key, so the range stays a residual condition of a hash or merge join."""
    e = episodes.select("pid", F.col(key).alias("__key"), F.col("start_date").alias("__start"), F.col("end_date").alias("__end"))
    if date:
        on = (values[key] == e["__key"]) & values[date].between(e["__start"], e["__end"])
        return e.join(values, on).withColumn("overlap_days", F.lit(1)).drop("__key", "__start", "__end")
    on = (values[key] == e["__key"]) & (e["__start"] <= values[end]) & (e["__end"] >= values[start])
    days = overlap_days(F.col("__start"), F.col("__end"), F.col(start), F.col(end))
    return e.join(values, on).withColumn("overlap_days", days).drop("__key", "__start", "__end")


def stays(episodes: DataFrame) -> DataFrame:
    """Episodes that last at least a day, with overlap_days."""
    out = episodes.select("pid", "episode_id", length_days(F.col("start_date"), F.col("end_date")).alias("overlap_days"))
    return out.filter("overlap_days > 0")


def duration_weighted(values: DataFrame, episodes: DataFrame, columns: list[str], level: str = "participant", days_suffix: str | None = None) -> DataFrame:
    """Stays LEFT JOIN values per episode, weighted by the length of stay."""
    return temporal_aggregate(stays(episodes).join(values.select("episode_id", *columns), "episode_id", "left"), keys(level), columns, days_suffix=days_suffix)


def participant_means(episodes: DataFrame, columns: list[str], days: str = "overlap_days") -> DataFrame:
    """Day-weighted means of episode means; every participant keeps a row."""
    return episodes.groupBy("pid").agg(*[weighted_mean(F.col(c), F.when(F.col(days) > 0, F.col(days))).alias(c) for c in columns])


def keys(level: str) -> list[str]:
    if level not in ("participant", "episode"):
        raise ValueError(f"level must be participant or episode, not {level!r}")
    return ["pid"] if level == "participant" else ["pid", "episode_id"]
