"""Weighted means with explicit rules for missing values, as Column expressions.  Missing is NULL; normalise NaN first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("skip", "zero", "count_missing", "raise")


def weighted_mean(value: Column, weight: Column, policy: str = "skip") -> Column:
    """skip: a missing value takes no part.  zero: it counts as 0.  count_missing: it adds nothing but its weight stays in the
    denominator, and a group without any value is missing.  raise: the query fails on a missing value."""
    if policy == "skip":
        return F.sum(value * weight) / F.nullif(F.sum(F.when(value.isNotNull(), weight)), F.lit(0.0))
    if policy == "zero":
        return F.sum(F.coalesce(value, F.lit(0.0)) * weight) / F.nullif(F.sum(weight), F.lit(0.0))
    if policy == "count_missing":
        return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))
    if policy == "raise":
        sure = F.when(value.isNull(), F.raise_error(F.lit("missing value")).cast("double")).otherwise(value)
        return F.sum(sure * weight) / F.nullif(F.sum(weight), F.lit(0.0))
    raise ValueError(f"unknown policy {policy!r}; one of {', '.join(POLICIES)}")


def contributing(value: Column, weight: Column, policy: str = "skip") -> Column:
    """The weight that took part in weighted_mean()."""
    return F.coalesce(F.sum(F.when(value.isNotNull(), weight) if policy == "skip" else weight), F.lit(0))


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = {c: t for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in kinds}) if kinds else df


def share_of_group(weight: str, *keys: str) -> Column:
    """weight over its group's sum."""
    from pyspark.sql import Window

    return F.col(weight) / F.nullif(F.sum(weight).over(Window.partitionBy(*keys)), F.lit(0.0))
