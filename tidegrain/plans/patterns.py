"""Linkage patterns: lazy plans from episodes, weights and values to exposures.

episodes(pid, episode_id, start_date, end_date); weights(episode_id, unit, weight); values by unit and period.  Space comes
before time in two aggregations: a mean of means does not associate, so the levels are never merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import overlap_days, year_end, year_start
from ..functions.recode import food_access_flags
from ..functions.weighted import weighted_mean
from ..operators.engine import date_range_join, duration_weighted, keys, temporal_aggregate, weighted_aggregate
from ..operators.engine import keys as keys_of


def episode_years(episodes: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """pid, episode_id, year, overlap_days of every calendar year that an episode meets."""
    known = episodes.filter("start_date is not null and end_date is not null and start_date <= end_date")
    lo, hi = F.year("start_date"), F.year("end_date")
    lo, hi = F.greatest(lo, F.lit(first)) if first else lo, F.least(hi, F.lit(last)) if last else hi
    out = known.withColumn("year", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    return out.select("pid", "episode_id", "year", overlap_days(F.col("start_date"), F.col("end_date"), year_start(F.col("year")), year_end(F.col("year"))).alias("overlap_days"))


def static_areal(episodes: DataFrame, weights: DataFrame, values: DataFrame, columns: list[str], level: str = "participant", days_suffix: str | None = None) -> DataFrame:
    space = weighted_aggregate(weights.join(values, "unit", "left"), ["episode_id"], columns, "weight")
    return duration_weighted(space, episodes, columns, level, days_suffix)


def yearly_areal(episodes: DataFrame, weights: DataFrame, values: DataFrame, columns: list[str] | dict[str, Column], level: str = "participant", first: int | None = None, last: int | None = None, days_suffix: str | None = None) -> DataFrame:
    """values(unit, year, columns).  Every episode that meets a year of the range has a row.  columns: names, or {name: formula over a
    value's columns}, which is worked out where the means are made."""
    return _by_years(episodes, weights, values, ["unit"], columns, level, first, last, days_suffix)


def _by_years(episodes: DataFrame, weights: DataFrame, values: DataFrame, on: list[str], columns: list[str] | dict[str, Column], level: str, first: int | None, last: int | None, days_suffix: str | None = None) -> DataFrame:
    """Weights meet the years of their episode before the values, so no other years are made, and what is left is shuffled once, by participant,
    beside the episodes' years: both means are made where it lands."""
    periods = episode_years(episodes, first, last)
    made = columns if isinstance(columns, dict) else {c: F.col(c) for c in columns}
    carried = [c for c in values.columns if c not in (*on, "year")] if isinstance(columns, dict) else columns
    spans = periods.groupBy("pid", "episode_id").agg(F.min("year").alias("__from"), F.max("year").alias("__to"))
    met = weights.select("episode_id", *on, "weight").join(spans, "episode_id").join(values.select(*on, "year", *carried), on).filter("year between __from and __to")
    rows = periods.unionByName(met.select("pid", "episode_id", "year", "weight", *carried), allowMissingColumns=True).repartition("pid")
    space = rows.groupBy("pid", "episode_id", "year").agg(F.sum("overlap_days").alias("overlap_days"), *[weighted_mean(c, F.col("weight")).alias(name) for name, c in made.items()])
    return temporal_aggregate(space.filter("overlap_days is not null"), keys(level), list(made), days_suffix=days_suffix)


def areal_by_place(episodes: DataFrame, keys: DataFrame, weights: DataFrame, values: DataFrame, columns: list[str], level: str = "participant", yearly: bool = False) -> DataFrame:
    """static_areal() or yearly_areal() with weights of places; keys(episode_id, __spot) says which place is whose.  Means in space are made once
    for each place."""
    space = weighted_aggregate(weights.join(values, "unit", "inner" if yearly else "left"), ["episode_id", "year"] if yearly else ["episode_id"], columns, "weight")
    space = space.withColumnRenamed("episode_id", "__spot")
    if not yearly:
        return duration_weighted(keys.join(space, "__spot").drop("__spot"), episodes, columns, level)
    periods = episode_years(episodes).join(keys, "episode_id", "left").join(space, ["__spot", "year"], "left")
    return temporal_aggregate(periods, keys_of(level), columns)


def yearly_areal_vintage(episodes: DataFrame, weights: DataFrame, values: DataFrame, columns: list[str], level: str = "participant", first: int | None = None, last: int | None = None) -> DataFrame:
    """weights(vintage, episode_id, unit, weight) and values(vintage, unit, year, ...): each vintage meets its own units."""
    return _by_years(episodes, weights, values, ["vintage", "unit"], columns, level, first, last)


def met_periods(episodes: DataFrame, weights: DataFrame, values: DataFrame, daily: bool = True) -> DataFrame:
    """Weights with the values of their unit on the days, or in the periods, that their episode meets."""
    e = episodes.select("episode_id", F.col("start_date").alias("__start"), F.col("end_date").alias("__end"))
    period = F.col("date").between(F.col("__start"), F.col("__end")) if daily else (F.col("__start") <= F.col("end_date")) & (F.col("__end") >= F.col("start_date"))
    return weights.join(e, "episode_id").withColumnRenamed("unit", "__unit").join(values, (F.col("__unit") == F.col("unit")) & period)


def gridded(episodes: DataFrame, weights: DataFrame, values: DataFrame, columns: list[str], level: str = "participant", daily: bool = True, days_suffix: str | None = None) -> DataFrame:
    """values(unit, date, ...) or (unit, start_date, end_date, ...).  Only episodes that meet a period have a row.

    Days outside the episode go before the spatial aggregation: the weights meet their episode first."""
    when = ["date"] if daily else ["start_date", "end_date"]
    space = weighted_aggregate(met_periods(episodes, weights, values, daily).select("episode_id", *when, "weight", *columns).repartition("episode_id"), ["episode_id", *when], columns, "weight")
    return temporal_aggregate(date_range_join(episodes, space, "episode_id", "date" if daily else None), keys(level), columns, days_suffix=days_suffix)


def many_pollutants(episodes: DataFrame, weights: DataFrame, values: DataFrame, names: list[str], level: str = "participant", less: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """values(pollutant, unit, start_date, end_date, value) in one pass, pivoted at the end; less: {new: (a, b)} for a - b."""
    wide = values.groupBy("unit", "start_date", "end_date").pivot("pollutant", names).agg(F.first("value"))
    out = gridded(episodes, weights, wide, names, level, daily=False)
    return out.withColumns({k: F.col(a) - F.col(b) for k, (a, b) in (less or {}).items()})


def fallback(primary: DataFrame, secondary: DataFrame, test: str, columns: list[str], level: str = "participant") -> DataFrame:
    """Episode means with overlap_days: an episode whose test column is missing takes all columns and days from the secondary."""
    other = secondary.select("pid", "episode_id", *[F.col(c).alias(f"__{c}") for c in [*columns, "overlap_days"]])
    both = primary.join(other, ["pid", "episode_id"], "left")
    out = both.select("pid", "episode_id", *[F.when(F.col(test).isNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in [*columns, "overlap_days"]])
    return temporal_aggregate(out.withColumn("overlap_days", F.when(F.col("overlap_days") > 0, F.col("overlap_days"))), keys(level), columns)


def food_access(episodes: DataFrame, weights: DataFrame, values: DataFrame, columns: list[str] | dict[str, Column], level: str = "participant", first: int | None = None, last: int | None = None) -> DataFrame:
    """Mean rates first, flags from the means; every episode has a row."""
    rates = yearly_areal(episodes, weights, values, columns, level, first, last)
    everyone = episodes.select(*keys(level)).distinct()
    return food_access_flags(everyone.join(rates, keys(level), "left"))


def daily_pair(episodes: DataFrame, weights: DataFrame, driving: DataFrame, other: DataFrame, level: str = "participant") -> DataFrame:
    """Two daily series by unit, (unit, date, a) and (unit, date, b); the first says which days count."""
    return gridded(episodes, weights, driving.join(other, ["unit", "date"], "left"), [driving.columns[-1], other.columns[-1]], level)


def precomputed_yearly(episodes: DataFrame, values: DataFrame, columns: list[str], level: str = "participant") -> DataFrame:
    """values(episode_id, year, ...): only episodes that have a value's year."""
    return temporal_aggregate(episode_years(episodes).join(values, ["episode_id", "year"]), keys(level), columns)


def precomputed_static(episodes: DataFrame, values: DataFrame, columns: list[str], level: str = "participant", fill: dict[str, float] | None = None) -> DataFrame:
    out = duration_weighted(values, episodes, columns, level)
    return out.fillna(fill) if fill else out


def merge(partials: list[DataFrame], on: list[str], cohort: DataFrame | None = None, names: list[str] | None = None) -> DataFrame:
    """Full outer join of sources; a column that is taken becomes <column>_<source>_dup; with a cohort, its rows and order."""
    names = names or [str(k) for k in range(len(partials))]
    taken = set(cohort.columns if cohort is not None else on)
    ready = []
    for name, p in zip(names, partials, strict=True):
        new = {c: f"{c}_{name}_dup" for c in p.columns if c not in on and c in taken}
        p = p.withColumnsRenamed(new)
        taken |= set(p.columns)
        ready.append(p)
    if cohort is not None:
        return reduce(lambda a, b: a.join(b, on, "left"), ready, cohort)
    return reduce(lambda a, b: a.join(b, on, "full"), ready)


def linkage_rate(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, units, with_value, pct) in one pass."""
    row = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns])
    made = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col("n").alias("units"), F.col(f"n_{c}").alias("with_value"), F.bround(100.0 * F.col(f"n_{c}") / F.nullif(F.col("n"), F.lit(0)), 2).alias("pct")) for c in columns]))
    return row.select(made.alias("r")).select("r.*")
