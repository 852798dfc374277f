"""Which days a file stands for: dates in names, manifests, and the ends of two-week periods.  Files are few: one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import year_end, year_start
from .tables import TRACT_DATE_FORMATS, period_from_name, read_table

#: Days of a two-week period: at most, and at most when a manifest gives both ends.  Fixed values.
MOST, MOST_GIVEN = 16, 31


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, start_date, end_date) of the files whose names tell a period, by start; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    doy = F.regexp_extract(name, r"(?<![A-Za-z0-9])A(\d{4})(\d{3})(?!\d)", 0)
    day = F.when(doy != "", F.date_add(F.make_date(F.substring(doy, 2, 4).cast("int"), F.lit(1), F.lit(1)), F.substring(doy, 6, 3).cast("int") - 1))
    start, end = period_from_name(name)
    out = found.select("path", name.alias("name"), F.coalesce(day, start).alias("start_date"), F.coalesce(day, end).alias("end_date"))
    return out.filter("start_date is not null").orderBy("start_date", "path")


def met_by(found: DataFrame, first: Column, last: Column) -> DataFrame:
    """The files whose period meets first .. last."""
    return found.filter((F.col("start_date") <= last) & (F.col("end_date") >= first))


def with_manifest(found: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """The periods of a CSV manifest (file, start[, end] or file, year) in place of those in the names; every file must be in it."""
    rows = read_table(spark, path)
    date = lambda c: F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("date") for f in TRACT_DATE_FORMATS])
    if "year" in rows.columns:
        y = F.col("year").cast("int")
        given = rows.select(F.col("file").alias("name"), year_start(y).alias("start_date"), year_end(y).alias("end_date"))
    else:
        given = rows.select(F.col("file").alias("name"), date("start").alias("start_date"), (date("end") if "end" in rows.columns else F.lit(None).cast("date")).alias("end_date"))
    out = found.select("path", "name").join(given, "name", "full")
    wrong = out.filter("path is null or start_date is null").limit(20).collect()
    if wrong:
        raise ValueError(f"manifest and files differ: {', '.join(sorted(r.name for r in wrong))}")
    return out


def two_week_ends(starts: DataFrame) -> DataFrame:
    """(start_date[, end_date]) + end_date: a missing end is the day before the next start, within MOST days; before a gap, within
    the usual step of the series; of the last period the 15th, the end of the month, or 13 days on.  Overlaps fail."""
    order = Window.partitionBy().orderBy("start_date")
    known = F.col("end_date") if "end_date" in starts.columns else F.lit(None).cast("date")
    out = starts.withColumn("end_date", known).withColumn("next", F.lead("start_date").over(order))
    out = out.withColumn("step", F.datediff("next", "start_date"))
    steps = F.array_sort(F.collect_list("step").over(Window.partitionBy()))
    usual = F.when(F.size(steps) >= 2, F.greatest(F.lit(1), F.least(F.lit(MOST), F.get(steps, F.floor(F.size(steps) / 2).cast("int")))))
    most = F.when(F.col("step") > MOST, F.coalesce(usual, F.lit(MOST))).otherwise(F.lit(MOST))
    last = F.when(F.dayofmonth("start_date") == 1, F.date_add("start_date", 14)).when(F.dayofmonth("start_date") == 16, F.last_day("start_date")).otherwise(F.date_add("start_date", 13))
    made = F.when(F.col("next").isNull(), last).otherwise(F.least(F.date_add("next", -1), F.date_add(F.col("start_date"), most - 1)))
    days = F.datediff("end_date", "start_date") + 1
    limit = F.when(F.col("given"), F.lit(MOST_GIVEN)).otherwise(F.lit(MOST))
    out = out.withColumn("given", F.col("end_date").isNotNull()).withColumn("end_date", F.coalesce("end_date", made))
    wrong = (days < 1) | (days > limit) | (F.col("next").isNotNull() & (F.col("end_date") >= F.col("next")))
    return out.withColumn("end_date", F.when(wrong, F.raise_error(F.lit("periods overlap or have a wrong length")).cast("date")).otherwise(F.col("end_date"))).drop("next", "step", "given")


def span(episodes: DataFrame) -> DataFrame:
    """(first, last): the days that a cohort reaches over."""
    return episodes.agg(F.min("start_date").alias("first"), F.max("end_date").alias("last"))
