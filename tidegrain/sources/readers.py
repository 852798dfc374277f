"""Readers of exposure values by name.  A reader gives (unit | grid_id | episode_id, period columns, values) as a lazy table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import first_format, year_and_day
from ..functions.recode import no_data, padded
from ..functions.weighted import nan_to_null
from .grid_blocks import grid_cells
from .periods import files
from .rasters import cells
from .tables import TRACT_DATE_FORMATS, read_table

READERS: dict[str, Callable[..., DataFrame]] = {}


def register_reader(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in READERS:
            raise ValueError(f"a reader {name!r} is registered already")
        READERS[name] = f
        return f

    return keep


def get_reader(name: str) -> Callable[..., DataFrame]:
    if name not in READERS:
        raise ValueError(f"no reader {name!r}; registered: {', '.join(sorted(READERS))}")
    return READERS[name]


def outer(frames: list[DataFrame], on: list[str]) -> DataFrame:
    """All rows of all frames, met by the keys."""
    return reduce(lambda a, b: a.join(b, on, "full"), frames)


def _in_years(df: DataFrame, years: list[int] | None, *columns: str) -> DataFrame:
    """Rows whose period starts or ends in one of the years."""
    hit = reduce(lambda a, b: a | b, [F.year(c).isin(years) for c in columns]) if years else F.lit(True)
    return df.filter(hit)


def _wanted(df: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Only the cells that some weight has."""
    return df if weights is None else df.join(weights.select("grid_id").distinct(), "grid_id", "left_semi")


@register_reader("acag")
def acag(spark: SparkSession, path: str, column: str = "value", years: list[int] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(grid_id, start_date, end_date, column): two-week cells from Parquet with a period `YYYYDDD-YYYYDDD`; kept if either end is
    within the least and greatest of the years."""
    raw = read_table(spark, path)
    out = raw.select("grid_id", year_and_day(F.substring("period", 1, 7)).alias("start_date"), year_and_day(F.substring("period", 9, 7)).alias("end_date"), F.col(column).cast("double").alias(column))
    whole = list(range(min(years), max(years) + 1)) if years else None
    return _wanted(_in_years(out, whole, "start_date", "end_date"), weights).filter(F.col(column).isNotNull())


@register_reader("acag_netcdf")
def acag_netcdf(spark: SparkSession, folder: str, column: str = "value", years: list[int] | None = None, weights: DataFrame | None = None, variable: str | None = None) -> DataFrame:
    """The same from NetCDF files, classic or in HDF5, whose names end in `YYYYDDD-YYYYDDD.nc`, cells from 1 at the north-west corner; only the blocks with
    wanted cells are read.  variable: by default the first that is no coordinate."""
    named = spark.read.format("binaryFile").option("pathGlobFilter", "*.nc").load(folder).select("path")
    days = F.regexp_extract("path", r"(\d{7}-\d{7})\.nc$", 1)
    dated = named.filter(days != "").select("path", year_and_day(F.substring(days, 1, 7)).alias("start_date"), year_and_day(F.substring(days, 9, 7)).alias("end_date"))
    whole = list(range(min(years), max(years) + 1)) if years else list(range(2013, 2020))
    found = _in_years(dated, whole, "start_date", "end_date")
    return grid_cells(spark, found, variable, weights, 1, ("start_date", "end_date"), column).select("grid_id", "start_date", "end_date", column)


@register_reader("vnl")
def vnl(spark: SparkSession, folder: str, years: list[int] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(grid_id, start_date, end_date, vnl) from GeoTIFFs by year or months; cells count from 1."""
    found = _in_years(files(spark, folder, "*.tif*"), years, "start_date", "end_date")
    return cells(spark, found, {"vnl": 1}, weights, 1, ("start_date", "end_date"))


@register_reader("noise")
def noise(spark: SparkSession, paths: dict[str, str], weights: DataFrame | None = None) -> DataFrame:
    """(grid_id, one column for each file) of rasters on one grid, which is checked; cells count from 0."""
    from .rasters import grids

    seen = grids(spark, list(paths.values())).agg(*[(F.max(c) - F.min(c)).alias(c) for c in ("x0", "y0", "cell", "width", "height")]).first()
    if any(abs(d) > 1e-9 for d in seen):
        raise ValueError("the rasters do not share one grid")
    one = lambda name, p: cells(spark, spark.createDataFrame([(p,)], "path string"), {name: 1}, weights)
    return outer([one(name, p) for name, p in paths.items()], ["grid_id"])


@register_reader("temis")
def temis(spark: SparkSession, path: str, features: list[str], years: list[int] | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(grid_id, date, features) from Parquet by feature and year; fill values go, and a feature stored in thousandths is scaled."""
    raw = spark.read.parquet(path).filter(F.col("feature").isin(features))
    raw = raw.filter(F.col("year").isin(years)) if years else raw
    value = no_data(F.col("value").cast("double"), -1000.0)
    scaled = raw.groupBy("feature", "year").agg((F.max(value) > 100).alias("big"))  # one row for each file of the source
    out = raw.join(F.broadcast(scaled), ["feature", "year"]).select("grid_id", "date", "feature", F.when(F.col("big"), value * 0.001).otherwise(value).alias("v"))
    return _wanted(out, weights).groupBy("grid_id", "date").pivot("feature", features).agg(F.first("v", ignorenulls=True))


@register_reader("prism")
def prism(spark: SparkSession, paths: dict[str, list[str]], weights: DataFrame | None = None) -> DataFrame:
    """{variable: files (grid_id, date, value)} -> (grid_id, date, variables): of files of one year a later folder wins."""
    made = []
    for name, given in paths.items():
        by_file = {p.rstrip("/").rsplit("/", 1)[-1]: p for p in given}
        frames = [read_table(spark, p).select("grid_id", F.col("date").cast("date").alias("date"), F.col("value").cast("double").alias(name)) for p in by_file.values()]
        made.append(_wanted(reduce(DataFrame.unionByName, frames), weights))
    return outer(made, ["grid_id", "date"])


@register_reader("prism_part1")
def prism_part1(spark: SparkSession, folders: dict[str, str], weights: DataFrame | None = None) -> DataFrame:
    """{variable: folder of daily zipped rasters} -> (grid_id, date, variables); -9999 and less is missing."""
    frames = []
    for name, folder in folders.items():
        found = cells(spark, files(spark, folder, "*.zip"), {name: 1}, weights, 0, ("start_date",))
        frames.append(found.select("grid_id", F.col("start_date").alias("date"), no_data(F.col(name), below=-9999.0).alias(name)).filter(F.col(name).isNotNull()))
    return outer(frames, ["grid_id", "date"])


@register_reader("modis_ndvi")
def modis_ndvi(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """(grid_id, start_date, end_date, ndvi): windows that meet 2012 to 2019."""
    raw = read_table(spark, path).select("grid_id", F.col("start_date").cast("date").alias("start_date"), F.col("end_date").cast("date").alias("end_date"), F.col("ndvi").cast("double").alias("ndvi"))
    return _in_years(raw.filter("end_date >= date'2012-01-01' and start_date <= date'2019-12-31'"), years, "start_date", "end_date")


@register_reader("modis_part1")
def modis_part1(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(grid_id, date, ndvi) of product-years; of files of one name the first folder wins."""
    first = {}
    for p in paths:
        first.setdefault(p.rstrip("/").rsplit("/", 1)[-1], p)
    return reduce(DataFrame.unionByName, [read_table(spark, p).select("grid_id", F.col("date").cast("date").alias("date"), F.col("ndvi").cast("double").alias("ndvi")) for p in first.values()])


@register_reader("nhd")
def nhd(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, distances): precomputed, static."""
    df = nan_to_null(read_table(spark, path))
    return df.select("episode_id", *[c for c in df.columns if c.startswith("dist_")])


@register_reader("tiger_roads")
def tiger_roads(spark: SparkSession, path: str, years: list[int] | None = None) -> DataFrame:
    """(episode_id, year, dist_pri, dist_sec, dist_prisec): precomputed by year, in either spelling of the columns."""
    df = nan_to_null(read_table(spark, path)).withColumnsRenamed({"distance_primary": "dist_pri", "distance_secondary": "dist_sec", "distance_prisec": "dist_prisec"})
    df = df.filter(F.col("year").isin(years)) if years else df
    return df.select("episode_id", F.col("year").cast("int").alias("year"), "dist_pri", "dist_sec", "dist_prisec")


@register_reader("faqsd")
def faqsd(spark: SparkSession, o3: dict[int, str], pm25: dict[int, str], weights: DataFrame | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """(unit, date, o3, pm25) from yearly text files, {year: path}: ozone says which days count.  weights(unit): only these tracts.
    No file for any year from `first` to `last` fails."""
    known = set(o3) & set(pm25)
    if first is not None and not known & set(range(first, last + 1)):
        raise FileNotFoundError(f"no yearly file for {first} to {last}; files of {sorted(known) or 'no year'}")

    def one(paths: dict[int, str], name: str) -> DataFrame:
        frames = []
        for p in paths.values():
            raw = read_table(spark, p)
            date, code, value = (raw.columns[k] for k in (0, 1, 4))
            number = F.expr(f"try_cast(try_cast(`{code}` as double) as bigint)")
            frames.append(raw.select(padded(number, 11).alias("unit"), first_format(F.col(date), TRACT_DATE_FORMATS).alias("date"), F.expr(f"try_cast(`{value}` as double)").alias(name)).filter("unit is not null"))
        out = reduce(DataFrame.unionByName, frames)
        return out if weights is None else out.join(weights.select("unit").distinct(), "unit", "left_semi")

    return one(o3, "o3").join(one(pm25, "pm25"), ["unit", "date"], "left")


def dated_table(spark: SparkSession, path: str, weights: DataFrame, first: str, last: str) -> DataFrame:
    """A registered daily table: only units with a weight, and the days first .. last."""
    days = spark.read.parquet(path).filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.join(weights.select("unit").distinct(), "unit", "left_semi")


def rekeyed(weights: DataFrame, code: str, width: int) -> DataFrame:
    """Weights by a boundary's code -> (episode_id, unit, weight), the code as zero-padded text."""
    return weights.select("episode_id", padded(F.col(code), width).alias("unit"), "weight")
