"""Registered datasets: prepared tables in a folder, one sub-folder each, with what is known of them in a one-row table beside."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import albers
from ..shared import small_side
from .rasters import REGISTERED_BOX
from .rings import repaired
from .vectors import projected

KINDS = ("table", "raster", "features")


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def register(df: DataFrame, folder: str, name: str, kind: str, info: dict | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df as folder/name/values, split by the columns `by`, and folder/name/about; a name that is taken is refused."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    spark = df.sparkSession
    about, fs = _path(spark, folder, name, "about", "_SUCCESS")
    if fs.exists(about):
        raise ValueError(f"a dataset {name!r} is registered already")
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(f"{folder}/{name}/values")
    row = spark.createDataFrame([(name, kind, json.dumps(info or {}, sort_keys=True))], "name string, kind string, info string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}/about")  # last: without it the dataset does not exist
    return dataset(spark, folder, name)


def dataset(spark: SparkSession, folder: str, name: str) -> DataFrame:
    about, fs = _path(spark, folder, name, "about", "_SUCCESS")
    if not fs.exists(about):
        raise ValueError(f"no dataset {name!r}")
    return spark.read.parquet(f"{folder}/{name}/values")


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """(name, kind, info) of all."""
    top, fs = _path(spark, folder)
    found = [s.getPath().toString() for s in (fs.listStatus(top) if fs.exists(top) else [])]
    held = [f"{p}/about" for p in found if fs.exists(_path(spark, p, "about", "_SUCCESS")[0])]
    return spark.read.parquet(*held) if held else spark.createDataFrame([], "name string, kind string, info string")


def remove(spark: SparkSession, folder: str, name: str) -> None:
    for part in ("about", "values"):
        path, fs = _path(spark, folder, name, part)
        fs.delete(path, True)
    path, fs = _path(spark, folder, name)
    fs.delete(path, True)


def prepared_features(shapes: DataFrame, year: str | None = None) -> DataFrame:
    """Shapes in degrees -> in metres, of one family, areas or lines, with a year if named, rings that cross made over; fails if none touches
    the contiguous states."""
    shapes = repaired(shapes)
    west, south, east, north = REGISTERED_BOX
    here = lambda p: p["x"].between(west, east) & p["y"].between(south, north)
    touches = F.exists(F.flatten(F.concat("rings", "lines")), here)
    row = shapes.agg(F.count_if(F.size("rings") > 0).alias("areas"), F.count_if(F.size("lines") > 0).alias("lines"), F.max(touches).alias("touches")).first()
    if row.areas and row.lines:
        raise ValueError("features must be either areas or lines and points")
    if not row.touches:
        raise ValueError("no feature touches the contiguous states")
    out = projected(shapes, albers)
    return out.withColumn("year", F.col("properties")[year].cast("int")) if year else out


def labelled(df: DataFrame, labels: DataFrame, column: str = "name") -> DataFrame:
    """The columns that a table of labels names, in its order; what df does not have is left out."""
    names = [r[0] for r in labels.select(column).limit(10_000).collect()]
    return df.select(*[n for n in names if n in df.columns])


def restricted(values: DataFrame, weights: DataFrame, first: int = 2013) -> DataFrame:
    """Yearly values from a year on, of the units that some weight has."""
    return values.filter(F.col("year") >= first).join(small_side(weights.select("unit").distinct()), "unit", "left_semi")
