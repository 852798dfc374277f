"""Cohorts: checks, episodes and the coverage estimate, each one pass over the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.dates import shared_format
from .functions.recode import id_text
from .shared import numbered

REQUIRED = ("pid", "startDate", "endDate", "longitude", "latitude")
#: west, south, east, north of the contiguous states, for coverage.  Fixed values.
CONUS = (-125.0, 24.0, -66.0, 50.0)


def validate(df: DataFrame) -> DataFrame:
    """(check, level, n): how many rows fail each check; a missing column is one row of its own."""
    spark = df.sparkSession
    names = {c.lower(): c for c in df.columns}
    names.setdefault("pid", names.get("patid", "pid"))
    absent = [c for c in REQUIRED if names.get(c.lower()) not in df.columns]
    if absent:
        return spark.createDataFrame([("missing_columns", "error", len(absent))], "check string, level string, n long")
    col = lambda c: F.trim(F.col(names[c.lower()]).cast("string"))
    number = lambda c: F.expr(f"try_cast(`{names[c.lower()]}` as double)")
    blank = lambda c: F.coalesce(col(c) == "", F.lit(True))
    fmt = shared_format(df.select(col("startDate").alias("s"), col("endDate").alias("e")), "s", "e")
    date = lambda c: F.try_to_timestamp(col(c), F.lit(fmt or "yyyy-MM-dd")).cast("date")
    lon, lat = number("longitude"), number("latitude")
    checks = {
        ("pid_missing", "error"): blank("pid"),
        ("coord_missing", "error"): blank("longitude") | blank("latitude"),
        ("coord_not_numeric", "error"): (~blank("longitude") & lon.isNull()) | (~blank("latitude") & lat.isNull()),
        ("coord_range", "error"): F.coalesce((F.abs(lon) > 180) | (F.abs(lat) > 90), F.lit(False)),
        ("date_format", "error"): F.lit(fmt is None) & ~(blank("startDate") & blank("endDate")),
        ("date_order", "error"): F.coalesce(date("startDate") > date("endDate"), F.lit(False)),
        ("date_timezone", "error"): F.lit(any(t == "timestamp" and c.lower() in ("startdate", "enddate") for c, t in df.dtypes)),
        ("date_missing", "warning"): blank("startDate") | blank("endDate"),
        ("episode_id_overwritten", "warning"): F.lit("episode_id" in names),
    }
    row = df.agg(F.when(F.count("*") == 0, 1).otherwise(0).alias("empty"), *[F.count_if(v).alias(k) for (k, _), v in checks.items()])
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.lit(v).alias("level"), F.col(k).cast("long").alias("n")) for k, v in [("empty", "error"), *checks]]))
    return row.select(listed.alias("r")).select("r.*").filter("n > 0")


def episodes(df: DataFrame) -> DataFrame:
    """pid, episode_id, start_date, end_date, lon, lat.  episode_id numbers the input's rows from 0.  Dates with a time zone are refused.
    Columns are found whatever their case; one that is spelt exactly goes before others."""
    found = {c.lower(): c for c in df.columns} | {c.lower(): c for c in REQUIRED if c in df.columns}
    found.setdefault("pid", found.get("patid"))
    absent = [c for c in REQUIRED if not found.get(c.lower())]
    if absent:
        raise ValueError(f"no column {', '.join(absent)}")
    df = df.select(*[df[found[c.lower()]].alias(c) for c in REQUIRED]) if len({c.lower() for c in df.columns}) == len(df.columns) else df
    zoned = [c for c, t in df.dtypes if t == "timestamp" and c in ("startDate", "endDate")]
    if zoned:
        raise ValueError(f"{', '.join(zoned)}: a date must have no time zone")
    named = df.withColumnRenamed("PATID", "pid") if "pid" not in df.columns else df
    fmt = shared_format(named.select(F.col("startDate").cast("string").alias("s"), F.col("endDate").cast("string").alias("e")), "s", "e")
    if fmt is None:
        raise ValueError("the dates do not share one format")
    plain = named.select(id_text(F.col("pid")).alias("pid"), F.col("startDate").cast("string"), F.col("endDate").cast("string"), F.col("longitude").cast("double"), F.col("latitude").cast("double"))
    out = numbered(plain, "episode_id")
    date = lambda c: F.try_to_timestamp(F.trim(c), F.lit(fmt)).cast("date")
    return out.select("pid", "episode_id", date("startDate").alias("start_date"), date("endDate").alias("end_date"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))


def bad_rows(df: DataFrame, bad: Column, top: int = 20) -> list[int]:
    """The first row numbers, from 1, for which a check fails."""
    marked = numbered(df.select(bad.alias("bad")), "row").filter("bad")
    return [r.row + 1 for r in marked.orderBy("row").limit(top).collect()]


def sampled(df: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows without replacement, the same for a seed and an order of rows."""
    return df.orderBy(F.rand(seed)).limit(n)


def in_region(lon: Column, lat: Column) -> Column:
    west, south, east, north = CONUS
    return lon.between(west, east) & lat.between(south, north)


def coverage(eps: DataFrame, variables: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """{variable: (first year, last year)}, (None, None) for static ones -> variable, rows, in_time, in_region, covered, pct."""
    region = F.coalesce(in_region(F.col("lon"), F.col("lat")), F.lit(False))
    made = []
    for name, (first, last) in variables.items():
        time = F.lit(True) if first is None else F.coalesce((F.col("start_date") <= F.make_date(F.lit(last), F.lit(12), F.lit(31))) & (F.col("end_date") >= F.make_date(F.lit(first), F.lit(1), F.lit(1))), F.lit(False))
        made.append(F.struct(F.lit(name).alias("variable"), F.count("*").alias("n_rows"), F.count_if(time).alias("in_time"), F.count_if(region).alias("in_region"), F.count_if(time & region).alias("covered")))
    out = eps.agg(F.array(*made).alias("all")).select(F.explode("all").alias("r")).select("r.*")
    return out.withColumn("pct", F.coalesce(F.bround(100.0 * F.col("covered") / F.nullif(F.col("n_rows"), F.lit(0)), 2), F.lit(0.0)))
