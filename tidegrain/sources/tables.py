"""Tables in and out.  A reader's format is pinned by the suffix; ids stay text."""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import first_format
from ..functions.weighted import nan_to_null
from .r_tables import frame


def read_table(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Parquet, CSV and text with a header, all columns as text, or pickled frames and R's, one task for each file.  key: of several tables
    in one file of R.  A pickle runs what it holds: read only your own."""
    if path.endswith((".csv", ".txt", ".csv.gz")):
        return spark.read.csv(path, header=True, inferSchema=False)
    if path.endswith(".parquet"):
        return nan_to_null(spark.read.parquet(path))
    if path.endswith((".pkl", ".pickle")):
        return nan_to_null(_framed(spark, path, lambda content: pickle.load(io.BytesIO(content))))
    if path.lower().endswith((".rds", ".rda", ".rdata")):
        return nan_to_null(_framed(spark, path, lambda content: frame(content, key)))
    raise ValueError(f"no reader for {path!r}: .parquet, .csv, .txt, .pkl, .pickle, .rds or .rda")


def _framed(spark: SparkSession, path: str, load: Callable[[bytes], pd.DataFrame]) -> DataFrame:
    """Tasks read the files and the driver sees one row of one of them, for the names and types of the columns."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def first(batches):
        for batch in batches:
            for content in batch.content:
                yield pd.DataFrame({"head": [pickle.dumps(load(content).head(1))]})
                return

    head = pickle.loads(files.mapInPandas(first, "head binary").first().head)
    schema = spark.createDataFrame(head).schema

    def rows(batches):
        for batch in batches:
            for content in batch.content:
                whole = load(content)
                for k in range(0, len(whole), 100_000):
                    yield whole.iloc[k : k + 100_000]

    return files.mapInPandas(rows, schema)


def read_all(spark: SparkSession, paths: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_table(spark, p) for p in paths]) if paths else spark.createDataFrame([], "empty int").drop("empty")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def weights_of(df: DataFrame, key: str, weight: str = "weight") -> DataFrame:
    """episode_id, unit, weight; an older column name `value` is taken for the weight."""
    df = df.withColumnRenamed("value", weight) if weight not in df.columns and "value" in df.columns else df
    return df.select("episode_id", F.col(key).alias("unit"), F.col(weight).cast("double").alias("weight"))


def period_from_name(name: Column) -> tuple[Column, Column]:
    """(start, end) from a file name: YYYYDDD-YYYYDDD, YYYYMM-YYYYMM, YYYYMMDD or YYYY."""
    from ..functions.dates import year_and_day, year_end, year_start

    part = lambda p, k=1: F.nullif(F.regexp_extract(name, p, k), F.lit(""))
    doy, months, day, year = r"(\d{7})-(\d{7})", r"(?<!\d)(\d{6})-(\d{6})(?!\d)", r"(?<!\d)(\d{8})(?!\d)", r"(?<!\d)(\d{4})(?!\d)"
    month = lambda k: F.try_to_timestamp(part(months, k), F.lit("yyyyMM")).cast("date")
    whole = F.try_to_timestamp(part(day), F.lit("yyyyMMdd")).cast("date")
    y = part(year).cast("int")
    return F.coalesce(year_and_day(part(doy)), month(1), whole, year_start(y)), F.coalesce(year_and_day(part(doy, 2)), F.last_day(month(2)), whole, year_end(y))


#: Marks of a missing value and date formats of registered tables.  Fixed values.
MISSING = ("", "NA", "N/A", "NULL", "NAN", ".")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
#: Date formats of the daily tract files.
TRACT_DATE_FORMATS = ("yyyy/MM/dd", "MMM-dd-yyyy", "yyyy-MM-dd", "M/d/yyyy")
#: Years that a table may hold; share of entries that may fail to be numbers.
YEARS, TOLERANCE = (1900, 2100), 0.5


def clean(text: Column) -> Column:
    bare = F.trim(text.cast("string"))
    return F.when(~F.upper(bare).isin(*MISSING), bare)


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded CSV with a header, all columns as text: UTF-8, or Latin-1 if some bytes are no UTF-8; names trimmed and without the mark of
    the byte order; blank rows and columns without a name go.  A file without names or rows is refused."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    raw = spark.read.csv(path, header=True, inferSchema=False, encoding="ISO-8859-1" if bad else "UTF-8", quote='"', escape='"', multiLine=True)
    unnamed = [c for k, c in enumerate(raw.columns) if not c.strip(" \ufeff") or c == f"_c{k}"]
    if len(unnamed) == len(raw.columns):
        raise ValueError("the first line has no column names")
    some = F.greatest(F.lit(False), *[F.coalesce(F.trim(F.col(f"`{c}`")) != "", F.lit(False)) for c in raw.columns])
    rows = raw.filter(some).select(*[F.col(f"`{c}`").alias(c.strip(" \ufeff")) for c in raw.columns if c not in unnamed])
    if rows.isEmpty():
        raise ValueError("the file has a header but no data rows")
    return rows


#: Rows that a preview shows, rows whose values are sampled, and values of a sample.
SHOWN, SAMPLED, SAMPLE = 5, 200, 5


def preview(raw: DataFrame) -> DataFrame:
    """(place, name, rows, numeric, least, most) of every column, in one pass: numeric if it has entries and all of them are numbers or marks of
    missing ones; the range of a numeric column by value, not by text."""
    names = raw.columns
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit(""))
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    told = [F.struct(F.lit(k).alias("place"), F.lit(c).alias("name"), F.count("*").alias("rows"), ((F.count(text(c)) > 0) & (F.count_if(clean(text(c)).isNotNull() & number(c).isNull()) == 0)).alias("numeric"),
                     F.min(F.when(clean(text(c)).isNotNull(), number(c))).alias("least"), F.max(F.when(clean(text(c)).isNotNull(), number(c))).alias("most")) for k, c in enumerate(names)]
    row = raw.agg(*[t.alias(f"c{k}") for k, t in enumerate(told)])
    out = row.select(F.explode(F.array(*[F.col(f"c{k}") for k in range(len(names))])).alias("c")).select("c.*")
    return out.withColumns({c: F.when(F.col("numeric"), F.col(c)) for c in ("least", "most")})


def sampled(raw: DataFrame) -> dict[str, list[str]]:
    """A few distinct entries of each column from the head of the table."""
    head = [r.asDict() for r in raw.limit(SAMPLED).collect()]  # the rows that a person looks at
    return {c: sorted({(r[c] or "").strip() for r in head} - {""})[:SAMPLE] for c in raw.columns}


def registered_table(raw: DataFrame, key: str, width: int, values: list[str], year: str | None = None, date: str | None = None) -> DataFrame:
    """Text columns -> unit[, year | date], doubles; sorted by key and period inside partitions."""
    from ..functions.recode import padded

    when = [F.try_to_number(clean(F.col(year)), F.lit("9999")).cast("int").alias("year")] if year else [first_format(clean(F.col(date)), DATE_FORMATS).alias("date")] if date else []
    out = raw.select(padded(clean(F.col(key)), width).alias("unit"), *when, *[F.expr(f"try_cast(`{v}` as double)").alias(v) for v in values])
    return nan_to_null(out).sortWithinPartitions(*out.columns[: 1 + len(when)])


def table_report(raw: DataFrame, key: str, width: int, values: list[str], year: str | None = None, date: str | None = None) -> DataFrame:
    """One row: rows, blank and ill-formed keys, keys one digit short, unusable years or dates, duplicates by key (and
    period), and for each value the entries that are missing and that are no numbers."""
    k = clean(F.col(key))
    bad = lambda v: F.count_if(clean(F.col(v)).isNotNull() & F.expr(f"try_cast(`{v}` as double)").isNull())
    period = None
    if year:
        y = F.expr(f"try_cast(trim(`{year}`) as double)")
        period = F.when((y == F.floor(y)) & y.between(*YEARS), y.cast("int"))
    elif date:
        d = first_format(clean(F.col(date)), DATE_FORMATS)
        period = F.when(F.year(d).between(*YEARS), d)
    whole = F.struct(k, period) if period is not None else k
    return raw.agg(
        F.count("*").alias("n_rows"), F.count_if(k.isNull()).alias("blank_keys"), F.count_if(k.isNotNull() & ~k.rlike(f"^[0-9]{{{width}}}$")).alias("bad_keys"),
        F.count_if(k.rlike(f"^[0-9]{{{width - 1}}}$")).alias("short_keys"), (F.count_if(period.isNull()) if period is not None else F.lit(0).cast("long")).alias("bad_periods"),
        (F.count(k) - F.countDistinct(F.when(k.isNotNull(), whole))).alias("repeated_keys"),
        *[F.count_if(clean(F.col(v)).isNull()).alias(f"{v}_missing") for v in values], *[bad(v).alias(f"{v}_not_numbers") for v in values],
    )


def numeric_columns(raw: DataFrame, taken: list[str]) -> list[str]:
    """Columns besides those taken whose entries are mostly numbers: at most half of the rows fail, and some do not."""
    names = [c for c in raw.columns if c not in taken]
    if not names:
        return []
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    row = raw.agg(F.count("*").alias("n"), *[F.count_if(clean(F.col(c)).isNotNull()).alias(f"p{k}") for k, c in enumerate(names)], *[F.count_if(clean(F.col(c)).isNotNull() & number(c).isNull()).alias(f"f{k}") for k, c in enumerate(names)]).first()
    return [c for k, c in enumerate(names) if row[f"p{k}"] and row[f"f{k}"] <= TOLERANCE * max(1, row.n) and row[f"f{k}"] < row[f"p{k}"]]


def refused(report: DataFrame, values: list[str]) -> list[str]:
    """What makes a table unusable, from its report; messages hold counts and never values."""
    r = report.first()
    out = ["no data rows"] if not r.n_rows else []
    out += [f"{r[c]} of {r.n_rows} rows: {what}" for c, what in (("blank_keys", "no key"), ("bad_keys", "ill-formed key"), ("bad_periods", "no usable year or date"), ("repeated_keys", "duplicate of a key and period")) if r[c]]
    out += [f"column {v} has no data" for v in values if r.n_rows and r[f"{v}_missing"] == r.n_rows]
    return out + [f"column {v} is mostly no numbers" for v in values if r[f"{v}_not_numbers"] > TOLERANCE * max(1, r.n_rows)]
