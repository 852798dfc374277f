"""Date arithmetic with both ends inclusive; a blank date gives no day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_days(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    whole = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()
    days = F.datediff(F.least(a_end, b_end), F.greatest(a_start, b_start)) + 1
    return F.when(whole, F.greatest(F.lit(0), days))  # least() and greatest() skip NULL


def length_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def year_and_day(text: Column) -> Column:
    """`YYYYDDD` -> date."""
    return F.date_add(F.make_date(F.substring(text, 1, 4).cast("int"), F.lit(1), F.lit(1)), F.substring(text, 5, 3).cast("int") - 1)


def first_format(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def shared_format(df: DataFrame, *columns: str, formats: tuple[str, ...] = ("yyyy-MM-dd", "M/d/yyyy")) -> str | None:
    """The first format that reads every value that is not blank in all the columns."""
    checks = []
    for k, f in enumerate(formats):
        bad = sum((F.count_if((F.trim(c) != "") & F.try_to_timestamp(F.trim(c), F.lit(f)).isNull()) for c in columns), F.lit(0))
        checks.append(bad.alias(str(k)))
    row = df.agg(*checks).first()
    return next((f for k, f in enumerate(formats) if row[k] == 0), None)
