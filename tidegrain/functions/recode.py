"""Filters, recodes and named formulas.  A comparison with a missing value is false, and `ne` with one is true."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_filter(column: Column, values: list | None = None, prefixes: list[str] | None = None, exclude: bool = False) -> Column:
    if values is None and prefixes is None:
        raise ValueError("give values or prefixes")
    if values is not None:
        hit = column.isin(values)
    else:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | column.cast("string").startswith(p)
    hit = F.coalesce(hit, F.lit(False))
    return ~hit if exclude else hit


_TESTS: dict[str, Callable[[Column, object], Column]] = {
    "gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v, "eq": lambda c, v: c == v, "ne": lambda c, v: c != v,
}


def condition(tests: dict[str, object]) -> Column:
    """{column: value} or {column: {"gte": 1, ...}}, all of which hold."""
    out = F.lit(True)
    for name, test in tests.items():
        for op, v in (test if isinstance(test, dict) else {"eq": test}).items():
            out = out & F.coalesce(_TESTS[op](F.col(name), F.lit(v)), F.lit(op == "ne"))
    return out


def recode(rules: list[tuple[dict, object]], default: object = None) -> Column:
    """The value of the first rule whose condition holds."""
    out = None
    for tests, value in rules:
        out = F.when(condition(tests), F.lit(value)) if out is None else out.when(condition(tests), F.lit(value))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


FORMULAS: dict[str, Callable[..., Column]] = {}


def register_formula(name: str) -> Callable[[Callable[..., Column]], Callable[..., Column]]:
    def keep(f: Callable[..., Column]) -> Callable[..., Column]:
        if name in FORMULAS:
            raise ValueError(f"a formula {name!r} is registered already")
        FORMULAS[name] = f
        return f

    return keep


def derive(df: DataFrame, target: str, formula: str | None = None, key: str | None = None, **columns: str) -> DataFrame:
    """A column from a SQL expression, or from a registered formula over named columns."""
    if (formula is None) == (key is None):
        raise ValueError("give either a formula or the key of a registered one")
    if key is not None and key not in FORMULAS:
        raise ValueError(f"no formula {key!r}; registered: {', '.join(sorted(FORMULAS))}")
    made = F.expr(formula) if formula else FORMULAS[key](**{k: F.col(c) for k, c in columns.items()})
    return df.withColumn(target, made)


def _saturation(t: Column) -> Column:
    return 6.1078 * F.pow(F.lit(10.0), 7.5 * t / (237.3 + t))


def _clipped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


@register_formula("rh_from_vpd")
def humidity_from_deficit(temperature: Column, deficit: Column) -> Column:
    """Percent, from degrees C and hPa."""
    return _clipped(100 * (1 - deficit / _saturation(temperature)), 0.0, 100.0)


@register_formula("rh_from_dewpoint")
def humidity_from_dew_point(temperature: Column, dew_point: Column) -> Column:
    return _clipped(100 * _saturation(dew_point) / _saturation(temperature), 0.0, 100.0)


#: Coefficients of the heat index regression: constant, t, h, th, tt, hh, tth, thh, tthh.  Fixed values.
HEAT = (-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783, -0.05481717, 0.00122874, 0.00085282, -0.00000199)


@register_formula("heat_index")
def heat_index(temperature: Column, humidity: Column) -> Column:
    """Degrees C from degrees C and percent, by the public weather service procedure in Fahrenheit."""
    t, h = temperature * 9 / 5 + 32, humidity
    plain = 0.5 * (t + 61 + (t - 68) * 1.2 + h * 0.094)
    c = HEAT
    full = c[0] + c[1] * t + c[2] * h + c[3] * t * h + c[4] * t * t + c[5] * h * h + c[6] * t * t * h + c[7] * t * h * h + c[8] * t * t * h * h
    dry = (13 - h) / 4 * F.sqrt(F.greatest(F.lit(0.0), (17 - F.abs(t - 95)) / 17))
    damp = (h - 85) / 10 * (87 - t) / 5
    full = F.when((h < 13) & t.between(80, 112), full - dry).when((h > 85) & t.between(80, 87), full + damp).otherwise(full)
    return (F.when((plain + t) / 2 >= 80, full).otherwise(plain) - 32) * 5 / 9


def padded(code: Column, width: int = 5) -> Column:
    """Zero-padded text that never truncates."""
    text = F.trim(code.cast("string"))
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def flag(inputs: list[str], tests: list[Column], before: Column | None = None) -> Column:
    """1 when any test holds even if inputs are missing, 0 when all inputs are present, else the value before, if any."""
    present = F.lit(True)
    for c in inputs:
        present = present & F.col(c).isNotNull()
    hit = F.lit(False)
    for t in tests:
        hit = hit | F.coalesce(t, F.lit(False))
    out = F.when(hit, F.lit(1)).when(present, F.lit(0))
    return out if before is None else out.otherwise(before)


#: Fixed values of the food access flags: people, share of people, vehicles, share in group quarters, share urban.
PEOPLE, SHARE, VEHICLES, QUARTERS, URBAN = 500, 0.33, 100, 0.67, 0.5


def _reach(column: str) -> list[Column]:
    return [F.col(column) >= PEOPLE, F.col(f"{column}share") >= SHARE]


def _near_far(near: str, far: str) -> tuple[list[str], list[Column]]:
    town, country = F.col("Urban") == 1, F.col("Urban") == 0
    return [near, f"{near}share", far, f"{far}share", "Urban"], [town & t for t in _reach(near)] + [country & t for t in _reach(far)]


def food_access_flags(df: DataFrame) -> DataFrame:
    """Rates of tracts -> flags.  Columns that are absent leave their flags out; where a rule says nothing, a flag keeps its value."""
    have = {c.lower() for c in df.columns}
    out = df.withColumn("Urban", F.when(F.col("Urban") >= URBAN, 1).when(F.col("Urban").isNotNull(), 0)) if "urban" in have else df
    single = {
        "LILATracts_1And10": "LALOWI1_10", "LA1and10": "LAPOP1_10", "LATracts_half": "lapophalf", "LATracts1": "lapop1", "LATracts10": "lapop10", "LATracts20": "lapop20",
    }
    double = {"LILATracts_halfAnd10": ("lalowihalf", "lalowi10"), "LILATracts_1And20": ("lalowi1", "lalowi20"), "LAhalfand10": ("lapophalf", "lapop10"), "LA1and20": ("lapop1", "lapop20")}
    rules = {k: ([c, f"{c}share"], _reach(c)) for k, c in single.items() if {c.lower(), f"{c}share".lower()} <= have}
    rules |= {k: _near_far(a, b) for k, (a, b) in double.items() if {"urban", a, f"{a}share", b, f"{b}share"} <= have}
    if {"lahunvhalf", "lapop20", "lapop20share"} <= have:
        rules["LATractsVehicle_20"] = ["lahunvhalf", "lapop20", "lapop20share"], [F.col("lahunvhalf") >= VEHICLES, *_reach("lapop20")]
    if "lahunvhalf" in have:
        rules["HUNVFlag"] = ["lahunvhalf"], [F.col("lahunvhalf") >= VEHICLES]
    if "pctgqtrs" in have:
        rules["GroupQuartersFlag"] = ["PCTGQTRS"], [F.col("PCTGQTRS") >= QUARTERS]
    made = {k: flag(inputs, tests, F.col(k) if k.lower() in have else None) for k, (inputs, tests) in rules.items()}
    return out.withColumns(made) if made else out


#: Classes of roads and of water features, by the first three digits of their code.  Fixed values.
ROADS = {"pri": "S1100", "sec": "S1200"}
#: County codes of 2010 whose road files have another code from a year on.  Fixed values.
RENAMED_COUNTIES = {"46113": (2015, "46102")}
WATER = {"flow": (460, 336, 558), "water": (390, 436, 466, 493), "area": (312, 493, 460), "coast": (566,)}


def code_class(df: DataFrame, classes: tuple[int, ...], column: str = "fcode") -> Column:
    """The code's class is one of these; codes that are no numbers are in none, and a table without the column passes whole."""
    name = next((c for c in df.columns if c.lower() == column), None)
    if name is None:
        return F.lit(True)
    return F.coalesce(F.floor(F.expr(f"try_cast(try_cast(`{name}` as double) as bigint)") / 100).isin(*classes), F.lit(False))


def valid_coordinates(lon: Column, lat: Column) -> Column:
    """Finite degrees on the globe."""
    ok = ~F.isnan(lon) & ~F.isnan(lat) & (F.abs(lon) <= 180) & (F.abs(lat) <= 90)
    return F.coalesce(ok, F.lit(False))


def no_data(value: Column, *marks: float, below: float | None = None) -> Column:
    """Missing where the value is one of the marks, NaN, or at most `below`."""
    bad = F.isnan(value)
    for m in marks:
        bad = bad | (value == F.lit(m))
    return F.when(~(bad | (value <= below) if below is not None else bad), value)


def id_text(value: Column) -> Column:
    """Text of an id; a whole number that came as a float loses its `.0`."""
    number = F.try_to_number(F.regexp_extract(value.cast("string"), r"^(-?[0-9]+)\.0+$", 1), F.lit("S99999999999999999999")).cast("string")
    return F.coalesce(number, value.cast("string"))


def state_of(code: Column) -> Column:
    return F.substring(code, 1, 2)


def renamed_clashes(df: DataFrame, taken: list[str], suffix: str = "_bgkey") -> DataFrame:
    """Columns that are taken elsewhere get a suffix."""
    return df.withColumnsRenamed({c: c + suffix for c in df.columns if c in taken})


def transformed(df: DataFrame, steps: list[dict], target: str | None = None) -> DataFrame:
    """Applies steps {type: filter | recode | derive, ...} in order; each names the `target` table that it belongs to, if any.
    Steps of other types (spatial_fix, date_parse) belong to readers and are passed over."""
    for step in steps:
        if step.get("target", target) != target:
            continue
        kind = step["type"]
        if kind == "filter":
            df = df.filter(feature_filter(F.col(step["column"]), step.get("values"), step.get("prefixes"), step.get("exclude", False)))
        elif kind == "recode":
            df = df.withColumn(step["column"], recode([(r["when"], r["value"]) for r in step["rules"]], step.get("default")))
        elif kind == "derive":
            df = derive(df, step["column"], step.get("formula"), step.get("key"), **step.get("columns", {}))
    return df


def road_county(county: Column, year: Column) -> Column:
    """The code under which a county's roads of a year are published."""
    return F.coalesce(*[F.when((county == code) & (year >= first), F.lit(new)) for code, (first, new) in RENAMED_COUNTIES.items()], county)
