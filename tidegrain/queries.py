"""Queries over the driver's tables, one for each operator, with their SQL.

Roles: orders are episodes, lineitem gives weights and yearly, daily and windowed values by part, part gives static values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates, recode, weighted
from .operators import engine, spatial
from .plans import patterns
from .sources import tables

#: Added before rounding, so that means on a rounding tie round alike in every engine.
SHIFT, PLACES = 3.3e-7, 6


def near(c: Column) -> Column:
    return F.round(c + SHIFT, PLACES)


def sql_near(c: str) -> str:
    return f"round({c} + {SHIFT}, {PLACES})"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


class Roles:
    def __init__(self, spark: SparkSession, d: str):
        self.t = lambda name: table(spark, d, name)
        line = self.t("lineitem")
        start = F.col("o_orderdate").cast("date")
        self.episodes = self.t("orders").select(F.col("o_custkey").cast("string").alias("pid"), F.col("o_orderkey").alias("episode_id"), start.alias("start_date"), F.date_add(start, (F.col("o_orderkey") % 700).cast("int")).alias("end_date"))
        self.weights = line.groupBy(F.col("l_orderkey").alias("episode_id"), F.col("l_partkey").alias("unit")).agg(F.sum("l_quantity").alias("weight"))
        self.values = line.select(F.col("l_partkey").alias("unit"), F.col("l_shipdate").cast("date").alias("date"), (F.col("l_extendedprice") / 1000).alias("v"), F.when(F.col("l_discount") > 0.05, F.col("l_tax") * 100).alias("v2"), "l_linestatus", "l_suppkey")
        mean = [F.avg("v").alias("v"), F.avg("v2").alias("v2")]
        self.yearly = self.values.groupBy("unit", F.year("date").alias("year")).agg(*mean)
        self.daily = self.values.groupBy("unit", "date").agg(*mean)
        period = F.floor(F.datediff("date", F.lit("1992-01-01").cast("date")) / 14).cast("int")
        first = F.date_add(F.lit("1992-01-01").cast("date"), period * 14)
        self.windowed = self.values.groupBy("unit", first.alias("start_date")).agg(*mean).withColumn("end_date", F.date_add("start_date", 13))
        self.static = self.t("part").select(F.col("p_partkey").alias("unit"), F.col("p_retailprice").alias("v"), F.nullif(F.col("p_size").cast("double"), F.lit(7.0)).alias("v2"))


ROLES = """
with episodes as (select cast(o_custkey as varchar) as pid, o_orderkey as episode_id, cast(o_orderdate as date) as start_date,
                         cast(o_orderdate as date) + cast(o_orderkey % 700 as integer) as end_date from orders),
weights as (select l_orderkey as episode_id, l_partkey as unit, sum(l_quantity) as weight from lineitem group by 1, 2),
vals as (select l_partkey as unit, cast(l_shipdate as date) as date, l_extendedprice / 1000 as v, case when l_discount > 0.05 then l_tax * 100 end as v2, l_linestatus, l_suppkey from lineitem),
yearly as (select unit, year(date) as yr, avg(v) as v, avg(v2) as v2 from vals group by 1, 2),
daily as (select unit, date, avg(v) as v, avg(v2) as v2 from vals group by 1, 2),
windowed as (select unit, date '1992-01-01' + 14 * cast(floor((date - date '1992-01-01') / 14) as integer) as start_date, avg(v) as v, avg(v2) as v2 from vals group by 1, 2),
statics as (select p_partkey as unit, p_retailprice as v, nullif(cast(p_size as double), 7.0) as v2 from part),
stays as (select pid, episode_id, end_date - start_date + 1 as d from episodes where end_date - start_date + 1 > 0),
periods as (select pid, episode_id, yr, least(end_date, make_date(yr, 12, 31)) - greatest(start_date, make_date(yr, 1, 1)) + 1 as d
            from (select *, unnest(range(year(start_date), year(end_date) + 1)) as yr from episodes))"""


def wm(x: str, w: str, policy: str = "skip") -> str:
    if policy == "skip":
        return f"sum({x} * {w}) / nullif(sum(case when {x} is not null then {w} end), 0)"
    return f"sum({f'coalesce({x}, 0)' if policy == 'zero' else x} * {w}) / nullif(sum({w}), 0)"


def spaced(values: str, period: str, source: str = "weights") -> str:
    """A CTE of spatial means."""
    by = f"w.episode_id{', ' + period if period else ''}"
    return f", space as (select {by}, {wm('x.v', 'w.weight')} as v, {wm('x.v2', 'w.weight')} as v2 from {source} w join {values} x on w.unit = x.unit group by {by})"


def timed(rows: str, keys: str = "pid", days: bool = False) -> str:
    more = ", cast(coalesce(sum(case when v is not null then d end), 0) as bigint) as v_days" if days else ""
    return f" select {keys}, {sql_near(wm('v', 'd'))} as v, {sql_near(wm('v2', 'd'))} as v2{more} from ({rows}) group by {keys}"


BY_YEAR = "select p.*, s.v, s.v2 from periods p left join space s on p.episode_id = s.episode_id and p.yr = s.yr"
BY_STAY = "select e.*, s.v, s.v2 from stays e left join space s on e.episode_id = s.episode_id"
BY_DAY = "select e.pid, e.episode_id, 1 as d, s.v, s.v2 from episodes e join space s on e.episode_id = s.episode_id and s.date between e.start_date and e.end_date"
BY_WINDOW = "select e.pid, e.episode_id, least(e.end_date, s.start_date + 13) - greatest(e.start_date, s.start_date) + 1 as d, s.v, s.v2 from episodes e join space s on e.episode_id = s.episode_id and e.start_date <= s.start_date + 13 and e.end_date >= s.start_date"
COLUMNS = ["v", "v2"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def keep(f: Callable[[Roles], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, d: f(Roles(spark, d))
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: near(F.col(c)) for c in columns or COLUMNS})


for _p in ("skip", "zero", "count_missing"):
    query(f"a{('skip', 'zero', 'count_missing').index(_p) + 1}_weighted_mean_{_p}", f"{ROLES} select w.episode_id, {sql_near(wm('x.v2', 'w.weight', _p))} as v2 from weights w left join statics x on w.unit = x.unit group by 1")(
        lambda r, p=_p: rounded(engine.weighted_aggregate(r.weights.join(r.static, "unit", "left"), ["episode_id"], ["v2"], "weight", p), "v2")
    )
query("a6_contributing_weight", f"{ROLES} select w.episode_id, coalesce(sum(case when x.v2 is not null then w.weight end), 0) as used from weights w left join statics x on w.unit = x.unit group by 1")(
    lambda r: r.weights.join(r.static, "unit", "left").groupBy("episode_id").agg(weighted.contributing(F.col("v2"), F.col("weight")).alias("used"))
)
query("a8_simple_aggregate", "select l_orderkey, min(l_quantity) as l_quantity_min, max(l_tax) as l_tax_max, count(l_discount) as l_discount_count, arg_min(l_partkey, cast(l_linenumber as bigint) * 1000000000 + l_partkey) as l_partkey_first from lineitem group by 1")(
    lambda r: engine.simple_aggregate(r.t("lineitem"), ["l_orderkey"], {"l_quantity": "min", "l_tax": "max", "l_discount": "count", "l_partkey": "first"}, "l_linenumber")
)
query("a17_share_of_group", f"{ROLES} select episode_id, unit, {sql_near('weight / sum(weight) over (partition by episode_id)')} as share from weights")(
    lambda r: r.weights.select("episode_id", "unit", near(weighted.share_of_group("weight", "episode_id")).alias("share"))
)
query("j1_join_full", "select coalesce(o_custkey, c_custkey) as o_custkey, count(o_orderkey) as n_orders, max(c_name) as c_name from orders full join customer on o_custkey = c_custkey group by 1")(
    lambda r: engine.join(r.t("orders"), r.t("customer"), ["o_custkey"], ["c_custkey"], "full").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"), F.max("c_name").alias("c_name"))
)
query("j5_date_range_join", f"{ROLES}{spaced('windowed', 'start_date')} select pid, episode_id, count(*) as n_periods, cast(sum(d) as bigint) as n_days from ({BY_WINDOW}) group by 1, 2")(
    lambda r: engine.date_range_join(r.episodes, patterns.met_periods(r.episodes, r.weights, r.windowed, False).select("episode_id", "start_date", "end_date").repartition("episode_id").distinct(), "episode_id").groupBy("pid", "episode_id").agg(F.count("*").alias("n_periods"), F.sum("overlap_days").alias("n_days"))
)
query("j6_point_in_interval", f"{ROLES}{spaced('daily', 'date')} select pid, episode_id, count(*) as n_days from ({BY_DAY}) group by 1, 2")(
    lambda r: engine.date_range_join(r.episodes, patterns.met_periods(r.episodes, r.weights, r.daily).select("episode_id", "date").repartition("episode_id").distinct(), "episode_id", "date").groupBy("pid", "episode_id").agg(F.count("*").alias("n_days"))
)
query("t1_episode_years", f"{ROLES} select pid, episode_id, yr as year, cast(d as integer) as overlap_days from periods")(lambda r: patterns.episode_years(r.episodes).withColumn("year", F.col("year").cast("long")))
query("l1_static_areal", f"{ROLES}{spaced('statics', '')}{timed(BY_STAY)}")(lambda r: rounded(patterns.static_areal(r.episodes, r.weights, r.static, COLUMNS)))
query("l1_static_areal_episode_days", f"{ROLES}{spaced('statics', '')}{timed(BY_STAY, 'pid, episode_id', True)}")(
    lambda r: rounded(patterns.static_areal(r.episodes, r.weights, r.static, COLUMNS, "episode", days_suffix="_days")).drop("v2_days")
)
query("l2_yearly_areal_participant", f"{ROLES}{spaced('yearly', 'yr')}{timed(BY_YEAR)}")(lambda r: rounded(patterns.yearly_areal(r.episodes, r.weights, r.yearly, COLUMNS)))
query("l2_yearly_areal_episode_days", f"{ROLES}{spaced('yearly', 'yr')}{timed(BY_YEAR, 'pid, episode_id', True)}")(
    lambda r: rounded(patterns.yearly_areal(r.episodes, r.weights, r.yearly, COLUMNS, "episode", days_suffix="_days")).drop("v2_days")
)
_VINTAGE = "(select case when l_linestatus = 'O' then 2020 else 2010 end as vintage, unit, year(date) as yr, avg(v) as v, avg(v2) as v2 from vals group by 1, 2, 3)"
query(
    "l3_yearly_vintage",
    f"{ROLES}, space as (select w.episode_id, yr, {wm('x.v', 'w.weight')} as v, {wm('x.v2', 'w.weight')} as v2 from (select *, 2010 as vintage from weights union all select episode_id, unit, weight, 2020 from weights) w join {_VINTAGE} x on w.unit = x.unit and w.vintage = x.vintage group by 1, 2){timed(BY_YEAR)}",
)(
    lambda r: rounded(
        patterns.yearly_areal_vintage(
            r.episodes,
            r.weights.withColumn("vintage", F.lit(2010)).unionByName(r.weights.withColumn("vintage", F.lit(2020))),
            r.values.groupBy(F.when(F.col("l_linestatus") == "O", 2020).otherwise(2010).alias("vintage"), "unit", F.year("date").alias("year")).agg(F.avg("v").alias("v"), F.avg("v2").alias("v2")),
            COLUMNS,
        )
    )
)
query("l4_gridded_daily", f"{ROLES}{spaced('daily', 'date')}{timed(BY_DAY)}")(lambda r: rounded(patterns.gridded(r.episodes, r.weights, r.daily, COLUMNS)))
query("l4_gridded_daily_episode", f"{ROLES}{spaced('daily', 'date')}{timed(BY_DAY, 'pid, episode_id')}")(lambda r: rounded(patterns.gridded(r.episodes, r.weights, r.daily, COLUMNS, "episode")))
query("l4_gridded_windowed", f"{ROLES}{spaced('windowed', 'start_date')}{timed(BY_WINDOW)}")(lambda r: rounded(patterns.gridded(r.episodes, r.weights, r.windowed, COLUMNS, daily=False)))
query("l5_many_pollutants", f"{ROLES}{spaced('windowed', 'start_date')} select *, {sql_near('v_ - v2_')} as v_less from (select pid, {wm('v', 'd')} as v_, {wm('v2', 'd')} as v2_ from ({BY_WINDOW}) group by 1)".replace("select *, ", f"select pid, {sql_near('v_')} as v, {sql_near('v2_')} as v2, "))(
    lambda r: rounded(
        patterns.many_pollutants(r.episodes, r.weights, r.windowed.select("unit", "start_date", "end_date", F.explode(F.array(*[F.struct(F.lit(c).alias("pollutant"), F.col(c).alias("value")) for c in COLUMNS])).alias("p")).select("unit", "start_date", "end_date", "p.*"), COLUMNS, less={"v_less": ("v", "v2")}),
        "v", "v2", "v_less",
    )
)


def _cbp(r: Roles) -> DataFrame:
    zips = patterns.yearly_areal(r.episodes, r.weights, r.yearly, COLUMNS, "episode", days_suffix="_days")
    counties = r.values.groupBy(F.col("l_suppkey").alias("unit"), F.year("date").alias("year")).agg(F.avg("v").alias("v"), F.avg("v2").alias("v2"))
    w = r.t("lineitem").groupBy(F.col("l_orderkey").alias("episode_id"), F.col("l_suppkey").alias("unit")).agg(F.sum("l_quantity").alias("weight"))
    county = patterns.yearly_areal(r.episodes, w, counties, COLUMNS, "episode")
    days = engine.stays(r.episodes)
    with_days = lambda df: df.select("pid", "episode_id", *COLUMNS).join(days, ["pid", "episode_id"])
    return rounded(patterns.fallback(with_days(zips), with_days(county), "v2", COLUMNS))


_CTE = "select p.pid, p.episode_id, {} as v, {} as v2 from periods p left join {} s on p.episode_id = s.episode_id and p.yr = s.yr group by 1, 2"
query(
    "l6_fallback",
    f"""{ROLES}, zs as (select w.episode_id, yr, {wm('x.v', 'w.weight')} as v, {wm('x.v2', 'w.weight')} as v2 from weights w join yearly x on w.unit = x.unit group by 1, 2),
cw as (select l_orderkey as episode_id, l_suppkey as unit, sum(l_quantity) as weight from lineitem group by 1, 2),
cv as (select l_suppkey as unit, year(date) as yr, avg(v) as v, avg(v2) as v2 from vals group by 1, 2),
cs as (select w.episode_id, yr, {wm('x.v', 'w.weight')} as v, {wm('x.v2', 'w.weight')} as v2 from cw w join cv x on w.unit = x.unit group by 1, 2),
ze as ({_CTE.format(wm('v', 'd'), wm('v2', 'd'), 'zs')}), ce as ({_CTE.format(wm('v', 'd'), wm('v2', 'd'), 'cs')})
{timed("select z.pid, t.d, case when z.v2 is null then c.v else z.v end as v, case when z.v2 is null then c.v2 else z.v2 end as v2 from ze z join stays t on z.episode_id = t.episode_id left join ce c on z.episode_id = c.episode_id")}""",
)(_cbp)
#: Rates of the food access rules as multiples of v or v2, and the flags with their tests; `Urban` is 1 from a share of a half.
RATES = {
    "LALOWI1_10": ("v", 1000 / 50), "LALOWI1_10share": ("v2", 0.1), "LAPOP1_10": ("v", 1000 / 55), "LAPOP1_10share": ("v2", 0.09), "lalowihalf": ("v", 1000 / 58), "lalowihalfshare": ("v2", 0.07),
    "lalowi10": ("v", 1000 / 62), "lalowi10share": ("v2", 0.075), "lalowi1": ("v", 1000 / 57), "lalowi1share": ("v2", 0.085), "lalowi20": ("v", 1000 / 66), "lalowi20share": ("v2", 0.06), "lapophalf": ("v", 1000 / 61),
    "lapophalfshare": ("v2", 0.082), "lapop1": ("v", 1000 / 60), "lapop1share": ("v2", 0.08), "lapop10": ("v", 1000 / 64), "lapop10share": ("v2", 0.078), "lapop20": ("v", 1000 / 59), "lapop20share": ("v2", 0.065),
    "lahunvhalf": ("v", 1000 / 300), "PCTGQTRS": ("v2", 0.16), "Urban": ("v2", 0.125),
}
_ONE = {"LILATracts_1And10": "LALOWI1_10", "LA1and10": "LAPOP1_10", "LATracts_half": "lapophalf", "LATracts1": "lapop1", "LATracts10": "lapop10", "LATracts20": "lapop20"}
_TWO = {"LILATracts_halfAnd10": ("lalowihalf", "lalowi10"), "LILATracts_1And20": ("lalowi1", "lalowi20"), "LAhalfand10": ("lapophalf", "lapop10"), "LA1and20": ("lapop1", "lapop20")}


def _food_sql() -> str:
    hit = lambda c: f"({c} >= 500 or {c}share >= 0.33)"
    known = lambda *cs: " and ".join(f"{c} is not null" for c in cs)
    flags = {k: (hit(c), known(c, f"{c}share")) for k, c in _ONE.items()}
    flags |= {k: (f"({hit(a)} and u = 1 or {hit(b)} and u = 0)", known(a, f"{a}share", b, f"{b}share", "u")) for k, (a, b) in _TWO.items()}
    flags["LATractsVehicle_20"] = (f"(lahunvhalf >= 100 or {hit('lapop20')})", known("lahunvhalf", "lapop20", "lapop20share"))
    flags["HUNVFlag"] = ("lahunvhalf >= 100", known("lahunvhalf"))
    flags["GroupQuartersFlag"] = ("PCTGQTRS >= 0.67", known("PCTGQTRS"))
    rates = ", ".join(f"{wm(f'({c} * {k!r}::double)', 'd')} as {name if name != 'Urban' else 'urban_share'}" for name, (c, k) in RATES.items())
    cases = ", ".join(f"case when {test} then 1 when {present} then 0 end as {k}" for k, (test, present) in flags.items())
    means = f"select e.pid, {rates} from (select distinct pid from episodes) e left join ({BY_YEAR}) y on e.pid = y.pid group by 1"
    return f"{ROLES}{spaced('yearly', 'yr')}, m as ({means}), w as (select *, case when urban_share >= 0.5 then 1 when urban_share is not null then 0 end as u from m) select pid, u as Urban, {cases} from w"


FLAGS = ["Urban", *_ONE, *_TWO, "LATractsVehicle_20", "HUNVFlag", "GroupQuartersFlag"]
query("l7_food_access", _food_sql())(
    lambda r: patterns.food_access(r.episodes, r.weights, r.yearly, {name: F.col(c) * k for name, (c, k) in RATES.items()}).select("pid", *FLAGS)
)
query("l8_daily_pair", f"{ROLES}, pair as (select a.unit, a.date, a.v, b.v2 from (select * from daily where v > 20) a left join (select * from daily where v2 is not null) b on a.unit = b.unit and a.date = b.date){spaced('pair', 'date')}{timed(BY_DAY)}")(
    lambda r: rounded(patterns.daily_pair(r.episodes, r.weights, r.daily.filter("v > 20").select("unit", "date", "v"), r.daily.filter("v2 is not null").select("unit", "date", "v2")))
)
query("l9_precomputed_yearly", f"{ROLES}{spaced('yearly', 'yr')}{timed(BY_YEAR.replace('left join', 'join'))}")(
    lambda r: rounded(patterns.precomputed_yearly(r.episodes, engine.weighted_aggregate(r.weights.join(r.yearly, "unit"), ["episode_id", "year"], COLUMNS, "weight"), COLUMNS))
)
query("l10_precomputed_static", f"{ROLES}{spaced('statics', '')}{timed(BY_STAY, 'pid, episode_id')}")(
    lambda r: rounded(patterns.precomputed_static(r.episodes, engine.weighted_aggregate(r.weights.join(r.static, "unit"), ["episode_id"], COLUMNS, "weight"), COLUMNS, "episode"))
)
query("f1_feature_filter", "select p_partkey from part where not coalesce(starts_with(p_type, 'PROMO') or starts_with(p_type, 'SMALL'), false)")(
    lambda r: r.t("part").filter(recode.feature_filter(F.col("p_type"), prefixes=["PROMO", "SMALL"], exclude=True)).select("p_partkey")
)
query("f2_recode", "select p_partkey, case when p_size >= 40 and p_brand <> 'Brand#11' then 'large' when p_size < 10 then 'small' else 'other' end as class from part")(
    lambda r: r.t("part").select("p_partkey", recode.recode([({"p_size": {"gte": 40}, "p_brand": {"ne": "Brand#11"}}, "large"), ({"p_size": {"lt": 10}}, "small")], "other").alias("class"))
)
query("c1_padded", "select c_custkey, case when length(cast(c_nationkey as varchar)) >= 5 then cast(c_nationkey as varchar) else lpad(cast(c_nationkey as varchar), 5, '0') end as code from customer")(lambda r: r.t("customer").select("c_custkey", recode.padded(F.col("c_nationkey")).alias("code")))
_HUMID = "greatest(0.0, least(100.0, 100 * (1 - l_tax * 100 / (6.1078 * pow(10.0, 7.5 * l_quantity / (237.3 + l_quantity))))))"
query("m1_humidity", f"select l_orderkey, l_linenumber, {sql_near(_HUMID)} as rh from lineitem")(
    lambda r: recode.derive(r.t("lineitem").withColumn("deficit", F.col("l_tax") * 100), "rh", key="rh_from_vpd", temperature="l_quantity", deficit="deficit").select("l_orderkey", "l_linenumber", near(F.col("rh")).alias("rh"))
)
_LON, _LAT = "(-100 + ({0} * 7919 % 20000) / 1000.0)", "(30 + ({0} * 104729 % 10000) / 1000.0)"


def _placed(df: DataFrame, key: str) -> DataFrame:
    x, y = spatial.albers(F.expr(_LON.format(key)).cast("double"), F.expr(_LAT.format(key)).cast("double"))
    return df.select("*", x.alias("x"), y.alias("y"))


def _albers_sql(key: str) -> tuple[str, str]:
    import math

    a, f = spatial.WGS84
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    s1, s2, s0 = (math.sin(math.radians(p)) for p in (29.5, 45.5, 37.5))
    m1, m2 = (math.cos(math.radians(p)) / math.sqrt(1 - e2 * s * s) for p, s in ((29.5, s1), (45.5, s2)))
    n = (m1**2 - m2**2) / (q(s2) - q(s1))
    c = m1**2 + n * q(s1)
    rho0 = a * math.sqrt(c - n * q(s0)) / n
    s = f"sin(radians(cast({_LAT.format(key)} as double)))"
    qs = f"({1 - e2!r}::double * ({s} / (1 - {e2!r}::double * {s} * {s}) - ln((1 - {e!r}::double * {s}) / (1 + {e!r}::double * {s})) / {2 * e!r}::double))"
    rho = f"({a / n!r}::double * sqrt({c!r}::double - {n!r}::double * {qs}))"
    theta = f"({n!r}::double * radians(cast({_LON.format(key)} as double) - (-96.0::double)))"
    return f"{rho} * sin({theta})", f"{rho0!r}::double - {rho} * cos({theta})"


_X, _Y = _albers_sql("o_orderkey")
_SX, _SY = _albers_sql("s_suppkey")
query("g2_albers", f"select o_orderkey, round({_X} + 3.3e-4, 2) as x, round({_Y} + 3.3e-4, 2) as y from orders")(
    lambda r: _placed(r.t("orders"), "o_orderkey").select("o_orderkey", F.round(F.col("x") + 3.3e-4, 2).alias("x"), F.round(F.col("y") + 3.3e-4, 2).alias("y"))
)


def _near(r: Roles, by: list[str]) -> DataFrame:
    people = _placed(r.t("orders").select(F.col("o_orderkey"), F.col("o_orderkey").alias("episode_id")), "o_orderkey").select("episode_id", "x", "y")
    shops = _placed(r.t("supplier").join(F.broadcast(r.t("nation")), F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey")
    shops = shops.select(F.col("n_regionkey").alias("category"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return spatial.nearest(people, shops, cell=20_000.0, by=by).withColumn("distance", F.round(F.col("distance") + 3.3e-4, 2))


_PAIRS = f"(select o.episode_id, s.category, sqrt(pow(o.x - s.x, 2) + pow(o.y - s.y, 2)) as d from (select o_orderkey as episode_id, {_X} as x, {_Y} as y from orders) o, (select n_regionkey as category, {_SX} as x, {_SY} as y from supplier join nation on s_nationkey = n_nationkey) s)"
for _name in ("n1_nearest", "n1_nearest_all"):
    query(_name, f"select episode_id, round(min(d) + 3.3e-4, 2) as distance from {_PAIRS} group by 1")(lambda r: _near(r, []))
for _name in ("n1_nearest_by_category", "n1_nearest_by_category_all"):
    query(_name, f"select episode_id, category, round(min(d) + 3.3e-4, 2) as distance from {_PAIRS} group by 1, 2")(lambda r: _near(r, ["category"]))
query("a20_row_minimum", "select l_orderkey, l_linenumber, least(case when l_tax > 0.02 then l_tax end, case when l_discount > 0.03 then l_discount end) as nearest from lineitem")(
    lambda r: r.t("lineitem").select("l_orderkey", "l_linenumber", F.least(F.when(F.col("l_tax") > 0.02, F.col("l_tax")), F.when(F.col("l_discount") > 0.03, F.col("l_discount"))).alias("nearest"))
)
query(
    "v3_table_report",
    """with t as (select case when l_returnflag = 'R' then '' else lpad(cast(l_partkey as varchar), 5, '0') || case when l_linenumber = 7 then '9' else '' end end as code,
 case when l_tax = 0 then 'N/A' when l_tax > 0.07 then 'high' else cast(l_tax as varchar) end as v, cast(year(l_shipdate) as varchar) || case when l_linenumber = 6 then 'x' else '' end as y from lineitem),
k as (select nullif(code, '') as k, v, try_cast(y as integer) as y from t)
select count(*) as n_rows, count(*) filter (k is null) as blank_keys, count(*) filter (not regexp_full_match(k, '[0-9]{5}')) as bad_keys, count(*) filter (regexp_full_match(k, '[0-9]{4}')) as short_keys,
 count(*) filter (y is null) as bad_periods, count(k) - count(distinct case when k is not null then (k, y) end) as repeated_keys, count(*) filter (v = 'N/A') as v_missing, count(*) filter (v = 'high') as v_not_numbers from k""",
)(
    lambda r: tables.table_report(
        r.t("lineitem").select(
            F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lpad(F.col("l_partkey").cast("string"), 5, "0"), F.when(F.col("l_linenumber") == 7, "9").otherwise(""))).alias("code"),
            F.when(F.col("l_tax") == 0, "N/A").when(F.col("l_tax") > 0.07, "high").otherwise(F.col("l_tax").cast("string")).alias("v"),
            F.concat(F.year("l_shipdate").cast("string"), F.when(F.col("l_linenumber") == 6, "x").otherwise("")).alias("y"),
        ),
        "code", 5, ["v"], year="y",
    )
)
query("a26_linkage_rate", f"{ROLES}, n as (select count(*) as units, count(v2) as k from statics) select 'v2' as variable, units, k as with_value, round_even(100.0 * k / units, 2)::double as pct from n")(lambda r: patterns.linkage_rate(r.static, ["v2"]))
query("t2_stays", f"{ROLES} select pid, episode_id, cast(d as integer) as overlap_days from stays")(lambda r: engine.stays(r.episodes))
query("a9_participant_means", f"{ROLES}{spaced('statics', '')}{timed(BY_STAY)}")(lambda r: rounded(engine.participant_means(patterns.static_areal(r.episodes, r.weights, r.static, COLUMNS, "episode").join(engine.stays(r.episodes), ["pid", "episode_id"]), COLUMNS)))
query("t10_year_and_day", "select event_id, cast(cast(ts as date) as varchar) as date from events")(lambda r: r.t("events").select("event_id", dates.year_and_day(F.date_format("ts", "yyyyDDD")).cast("string").alias("date")))
