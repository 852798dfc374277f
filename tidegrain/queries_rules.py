"""Queries of filters, recodes, periods, checks and results over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cohort
from .functions import dates, recode
from .operators import engine
from .plans import patterns, results
from .queries import BY_STAY, BY_YEAR, COLUMNS, ROLES, Roles, near, query, rounded, spaced, sql_near, timed, wm
from .sources import periods, readers, tables

_DEW = "greatest(0.0, least(100.0, 100 * (6.1078 * pow(10.0, 7.5 * (l_quantity - 5) / (237.3 + (l_quantity - 5)))) / (6.1078 * pow(10.0, 7.5 * l_quantity / (237.3 + l_quantity)))))"
query("m2_humidity_dew_point", f"select l_orderkey, l_linenumber, {sql_near(_DEW)} as rh from lineitem")(
    lambda r: recode.derive(r.t("lineitem").withColumn("dew", F.col("l_quantity") - 5), "rh", key="rh_from_dewpoint", temperature="l_quantity", dew_point="dew").select("l_orderkey", "l_linenumber", near(F.col("rh")).alias("rh"))
)
_c = [repr(x) for x in recode.HEAT]
_FULL = f"({_c[0]} + {_c[1]} * t + {_c[2]} * h + {_c[3]} * t * h + {_c[4]} * t * t + {_c[5]} * h * h + {_c[6]} * t * t * h + {_c[7]} * t * h * h + {_c[8]} * t * t * h * h)"
query("m3_heat_index", f"""with w as (select l_orderkey, l_linenumber, cast(l_quantity as double) * 9 / 5 + 32 as t, cast(l_tax as double) * 1250 as h from lineitem),
p as (select *, 0.5 * (t + 61 + (t - 68) * 1.2 + h * 0.094) as plain, {_FULL} as f from w),
q as (select *, case when h < 13 and t between 80 and 112 then f - (13 - h) / 4 * sqrt(greatest(0.0, (17 - abs(t - 95)) / 17)) when h > 85 and t between 80 and 87 then f + (h - 85) / 10 * (87 - t) / 5 else f end as g from p)
select l_orderkey, l_linenumber, {sql_near('((case when (plain + t) / 2 >= 80 then g else plain end) - 32) * 5 / 9')} as heat from q""")(
    lambda r: recode.derive(r.t("lineitem").withColumns({"h": F.col("l_tax") * 1250, "t": F.col("l_quantity").cast("double")}), "heat", key="heat_index", temperature="t", humidity="h").select("l_orderkey", "l_linenumber", near(F.col("heat")).alias("heat"))
)
query("f4_formula", f"select l_orderkey, l_linenumber, {sql_near('l_extendedprice * (1 - l_discount) / l_quantity')} as unit_price from lineitem")(
    lambda r: recode.derive(r.t("lineitem"), "unit_price", "l_extendedprice * (1 - l_discount) / l_quantity").select("l_orderkey", "l_linenumber", near(F.col("unit_price")).alias("unit_price"))
)
_STEPS = [
    {"type": "filter", "target": "values", "column": "p_type", "prefixes": ["PROMO"], "exclude": True}, {"type": "spatial_fix", "target": "values"},
    {"type": "recode", "target": "values", "column": "size_class", "rules": [{"when": {"p_size": {"gt": 30}}, "value": "large"}, {"when": {"p_size": {"lte": 10}}, "value": "small"}], "default": "middle"},
    {"type": "derive", "target": "values", "column": "twice", "formula": "p_size * 2"}, {"type": "filter", "target": "weights", "column": "p_type", "values": []},
]
query("f6_transforms", "select p_partkey, case when p_size > 30 then 'large' when p_size <= 10 then 'small' else 'middle' end as size_class, p_size * 2 as twice from part where not starts_with(p_type, 'PROMO')")(
    lambda r: recode.transformed(r.t("part"), _STEPS, "values").select("p_partkey", "size_class", "twice")
)
query("f8_no_data", "select l_orderkey, l_linenumber, case when l_tax not in (0.02, 0.05) and l_tax > 0.01 then l_tax end as tax from lineitem")(lambda r: r.t("lineitem").select("l_orderkey", "l_linenumber", recode.no_data(F.col("l_tax"), 0.02, 0.05, below=0.01).alias("tax")))
query("f9_water_codes", "select p_partkey, coalesce(floor(try_cast(cast(38000 + p_partkey * 97 % 12000 as varchar) as bigint) / 100) in (390, 436, 466, 493), false) as water from part")(
    lambda r: (lambda p: p.select("p_partkey", recode.code_class(p, recode.WATER["water"]).alias("water")))(r.t("part").withColumn("FCode", (38000 + F.col("p_partkey") * 97 % 12000).cast("string")))
)
query("f13_valid_coordinates", "select c_custkey, coalesce(abs(c_acctbal / 40) <= 180 and abs(c_acctbal / 90) <= 90, false) as valid from customer")(lambda r: r.t("customer").select("c_custkey", recode.valid_coordinates((F.col("c_acctbal") / 40).cast("double"), (F.col("c_acctbal") / 90).cast("double")).alias("valid")))
query("f16_filled_static", f"{ROLES}{spaced('statics', '')} select pid, coalesce({sql_near(wm('v', 'd'))}, -1.0) as v, coalesce({sql_near(wm('v2', 'd'))}, 99999.0) as v2 from ({BY_STAY}) group by pid")(
    lambda r: rounded(patterns.precomputed_static(r.episodes, engine.weighted_aggregate(r.weights.join(r.static, "unit"), ["episode_id"], COLUMNS, "weight"), COLUMNS, fill={"v": -1.0, "v2": 99999.0}))
)
query("c6_id_text", "select c_custkey, case when c_custkey % 6 = 0 then cast(c_custkey // 2 as varchar) when c_custkey % 3 = 0 then cast(c_custkey / 2.0 as varchar) else cast(c_custkey as varchar) end as id from customer")(
    lambda r: r.t("customer").select("c_custkey", recode.id_text(F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") / 2).otherwise(F.col("c_custkey").cast("double"))).alias("id"))
)
query("w2_first_per_key", "select l_orderkey, l_partkey, l_extendedprice from (select *, row_number() over (partition by l_orderkey order by l_extendedprice, l_partkey, l_linenumber) as n from lineitem) where n = 1")(
    lambda r: results.first_per_key(r.t("lineitem"), ["l_orderkey"], "l_extendedprice", "l_partkey", "l_linenumber").select("l_orderkey", "l_partkey", "l_extendedprice")
)
query("w4_first_appearance", f"{ROLES} select pid, min(episode_id) as place from episodes group by 1")(lambda r: results.participants(r.episodes))
query("o5_input_order", f"{ROLES}{spaced('statics', '')}, m as ({timed(BY_STAY)}), p as (select pid, min(episode_id) as place from episodes group by 1) select row_number() over (order by place) as n, p.pid, m.v2, m.v from p left join m on p.pid = m.pid")(
    lambda r: _numbered(results.final_table(r.episodes, rounded(patterns.static_areal(r.episodes, r.weights, r.static, COLUMNS)), ["v2", "v"]))
)
query("o6_states", "with c as (select distinct lpad(cast(l_partkey * 37 % 90000 as varchar), 5, '0') as unit from lineitem) select substr(unit, 1, 2) as state, count(*) as n from c group by 1 order by n desc, state limit 6")(
    lambda r: results.states(r.t("lineitem").select(recode.padded(F.col("l_partkey") * 37 % 90000).alias("unit")))
)
query("j16_outer_join", f"{ROLES}, a as (select unit, date, v from daily where v > 30), b as (select unit, date, v2 from daily where v2 is not null) select coalesce(a.unit, b.unit) as unit, coalesce(a.date, b.date)::varchar as date, {sql_near('v')} as v, {sql_near('v2')} as v2 from a full join b on a.unit = b.unit and a.date = b.date")(
    lambda r: rounded(readers.outer([r.daily.filter("v > 30").select("unit", "date", "v"), r.daily.filter("v2 is not null").select("unit", "date", "v2")], ["unit", "date"])).withColumn("date", F.col("date").cast("string"))
)
query("a13_fallback_by_participant", f"""{ROLES}{spaced('statics', '')}, e as (select e.pid, e.d, s.v, s.v2 from stays e left join space s on e.episode_id = s.episode_id),
one as (select pid, {wm('v', 'd')} as v, case when {wm('v2', 'd')} > 2500 then {wm('v2', 'd')} end as v2 from (select pid, d, v, v * 2 as v2 from e) group by 1), lost as (select pid from one where v2 is null)
select pid, {sql_near('v')} as v, {sql_near('v2')} as v2 from one where v2 is not null union all select pid, {sql_near(wm('v', 'd'))}, {sql_near(wm('v2', 'd'))} from e where pid in (select pid from lost) group by 1""")(lambda r: _legacy(r))
query("a24_match_rate", f"{ROLES}{spaced('yearly', 'yr')}, m as ({timed(BY_YEAR)}), k as (select distinct pid from episodes) select count(*) as cohort_n, count(*) filter (v2 is not null or v > 40) as matched_n, round_even(100.0 * count(*) filter (v2 is not null or v > 40) / greatest(count(*), 1), 2)::double as match_pct from k left join m on k.pid = m.pid")(
    lambda r: results.match_rate(r.episodes, patterns.yearly_areal(r.episodes, r.weights, r.yearly, COLUMNS).withColumn("v", F.when(F.col("v") > 40, F.col("v"))), COLUMNS)
)
query("a25_coverage", """with e as (select cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(o_orderkey % 700 as integer) as b, -130 + o_orderkey % 800 / 10.0 as lon, 20 + o_orderkey % 350 / 10.0 as lat from orders),
f as (select coalesce(a <= date '1996-12-31' and b >= date '1994-01-01', false) as t, lon between -125 and -66 and lat between 24 and 50 as g from e)
select variable, n_rows, in_time, in_region, covered, round_even(100.0 * covered / n_rows, 2)::double as pct from (
 select 'ndi' as variable, count(*) as n_rows, count(*) filter (t) as in_time, count(*) filter (g) as in_region, count(*) filter (t and g) as covered from f
 union all select 'noise', count(*), count(*), count(*) filter (g), count(*) filter (g) from f)""")(
    lambda r: cohort.coverage(r.episodes.select("start_date", "end_date", (-130 + F.col("episode_id") % 800 / 10).alias("lon"), (20 + F.col("episode_id") % 350 / 10).alias("lat")), {"ndi": (1994, 1996), "noise": (None, None)})
)
query("a27_summary", "select o_orderpriority, count(*) as runs, round(median(o_totalprice) + 3.3e-7, 6) as median, min(o_totalprice) as least, max(o_totalprice) as most from orders group by 1")(
    lambda r: results.summary(r.t("orders").withColumnRenamed("o_totalprice", "seconds"), "o_orderpriority").withColumn("median", near(F.col("median")))
)
query("u5_common_units", "select l_partkey as unit from lineitem where l_returnflag = 'R' intersect select p_partkey from part where p_size < 25")(lambda r: r.t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("unit")).intersect(r.t("part").filter("p_size < 25").select("p_partkey")))
_TEXT = "case o_orderkey % 6 when 0 then strftime(d, '%Y-%m-%d') when 1 then strftime(d, '%Y/%m/%d') when 2 then strftime(d, '%Y%m%d') when 3 then cast(month(d) as varchar) || '/' || cast(day(d) as varchar) || '/' || cast(year(d) as varchar) when 4 then strftime(d, '%Y-%m-%dT00:00:00') else 'June 7' end"
query("t6_table_dates", f"select o_orderkey, case when o_orderkey % 6 < 5 then cast(d as varchar) end as date from (select o_orderkey, cast(o_orderdate as date) as d from orders)")(lambda r: _table_dates(r))
query("t8_two_week_ends", """with s as (select distinct d from (select date_trunc('month', cast(o_orderdate as date))::date as d from orders union all select date_trunc('month', cast(o_orderdate as date))::date + 15 from orders)),
n as (select d, lead(d) over (order by d) as nxt from s)
select cast(d as varchar) as start_date, cast(case when nxt is null then case when day(d) = 1 then d + 14 when day(d) = 16 then last_day(d) else d + 13 end else least(nxt - 1, d + 15) end as varchar) as end_date from n""")(lambda r: _two_weeks(r))
query("t14_span", f"{ROLES} select cast(min(start_date) as varchar) as first, cast(max(end_date) as varchar) as last from episodes")(lambda r: periods.span(r.episodes).select(F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last")))
query("v1_cohort_checks", """with c as (select case when c_custkey % 10 = 0 then ' ' else c_name end as pid, cast(c_custkey % 400 - 200 as varchar) as lon, case when c_custkey % 9 = 0 then 'x' when c_custkey % 8 = 0 then null else cast(c_custkey % 95 as varchar) end as lat,
 date '2015-01-01' + cast(c_custkey % 900 as integer) as a, date '2016-01-01' + cast(c_custkey % 700 as integer) as b from customer),
n as (select count(*) filter (trim(pid) = '') as p, count(*) filter (lat is null) as m, count(*) filter (lat = 'x') as x, count(*) filter (abs(try_cast(lon as double)) > 180 or coalesce(abs(try_cast(lat as double)) > 90, false)) as r, count(*) filter (a > b) as o from c)
select * from (select 'pid_missing' as "check", 'error' as level, p as n from n union all select 'coord_missing', 'error', m from n union all select 'coord_not_numeric', 'error', x from n union all select 'coord_range', 'error', r from n union all select 'date_order', 'error', o from n) where n > 0""")(lambda r: _checks(r))
#: The table of _mixed(), and what the rules count in each of its columns.
_MIXED = """with t as (select cast(l_orderkey as varchar) as "key", cast(l_tax as varchar) as tax, case when l_linenumber < 3 then cast(l_discount as varchar) else 'N/A' end as half, case when l_linenumber = 1 then '1' else 'many' end as words, l_returnflag as flag from lineitem),
u as (select unnest([{'place': 0, 'name': 'key', 'v': "key"}, {'place': 1, 'name': 'tax', 'v': tax}, {'place': 2, 'name': 'half', 'v': half}, {'place': 3, 'name': 'words', 'v': words}, {'place': 4, 'name': 'flag', 'v': flag}]) as c from t),
e as (select c.place as place, c.name as name, nullif(trim(c.v), '') as v, nullif(trim(c.v), '') is not null and upper(trim(c.v)) not in ('', 'NA', 'N/A', 'NULL', 'NAN', '.') as given, try_cast(trim(c.v) as double) as x from u),
k as (select place, name, count(*) as n, count(v) as entries, count(*) filter (given) as p, count(*) filter (given and x is null) as f, min(x) filter (given) as least, max(x) filter (given) as most from e group by 1, 2)"""
query("v4_numeric_columns", f"{_MIXED} select name from k where name <> 'key' and p > 0 and f <= 0.5 * n and f < p")(
    lambda r: r.t("lineitem").sparkSession.createDataFrame([(c,) for c in tables.numeric_columns(_mixed(r), ["key"])], "name string")
)
query("s35_preview", f"{_MIXED} select cast(place as integer) as place, name, n as rows, entries > 0 and f = 0 as numeric, case when entries > 0 and f = 0 then least end as least, case when entries > 0 and f = 0 then most end as most from k")(lambda r: tables.preview(_mixed(r)))
query("f11_first_and_last_year", f"{ROLES}{spaced('yearly', 'yr')}{timed(BY_YEAR + ' where p.yr between 1994 and 1996')}")(lambda r: rounded(patterns.yearly_areal(r.episodes, r.weights, r.yearly, COLUMNS, first=1994, last=1996)))


def _numbered(df: DataFrame) -> DataFrame:
    from .shared import numbered

    return numbered(df, "n").withColumn("n", F.col("n") + 1)


def _legacy(r: Roles) -> DataFrame:
    episodes = patterns.static_areal(r.episodes, r.weights, r.static, COLUMNS, "episode").join(engine.stays(r.episodes), ["pid", "episode_id"])
    doubled = engine.temporal_aggregate(episodes.withColumn("v2", F.col("v") * 2), ["pid"], COLUMNS).withColumn("v2", F.when(F.col("v2") > 2500, F.col("v2")))
    return rounded(results.fallback_by_participant(doubled, episodes, "v2", COLUMNS))


def _table_dates(r: Roles) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    forms = [F.date_format(d, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "M/d/yyyy", "yyyy-MM-dd'T'HH:mm:ss")]
    text = F.get(F.array(*forms, F.lit("June 7")), (F.col("o_orderkey") % 6).cast("int"))
    return r.t("orders").select("o_orderkey", dates.first_format(text, tables.DATE_FORMATS).cast("string").alias("date"))


def _two_weeks(r: Roles) -> DataFrame:
    first = F.trunc(F.col("o_orderdate").cast("date"), "month")
    starts = r.t("orders").select(F.explode(F.array(first, F.date_add(first, 15))).alias("start_date")).distinct()
    return periods.two_week_ends(starts).select(F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))


def _checks(r: Roles) -> DataFrame:
    k = F.col("c_custkey")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (k % n).cast("int")).cast("string")
    made = r.t("customer").select(
        F.when(k % 10 == 0, " ").otherwise(F.col("c_name")).alias("pid"), (k % 400 - 200).cast("string").alias("longitude"), F.when(k % 9 == 0, "x").when(k % 8 == 0, None).otherwise((k % 95).cast("string")).alias("latitude"),
        day("2015-01-01", 900).alias("startDate"), day("2016-01-01", 700).alias("endDate"),
    )
    return cohort.validate(made)


def _mixed(r: Roles) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    return r.t("lineitem").select(text("l_orderkey").alias("key"), text("l_tax").alias("tax"), F.when(F.col("l_linenumber") < 3, text("l_discount")).otherwise("N/A").alias("half"), F.when(F.col("l_linenumber") == 1, "1").otherwise("many").alias("words"), text("l_returnflag").alias("flag"))
