"""Queries of the spatial operators over the driver's tables and their SQL.

Orders stand in a plain of 20 by 10 km for buffers and segments, by a rule on their key; suppliers give boxes and lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import spatial
from .operators.places import by_place
from .plans import spatial as plans
from .queries import _LAT, _LON, _X, _Y, Roles, _albers_sql, _placed, query

#: Radius of a buffer and side of the lattice in metres.
RADIUS, STEP = 270.0, 25.0
_PX, _PY = "({0} * 7919 % 20000) + 0.37", "({0} * 104729 % 10000) + 0.21"


def _plain(df: DataFrame, key: str) -> DataFrame:
    return df.select("*", F.expr(_PX.format(key)).cast("double").alias("x"), F.expr(_PY.format(key)).cast("double").alias("y"))


def people(r: Roles) -> DataFrame:
    return _plain(r.t("orders").select(F.col("o_orderkey").alias("episode_id")), "episode_id").select("episode_id", "x", "y")


PEOPLE = f"select o_orderkey as episode_id, cast({_PX.format('o_orderkey')} as double) as x, cast({_PY.format('o_orderkey')} as double) as y from orders"
#: A supplier's box around its place, with a hole of half its sides; boxes overlap.
_W, _H = "(100 + s_suppkey * 37 % 400)", "(120 + s_suppkey * 53 % 380)"


def boxes(r: Roles) -> DataFrame:
    s = _plain(r.t("supplier"), "s_suppkey").withColumns({"w": F.expr(_W).cast("double"), "h": F.expr(_H).cast("double")})
    ring = lambda k: F.array(*[F.struct((F.col("x") + a * k * F.col("w")).alias("x"), (F.col("y") + b * k * F.col("h")).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    return s.select(F.col("s_suppkey").alias("unit"), F.array(ring(1.0), ring(0.5)).alias("rings"))


BOXES = f"select s_suppkey as unit, cast({_PX.format('s_suppkey')} as double) as bx, cast({_PY.format('s_suppkey')} as double) as by_, cast({_W} as double) as w, cast({_H} as double) as h from supplier"


def _in_box(x: str, y: str) -> str:
    half_open = lambda k: f"({x} >= bx - {k} * w and {x} < bx + {k} * w and {y} >= by_ - {k} * h and {y} < by_ + {k} * h)"
    return f"({half_open(1.0)} and not {half_open(0.5)})"


def _share_sql(x0: str, x1: str, y0: str, y1: str, r: float = RADIUS) -> str:
    """Area of the disk at the origin in a rectangle, from the four corners."""

    def strip(v: str) -> str:
        v = f"greatest({-r}, least({r}, {v}))"
        return f"({r * r} * ({math.pi / 2!r} + asin({v} / {r})) + {v} * sqrt(greatest(0.0, {r * r} - {v} * {v})))"

    def corner(x: str, y: str) -> str:
        out = f"{x} * {x} + {y} * {y} >= {r * r}"
        return (
            f"(case when {out} and {x} <= 0 and {y} <= 0 then 0.0 when {out} and {x} >= 0 and {y} >= 0 then {strip(x)} + {strip(y)} - {math.pi * r * r!r}"
            f" when {out} and {x} < 0 then {strip(x)} when {out} then {strip(y)} else ({strip(x)} + {strip(y)}) / 2 - {math.pi * r * r / 4!r} + {x} * {y} end)"
        )

    return f"{corner(x1, y1)} - {corner(x0, y1)} - {corner(x1, y0)} + {corner(x0, y0)}"


def _cells_sql(people_: str, step: float) -> str:
    """CTEs p and c: the lattice cells of every buffer with their areas."""
    return f"""with p as ({people_}),
g as (select episode_id, x, y, unnest(range(cast(floor((x - {RADIUS}) / {step}) as bigint), cast(floor((x + {RADIUS}) / {step}) as bigint) + 1)) as i from p),
e as (select *, unnest(range(cast(floor((y - {RADIUS}) / {step}) as bigint), cast(floor((y + {RADIUS}) / {step}) as bigint) + 1)) as j from g),
q as (select episode_id, i, j, i * {step} - x as x0, (i + 1) * {step} - x as x1, j * {step} - y as y0, (j + 1) * {step} - y as y1 from e),
c as (select episode_id, i, j, {_share_sql('x0', 'x1', 'y0', 'y1')} as area from q)"""


six = lambda c: F.round(F.col(c) + 3.3e-7, 6).alias(c)
def _overlap_sql(people_: str) -> str:
    return f"""{_cells_sql(people_, STEP)}, b as ({BOXES}), m as (select episode_id, i, j, max(unit) as unit, any_value(area) as area from c join b on {_in_box(f'((i + 0.5) * {STEP})', f'((j + 0.5) * {STEP})')} where area > 1e-9 group by 1, 2, 3),
a as (select episode_id, unit, sum(area) as area from m group by 1, 2)
select episode_id, unit, round(area / sum(area) over (partition by episode_id) + 3.3e-7, 6) as weight from a"""


query("g3_overlap_weights", _overlap_sql(PEOPLE))(lambda r: spatial.overlap_weights(people(r), boxes(r), RADIUS, STEP).select("episode_id", "unit", six("weight")))
_GRID = 180.0


def _grid_sql(people_: str) -> str:
    return f"""{_cells_sql(f"select episode_id, x, 10000 - y as y from ({people_})", _GRID)}, k as (select * from c where area > 1e-9 and i between 0 and 110 and j between 0 and 54)
select episode_id, j * 111 + i + 1 as unit, round(area / sum(area) over (partition by episode_id) + 3.3e-7, 6) as weight from k"""


query("g5_grid_weights", _grid_sql(PEOPLE))(lambda r: spatial.grid_weights(people(r), 0.0, 10_000.0, _GRID, 111, 55, RADIUS, 1).select("episode_id", "unit", six("weight")))
def _wrong_sums(places: DataFrame) -> DataFrame:
    cells = spatial.disk_cells(places, RADIUS, _GRID).filter("i between 0 and 110 and j between 0 and 54")
    return spatial.wrong_weight_sums(cells.select("episode_id", (F.col("area") / (math.pi * RADIUS**2)).alias("weight")))


query("a19_weight_sums", f"""{_cells_sql(f"select episode_id, x, 10000 - y as y from ({PEOPLE})", _GRID)}, k as (select episode_id, sum(area) as total from c where area > 1e-9 and i between 0 and 110 and j between 0 and 54 group by 1)
select episode_id, round(total / {math.pi * RADIUS * RADIUS!r} + 3.3e-7, 6) as total from k where abs(total / {math.pi * RADIUS * RADIUS!r} - 1) >= 1e-6""")(
    lambda r: by_place(people(r).select("episode_id", "x", (10_000 - F.col("y")).alias("y")), _wrong_sums).select("episode_id", six("total"))
)
query("j19_points_in_polygons", f"with p as ({PEOPLE}), b as ({BOXES}) select episode_id, min(unit) as unit from p left join b on {_in_box('x', 'y')} group by 1")(lambda r: spatial.points_in_polygons(people(r), boxes(r)))


def roads(r: Roles) -> DataFrame:
    """From each supplier to the next one: a road of one of three classes, in one of three years."""
    at = _plain(r.t("supplier").select("s_suppkey"), "s_suppkey")
    to = at.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    kind = F.element_at(F.array(*map(F.lit, ("S1100", "S1200", "S1400"))), F.expr("int(s_suppkey div 3 % 3) + 1"))
    return at.join(to, "s_suppkey").select((F.col("s_suppkey") % 3 + 2013).cast("int").alias("year"), kind.alias("MTFCC"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


ROADS = f"""select a.s_suppkey % 3 + 2013 as year, case a.s_suppkey // 3 % 3 when 0 then 'pri' when 1 then 'sec' end as class, a.x as x1, a.y as y1, b.x as x2, b.y as y2
from (select s_suppkey, cast({_PX.format('s_suppkey')} as double) as x, cast({_PY.format('s_suppkey')} as double) as y from supplier) a
join (select s_suppkey - 1 as s_suppkey, cast({_PX.format('s_suppkey')} as double) as x, cast({_PY.format('s_suppkey')} as double) as y from supplier) b on a.s_suppkey = b.s_suppkey"""
_T = "(case when x1 = x2 and y1 = y2 then 0 else greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) end)"
FAR = f"sqrt(pow(x1 + {_T} * (x2 - x1) - x, 2) + pow(y1 + {_T} * (y2 - y1) - y, 2))"
three = lambda c: F.round(F.col(c) + 3.3e-4, 3).alias(c)
query("n7_nearest_line", f"with p as ({PEOPLE}), l as ({ROADS}) select episode_id, round(min({FAR}) + 3.3e-4, 3) as distance from p, l group by 1")(
    lambda r: spatial.nearest(people(r), roads(r), cell=500.0).select("episode_id", three("distance"))
)
query("n1_proximity_polygons", f"""with p as ({PEOPLE}), b as ({BOXES}), k as (select unit, bx, by_, w, h, unnest([1.0, 0.5]) as z from b),
s as (select unit, unnest([[bx - z * w, by_ - z * h, bx + z * w, by_ - z * h], [bx + z * w, by_ - z * h, bx + z * w, by_ + z * h], [bx + z * w, by_ + z * h, bx - z * w, by_ + z * h], [bx - z * w, by_ + z * h, bx - z * w, by_ - z * h]]) as e from k),
l as (select e[1] as x1, e[2] as y1, e[3] as x2, e[4] as y2 from s), d as (select episode_id, min({FAR}) as d from p, l group by 1), i as (select distinct episode_id from p join b on {_in_box('x', 'y')})
select d.episode_id, round(case when i.episode_id is not null then 0.0 else d end + 3.3e-4, 3) as distance from d left join i on d.episode_id = i.episode_id""")(
    lambda r: spatial.proximity(people(r), polygons=boxes(r), cell=500.0).select("episode_id", three("distance"))
)
# roads between suppliers at their places on the globe
_SX, _SY = _albers_sql("s_suppkey")


def _far_roads(r: Roles) -> DataFrame:
    at = _placed(r.t("supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", "x", "y")
    to = at.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    kind = F.element_at(F.array(*map(F.lit, ("S1100", "S1200", "S1400"))), F.expr("int(s_suppkey div 3 % 3) + 1"))
    return at.join(to, "s_suppkey").select((F.col("s_suppkey") % 3 + 2013).cast("int").alias("year"), kind.alias("MTFCC"), F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def globe(r: Roles) -> DataFrame:
    lon, lat = F.expr(_LON.format("episode_id")).cast("double"), F.expr(_LAT.format("episode_id")).cast("double")
    return r.t("orders").select(F.col("o_orderkey").alias("episode_id")).select("episode_id", lon.alias("lon"), lat.alias("lat"))


_FAR_ROADS = ROADS.replace(f"cast({_PX.format('s_suppkey')} as double)", _SX).replace(f"cast({_PY.format('s_suppkey')} as double)", _SY)
query("l15_tiger_proximity", f"""with p as (select o_orderkey as episode_id, {_X} as x, {_Y} as y from orders), l as ({_FAR_ROADS}), d as (select episode_id, year, class, min({FAR}) as d from p, l where class is not null group by 1, 2, 3),
w as (select episode_id, year, max(case when class = 'pri' then d end) as a, max(case when class = 'sec' then d end) as b from d group by 1, 2)
select episode_id, cast(year as integer) as year, round(a + 3.3e-4, 2) as dist_pri, round(b + 3.3e-4, 2) as dist_sec, round(least(a, b) + 3.3e-4, 2) as dist_prisec from w""")(
    lambda r: plans.road_distances(globe(r), _far_roads(r), cell=40_000.0).select("episode_id", "year", *[F.round(F.col(c) + 3.3e-4, 2).alias(c) for c in ("dist_pri", "dist_sec", "dist_prisec")])
)
# the plain again, by degrees around the projection's origin: patterns that take places in degrees
_PLAIN_LON, _PLAIN_LAT = "(-96 + ({0} * 7919 % 20000) / 100000.0)", "(37.5 + ({0} * 104729 % 10000) / 100000.0)"
#: Wide enough for boxes that are more than 500 m apart to be in one buffer.
WIDE = 600.0


def settled(r: Roles) -> DataFrame:
    lon, lat = (F.expr(c.format("episode_id")).cast("double") for c in (_PLAIN_LON, _PLAIN_LAT))
    return r.t("orders").select(F.col("o_orderkey").alias("episode_id")).select("episode_id", lon.alias("lon"), lat.alias("lat"))


def _exact_sql(people_: str, r: float) -> str:
    ring = lambda k: _share_sql(f"(bx - {k} * w - x)", f"(bx + {k} * w - x)", f"(by_ - {k} * h - y)", f"(by_ + {k} * h - y)", r)
    return f"""with p as ({people_}), b as ({BOXES}),
m as (select episode_id, unit, bx, by_, w, h, {ring(1.0)} - ({ring(0.5)}) as area from p join b on abs(bx - x) < w + {r} and abs(by_ - y) < h + {r}),
a as (select * from m where area > 1e-6)
select a.episode_id, a.unit, round(any_value(a.area) / sum(o.area) + 3.3e-7, 6) as weight from a join a o on a.episode_id = o.episode_id and abs(a.bx - o.bx) <= a.w + o.w + 500 and abs(a.by_ - o.by_) <= a.h + o.h + 500 group by 1, 2"""


query("g4_exact_overlap", _exact_sql(PEOPLE, RADIUS))(lambda r: spatial.overlap_shares(people(r), boxes(r), RADIUS).select("episode_id", "unit", six("weight")))
query("n2_road_files", """with k as (select distinct case when c_custkey % 5 = 0 then '46113' else lpad(cast(c_custkey % 900 * 2 + 1001 as varchar), 5, '0') end as county, cast(2012 + c_custkey % 6 as integer) as year from customer)
select county, year, case when county = '46113' and year >= 2015 then '46102' else county end as code, 'tl_' || year || '_' || case when county = '46113' and year >= 2015 then '46102' else county end || '_roads.zip' as name from k""")(
    lambda r: plans.road_files(r.t("customer").select(F.expr("case when c_custkey % 5 = 0 then '46113' else lpad(cast(c_custkey % 900 * 2 + 1001 as string), 5, '0') end").alias("county"), F.expr("int(2012 + c_custkey % 6)").alias("year")))
)
_WATER_LON, _WATER_LAT = _LON.format("c_custkey"), _LAT.format("c_custkey")
_LAYER = "case c_custkey % 4 when 0 then 'NHDFlowline' when 1 then 'NHDWaterbody' when 2 then 'NHDArea' else 'NetworkNHDFlowline' end"
_CODE = "case c_custkey % 7 when 0 then 46006 when 1 then 56600 when 2 then 39004 when 3 then 31200 when 4 then 55800 when 5 then 99900 else 43600 end"


def waters(r: Roles) -> DataFrame:
    c = r.t("customer").select("c_custkey")
    at = c.select(F.expr(_LAYER).alias("layer"), F.expr(_CODE).alias("fcode"), F.expr(_WATER_LON).cast("double").alias("lon1"), F.expr(_WATER_LAT).cast("double").alias("lat1"))
    return at.withColumns({"lon2": F.col("lon1") + 0.011, "lat2": F.col("lat1") + 0.007})


def _albers_of(lon: str, lat: str) -> tuple[str, str]:
    x, y = _albers_sql("zz")
    put = lambda s: s.replace(_LON.format("zz"), f"({lon})").replace(_LAT.format("zz"), f"({lat})")
    return put(x), put(y)


_SETTLED = "select o_orderkey as episode_id, {} as x, {} as y from orders".format(*_albers_of(f"cast({_PLAIN_LON.format('o_orderkey')} as double)", f"cast({_PLAIN_LAT.format('o_orderkey')} as double)"))
query("l12_boundary_overlap", _exact_sql(_SETTLED, WIDE))(lambda r: plans.boundary_overlap(settled(r), boxes(r), WIDE).select("episode_id", "unit", six("weight")))
query("l13_boundary_overlap_fast", _overlap_sql(_SETTLED))(lambda r: plans.boundary_overlap_fast(settled(r), boxes(r), RADIUS, STEP).select("episode_id", "unit", six("weight")))
query("l14_grid_weights", _grid_sql(_SETTLED))(
    lambda r: plans.buffer_grid(settled(r), {"x0": 0.0, "y0": 10_000.0, "cell": _GRID, "width": 111, "height": 55}, RADIUS, 1, degrees=False).select("episode_id", "unit", six("weight"))
)
_A, _B = _albers_of("lon1", "lat1"), _albers_of("lon2", "lat2")
_WIDE = f"({plans.PAD} / (111320.0 * cos(radians(least(85.0, greatest(abs(lat1), abs(lat2)) + 0.5 + {plans.PAD / 110574.0!r})))))"
_HIGH = repr(plans.PAD / 110574.0)
query("l16_nhd_proximity", f"""with p as (select o_orderkey as episode_id, {_X} as x, {_Y} as y, cast(floor(cast({_LON.format('o_orderkey')} as double) / 0.5) as bigint) as tx, cast(floor(cast({_LAT.format('o_orderkey')} as double) / 0.5) as bigint) as ty from orders),
f as (select layer, code // 100 as k, lon1, lat1, lon1 + 0.011 as lon2, lat1 + 0.007 as lat2 from (select {_LAYER} as layer, {_CODE} as code, cast({_WATER_LON} as double) as lon1, cast({_WATER_LAT} as double) as lat1 from customer)),
c as (select *, 'flow' as category, k in (460, 336, 558) as good from f where layer like '%Flowline' union all select *, 'water', k in (390, 436, 466, 493) from f where layer = 'NHDWaterbody'
      union all select *, 'area', k in (312, 493, 460) from f where layer = 'NHDArea' union all select *, 'coast', k = 566 from f where layer like '%Flowline'),
u as (select *, unnest(range(cast(floor((least(lon1, lon2) - {_WIDE}) / 0.5) as bigint), cast(floor((greatest(lon1, lon2) + {_WIDE}) / 0.5) as bigint) + 1)) as tx from c),
v as (select *, unnest(range(cast(floor((least(lat1, lat2) - {_HIGH}) / 0.5) as bigint), cast(floor((greatest(lat1, lat2) + {_HIGH}) / 0.5) as bigint) + 1)) as ty from u),
g as (select *, bool_or(good) over (partition by tx, ty, category) as any_good from v),
l as (select tx, ty, category, {_A[0]} as x1, {_A[1]} as y1, {_B[0]} as x2, {_B[1]} as y2 from g where good or (not any_good and category <> 'coast')),
d as (select episode_id, category, min({FAR}) as d from p join l on p.tx = l.tx and p.ty = l.ty group by 1, 2),
w as (select p.episode_id, max(case when category = 'flow' then d end) as flow, max(case when category = 'water' then d end) as water, max(case when category = 'area' then d end) as area, max(case when category = 'coast' then d end) as coast from p left join d on p.episode_id = d.episode_id group by 1)
select episode_id, round(flow + 3.3e-4, 2) as dist_flow, round(water + 3.3e-4, 2) as dist_water, round(area + 3.3e-4, 2) as dist_area, round(coast + 3.3e-4, 2) as dist_coast, round(least(flow, water, area, coast) + 3.3e-4, 2) as dist_blue from w""")(
    lambda r: plans.water_distances(globe(r), waters(r)).select("episode_id", *[F.round(F.col(f"dist_{c}") + 3.3e-4, 2).alias(f"dist_{c}") for c in ("flow", "water", "area", "coast", "blue")])
)


def _proximity(r: Roles) -> DataFrame:
    shops = _placed(r.t("supplier").join(F.broadcast(r.t("nation")), F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey")
    shops = shops.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("kind"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    names = [f"r{k}" for k in range(5)]
    out = plans.proximity(r.episodes, globe(r), shops, category="kind", categories=names, cell=20_000.0)
    return out.select("pid", *[F.round(F.col(c) + 3.3e-4, 2).alias(c) for c in names])


_KINDS = ", ".join(f"max(case when k = {j} then d end) as r{j}" for j in range(5))
_MEANS = ", ".join(f"round(sum(r{j} * n) / sum(case when r{j} is not null then n end) + 3.3e-4, 2) as r{j}" for j in range(5))
query("l11_proximity", f"""with d as (select o.episode_id, s.k, min(sqrt(pow(o.x - s.x, 2) + pow(o.y - s.y, 2))) as d from (select o_orderkey as episode_id, {_X} as x, {_Y} as y from orders) o, (select n_regionkey as k, {_SX} as x, {_SY} as y from supplier join nation on s_nationkey = n_nationkey) s group by 1, 2),
w as (select episode_id, {_KINDS} from d group by 1), t as (select cast(o_custkey as varchar) as pid, o_orderkey as episode_id, cast(o_orderkey % 700 as integer) + 1 as n from orders)
select pid, {_MEANS} from t left join w on t.episode_id = w.episode_id group by 1""")(_proximity)
