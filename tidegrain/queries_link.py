"""Queries over several sources at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans import link
from .queries import BY_DAY, BY_STAY, BY_YEAR, ROLES, Roles, near, query, spaced, timed
from .queries_spatial import boxes, settled

_NAMES = ["poor", "old", "walk", "shade", "dust"]


def five_variables(r: Roles, level: str = "participant", calls: list | None = None) -> DataFrame:
    """Two yearly sources, a static and a daily one, over one geography."""

    def given(_: DataFrame) -> DataFrame:
        (calls if calls is not None else []).append(1)
        return r.weights

    sources = [
        link.Source("a", "parts", "yearly", r.yearly.select("unit", "year", "v"), {"v": "poor"}), link.Source("b", "parts", "yearly", r.yearly.select("unit", "year", "v2"), {"v2": "old"}),
        link.Source("c", "parts", "static", r.static, {"v": "walk", "v2": "shade"}), link.Source("d", "parts", "daily", r.daily, {"v2": "dust"}),
    ]
    return link.link(r.episodes, settled(r), sources, {"parts": link.Geography(given)}, level)


_YEARS, _STAYS, _DAYS = f"{ROLES}{spaced('yearly', 'yr')}{timed(BY_YEAR)}", f"{ROLES}{spaced('statics', '')}{timed(BY_STAY)}", f"{ROLES}{spaced('daily', 'date')}{timed(BY_DAY)}"
query(
    "k1_link_sources",
    f"""select p.pid, y.v as poor, y.v2 as old, s.v as walk, s.v2 as shade, d.v2 as dust from (select distinct cast(o_custkey as varchar) as pid from orders) p
left join ({_YEARS}) y on p.pid = y.pid left join ({_STAYS}) s on p.pid = s.pid left join ({_DAYS}) d on p.pid = d.pid""",
)(lambda r: five_variables(r).select("pid", *[near(F.col(c)).alias(c) for c in _NAMES]))


def _two_geographies(r: Roles) -> DataFrame:
    """Values of boxes under the buffers, and of parts."""
    tall = r.t("supplier").select(F.col("s_suppkey").alias("unit"), F.col("s_acctbal").cast("double").alias("v"))
    sources = [link.Source("boxes", "boxes", "static", tall, {"v": "v"}), link.Source("parts", "parts", "static", r.static, {"v": "v", "v2": "v2"})]
    return link.link(r.episodes, settled(r), sources, {"boxes": link.polygons(boxes(r), "boxes", exact=True), "parts": link.Geography(lambda _: r.weights)}, "episode")


def _boxes_sql() -> str:
    from .queries_spatial import _SETTLED, RADIUS, _exact_sql

    exact = _exact_sql(_SETTLED, RADIUS)
    return f"""select e.pid, e.episode_id, round(b.v + 3.3e-4, 3) as v, round(s.v + 3.3e-4, 3) as v_parts_dup, round(s.v2 + 3.3e-4, 3) as v2
from (select cast(o_custkey as varchar) as pid, o_orderkey as episode_id from orders) e
left join (select w.episode_id, sum(s_acctbal * weight) / sum(weight) as v from ({exact.replace('+ 3.3e-7, 6)', ', 15)')}) w join supplier on s_suppkey = unit group by 1) b on e.episode_id = b.episode_id
left join (select l_orderkey as episode_id, sum(p_retailprice * l_quantity) / sum(l_quantity) as v, sum(nullif(cast(p_size as double), 7.0) * l_quantity) / nullif(sum(case when p_size <> 7 then l_quantity end), 0) as v2
 from lineitem join part on l_partkey = p_partkey group by 1) s on e.episode_id = s.episode_id"""


query("k1_link_geographies", _boxes_sql())(lambda r: _two_geographies(r).select("pid", "episode_id", *[F.round(F.col(c) + 3.3e-4, 3).alias(c) for c in ("v", "v_parts_dup", "v2")]))
