"""One call for many sources: sources that share a geography share its weights, and those that also share a kind of period are one pass.

plan() says what link() does, as a list of steps, and triggers nothing.  Weights come first, one step for each geography that some source
needs; then one step for each (geography, kind): the values of all its sources are put below one another, each with its own columns, and
go through the two aggregations, space and time, together.  Missing values take no part in a mean, so that gives what each source
alone would give, with one shuffle by episode in place of one for each source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.engine import keys as level_keys
from ..operators.overlap import overlap_shares, overlap_weights
from ..operators.places import spots_of
from ..shared import written
from . import patterns
from .results import final_table, kept_weights
from .spatial import buffer_grid, placed

#: Kinds of values by the columns of their period.
KINDS = {"static": (), "yearly": ("year",), "daily": ("date",), "windowed": ("start_date", "end_date")}


@dataclass(frozen=True)
class Geography:
    """make: points(episode_id, lon, lat) -> weights(episode_id, unit, weight); settings: what the weights depend on beside the points.
    by_place: the weights depend on the place only, so that they and the means in space are made once for each place."""

    make: Callable[[DataFrame], DataFrame]
    settings: dict = field(default_factory=dict)
    by_place: bool = False


@dataclass(frozen=True)
class Source:
    """values(unit, the period's columns, columns); columns: {column: name in the result}."""

    name: str
    geography: str
    kind: str
    values: DataFrame
    columns: dict[str, str]


@dataclass(frozen=True)
class Step:
    """what: weights or values; kind: of the values; columns: {source: {column: name in the result}}."""

    what: str
    geography: str
    kind: str = ""
    columns: dict[str, dict[str, str]] = field(default_factory=dict)


def polygons(table: DataFrame, name: str, radius: float = 270.0, step: float = 25.0, exact: bool = False) -> Geography:
    """Shares of the buffer by polygon of table(unit, rings) in metres; name: stands for the table in kept weights."""
    make = (lambda p: overlap_shares(placed(p), table, radius)) if exact else (lambda p: overlap_weights(placed(p), table, radius, step))
    return Geography(make, {"polygons": name, "radius": radius, "step": None if exact else step}, True)


def grid(cells: dict[str, float], radius: float = 270.0, offset: int = 0, degrees: bool = True) -> Geography:
    """Shares of the buffer by cell of a raster's grid."""
    return Geography(lambda p: buffer_grid(p, cells, radius, offset, degrees), {"grid": cells, "radius": radius, "offset": offset, "degrees": degrees}, True)


def plan(sources: list[Source], taken: tuple[str, ...] = ()) -> list[Step]:
    """Weights before the values that need them, both in the order in which sources ask for them.  A name that is taken, by the result's keys or
    an earlier source, becomes <name>_<source>_dup."""
    names, used, order = [s.name for s in sources], set(taken), {}
    if not sources:
        raise ValueError("no sources")
    if len(set(names)) < len(names):
        raise ValueError("two sources of one name")
    for s in sources:
        if s.kind not in KINDS:
            raise ValueError(f"{s.name}: {s.kind!r} is not one of {', '.join(KINDS)}")
        absent = [c for c in ("unit", *KINDS[s.kind], *s.columns) if c not in s.values.columns]
        if absent:
            raise ValueError(f"{s.name}: no column {', '.join(absent)}")
        given = {}
        for c, name in s.columns.items():
            given[c] = name if name not in used else f"{name}_{s.name}_dup"
            if given[c] in used:
                raise ValueError(f"{s.name}: {given[c]} is taken")
            used.add(given[c])
        order.setdefault((s.geography, s.kind), {})[s.name] = given
    shared = list(dict.fromkeys(s.geography for s in sources))
    return [Step("weights", g) for g in shared] + [Step("values", g, k, columns) for (g, k), columns in order.items()]


def _values(step: Step, sources: dict[str, Source]) -> DataFrame:
    parts = [sources[n].values.select("unit", *KINDS[step.kind], *[F.col(c).cast("double").alias(name) for c, name in columns.items()]) for n, columns in step.columns.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def link(episodes: DataFrame, points: DataFrame, sources: list[Source], geographies: dict[str, Geography], level: str = "participant", folder: str | None = None) -> DataFrame:
    """episodes(pid, episode_id, start_date, end_date), points(episode_id, lon, lat) -> every participant, or episode, in input order with the
    sources' columns in the order asked for; missing where a source has nothing.  folder: keeps weights for later runs over the same points."""
    by_name, weights, parts = {s.name: s for s in sources}, {}, []
    steps = plan(sources, tuple(level_keys(level)))
    unknown = [s.geography for s in steps if s.geography not in geographies]
    if unknown:
        raise ValueError(f"no geography {unknown[0]}")
    places = keys = None
    if folder is None and any(geographies[s.geography].by_place for s in steps):
        rows, keys = spots_of(points.select("episode_id", F.col("lon").alias("x"), F.col("lat").alias("y")))
        places = rows.withColumnsRenamed({"x": "lon", "y": "lat"})
    for step in steps:
        g = geographies[step.geography]
        placed_once = folder is None and g.by_place
        if step.what == "weights":
            made = lambda g=g, at=places if placed_once else points: g.make(at).select("episode_id", "unit", "weight")
            weights[step.geography] = written(made(), "weights") if folder is None else kept_weights(points.sparkSession, folder, points, g.settings | {"geography": step.geography}, made)
            continue
        columns, w, v = [n for c in step.columns.values() for n in c.values()], weights[step.geography], _values(step, by_name)
        if placed_once and step.kind in ("static", "yearly"):
            parts.append(patterns.areal_by_place(episodes, keys, w, v, columns, level, step.kind == "yearly"))
            continue
        if placed_once:
            w = keys.join(w.withColumnRenamed("episode_id", "__spot"), "__spot").drop("__spot")
        if step.kind == "static":
            parts.append(patterns.static_areal(episodes, w, v, columns, level))
        elif step.kind == "yearly":
            parts.append(patterns.yearly_areal(episodes, w, v, columns, level))
        else:
            parts.append(patterns.gridded(episodes, w, v, columns, level, step.kind == "daily"))
    named = {n: c for step in steps for n, c in step.columns.items()}
    return final_table(episodes, patterns.merge(parts, level_keys(level)), [name for s in sources for name in named[s.name].values()], level)
