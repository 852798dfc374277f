"""Rings that cross or touch themselves or one another, made over into rings that do not, of the same inside by the even-odd rule; and
shapes from one projection to another.

A polygon's edges are split where they cross, and where a vertex lies on another edge; pieces that then lie on one another cancel in pairs,
which takes spikes and shared edges away; what is left is walked with the inside to the left, turning as far right as it goes, so a figure of
eight becomes two rings that touch.  Only polygons in which something crosses or touches are made over."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from ..operators.projections import Projection
from .vectors import _SHAPE, cleaned

#: Distance from an edge, as a share of the polygon's coordinates, within which a vertex lies on it.
NEAR = 1e-12


def edges(rings: list[np.ndarray]) -> np.ndarray:
    """(n, 4) of all edges that have a length."""
    parts = [np.concatenate([r, np.roll(r, -1, axis=0)], 1) for r in rings if len(r) > 1]
    e = np.concatenate(parts) if parts else np.zeros((0, 4))
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)]


def cuts(e: np.ndarray) -> dict[int, list[tuple[float, float]]]:
    """The points at which edges have to be split: a sweep from left to right compares an edge with those that begin before it ends."""
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    order = np.argsort(low[:, 0], kind="stable")
    reach = np.searchsorted(low[order, 0], high[order, 0], side="right")
    near = NEAR * max(1.0, float(np.abs(e).max(initial=0.0)))
    found: dict[int, list[tuple[float, float]]] = defaultdict(list)
    for k, i in enumerate(order.tolist()):
        js = order[k + 1 : reach[k]]
        js = js[(low[js, 1] <= high[i, 1]) & (high[js, 1] >= low[i, 1])]
        if not len(js):
            continue
        p, d, q, f = e[i, :2], e[i, 2:] - e[i, :2], e[js, :2], e[js, 2:] - e[js, :2]
        side = lambda o, v, at: v[..., 0] * (at[..., 1] - o[..., 1]) - v[..., 1] * (at[..., 0] - o[..., 0])
        qa, qb = side(p, d, q), side(p, d, e[js, 2:])
        pa_, pb = side(q, f, p), side(q, f, e[i, 2:])
        wide_i, wide_j = near * math.hypot(*d), near * np.hypot(f[:, 0], f[:, 1])
        on = {"qa": np.abs(qa) <= wide_i, "qb": np.abs(qb) <= wide_i, "pa": np.abs(pa_) <= wide_j, "pb": np.abs(pb) <= wide_j}
        proper = (qa * qb < 0) & (pa_ * pb < 0) & ~(on["qa"] | on["qb"] | on["pa"] | on["pb"])
        for n in np.flatnonzero(proper).tolist():
            t = qa[n] / (qa[n] - qb[n])
            at = (float(q[n, 0] + t * f[n, 0]), float(q[n, 1] + t * f[n, 1]))
            found[i].append(at)
            found[int(js[n])].append(at)
        within = lambda edge, at: ((at - edge[:2]) @ (edge[2:] - edge[:2]) > 0) and ((at - edge[2:]) @ (edge[:2] - edge[2:]) > 0)
        for n in np.flatnonzero(on["qa"] | on["qb"] | on["pa"] | on["pb"]).tolist():
            j = int(js[n])
            for name, edge, at in (("qa", i, e[j, :2]), ("qb", i, e[j, 2:]), ("pa", j, e[i, :2]), ("pb", j, e[i, 2:])):
                if on[name][n] and within(e[edge], at):
                    found[edge].append((float(at[0]), float(at[1])))
    return found


def _pieces(e: np.ndarray, found: dict[int, list[tuple[float, float]]]) -> np.ndarray:
    """The edges split, those that lie on one another an even number of times left out."""
    times: dict[tuple, int] = defaultdict(int)
    for i, (ax, ay, bx, by) in enumerate(e.tolist()):
        along = sorted({(ax, ay), (bx, by), *found.get(i, ())}, key=lambda p: (p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay))
        for a, b in zip(along[:-1], along[1:], strict=True):
            times[(a, b) if a < b else (b, a)] += 1
    return np.array([(*a, *b) for (a, b), n in times.items() if n % 2], float).reshape(-1, 4)


def _inside_left(e: np.ndarray) -> np.ndarray:
    """The pieces turned so that the inside lies to their left."""
    mid, flat = (e[:, :2] + e[:, 2:]) / 2, e[:, 1] == e[:, 3]
    turn = np.zeros(len(e), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(len(e)):
            # edges before it: to the west of its middle, or to the south of a level one
            c, o = (1, 0) if not flat[k] else (0, 1)
            a, b, at = e[:, c], e[:, c + 2], mid[k, c]
            meets = e[:, o] + (at - a) * (e[:, o + 2] - e[:, o]) / (b - a)
            before = ((a > at) != (b > at)) & (meets < mid[k, o])
            before[k] = False
            inside = before.sum() % 2 == 1
            forward = e[k, 3] > e[k, 1] if not flat[k] else e[k, 2] < e[k, 0]  # west is to the left of north, south to the left of west
            turn[k] = inside != forward
    return np.where(turn[:, None], e[:, [2, 3, 0, 1]], e)


def remade(rings: list[np.ndarray]) -> list[np.ndarray] | None:
    """Rings of the same inside without crossings, doubled edges or spikes; None if there are none of these."""
    e = edges(rings)
    found = cuts(e)
    keys = [(a, b) if a < b else (b, a) for a, b in zip(map(tuple, e[:, :2].tolist()), map(tuple, e[:, 2:].tolist()), strict=True)]
    if not found and len(set(keys)) == len(keys):
        return None
    e = _inside_left(_pieces(e, found))
    leaving: dict[tuple, list[tuple]] = defaultdict(list)
    for ax, ay, bx, by in e.tolist():
        leaving[ax, ay].append((bx, by))
    out = []
    while leaving:
        start = next(iter(leaving))
        ring, at = [start], leaving[start].pop()
        while at != start:
            back = math.atan2(ring[-1][1] - at[1], ring[-1][0] - at[0])
            ring.append(at)
            if not leaving[at]:
                break
            # clockwise from where the walk came from
            near = min(leaving[at], key=lambda p: (back - math.atan2(p[1] - at[1], p[0] - at[0])) % (2 * math.pi) or 2 * math.pi)
            leaving[at].remove(near)
            at = near
        for p in [p for p in leaving if not leaving[p]]:
            del leaving[p]
        if len(ring) > 2:
            out.append(np.array(ring))
    return out


_RINGS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _shapes_through(df: DataFrame, change) -> DataFrame:
    """df with rings and lines changed, batch by batch: change(rings, lines) of Arrow arrays."""
    keep = [f for f in df.schema.fields if f.name not in ("rings", "lines")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rings, lines = change(batch.column("rings"), batch.column("lines"))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], rings, lines], [*[f.name for f in keep], "rings", "lines"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], _SHAPE])
    return df.select(*[f.name for f in keep], "rings", "lines").mapInArrow(run, schema)


def repaired(shapes: DataFrame) -> DataFrame:
    """shapes(rings, lines, ...) with rings that neither cross nor lie on one another; what has no inside loses its rings, and a shape
    without any goes."""

    def change(rings, lines):
        out = []
        for shape in rings.to_pylist():
            made = remade([np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in shape])
            out.append(shape if made is None else [[{"x": x, "y": y} for x, y in r.tolist()] for r in made])
        return pa.array(out, _RINGS), lines

    return cleaned(_shapes_through(cleaned(shapes), change))


def _moved(column: pa.ListArray, source: Projection, target: Projection) -> pa.ListArray:
    inner = column.flatten()
    points = inner.flatten()
    x, y = (points.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    x, y = target.forward(*source.inverse(x, y))
    ends = lambda a: np.concatenate([[0], np.cumsum(pa.compute.list_value_length(a).to_numpy(zero_copy_only=False))]).astype("i4")
    moved = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])
    return pa.ListArray.from_arrays(pa.array(ends(column)), pa.ListArray.from_arrays(pa.array(ends(inner)), moved))


def reprojected(shapes: DataFrame, source: Projection, target: Projection) -> DataFrame:
    """shapes(rings, lines, ...) from one projection to another, all points of a batch at once."""
    return _shapes_through(shapes, lambda rings, lines: tuple(_moved(c, source, target) for c in (rings, lines)))
