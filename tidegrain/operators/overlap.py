"""Shares of buffers by polygon: over the cells of a lattice, and exactly.

Disks and polygons meet on square tiles (tiles.py).  The disks of a tile travel in packs of bounded size, so a tile with a third of all
disks is the work of many tasks; numpy measures a pack at once, and only sums by (episode, unit) are shuffled after that."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weighted import share_of_group
from ..shared import Scratch, small_side
from .places import by_place
from .tiles import runs, tile_pieces

#: Disks of a pack, about, and rectangles of one.
PACK, BOXES = 2048, 512
#: Metres around a polygon's box within which other polygons count as near.  Fixed value.
NEAR = 500.0


def _packs(points: DataFrame, radius: float, tile: float) -> DataFrame:
    """(tx, ty, ids, xs, ys): the disks that meet a tile, in packs."""
    span = lambda c: F.sequence(F.floor((F.col(c) - radius) / tile), F.floor((F.col(c) + radius) / tile))
    disks = points.select("episode_id", "x", "y").filter("x is not null and y is not null").withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    counts = disks.groupBy("tx", "ty").agg(F.ceil(F.count("*") / PACK).cast("long").alias("packs"))
    dealt = disks.join(small_side(counts), ["tx", "ty"]).withColumn("pack", F.pmod(F.xxhash64("episode_id", "x", "y"), F.col("packs")))
    packed = dealt.groupBy("tx", "ty", "pack").agg(F.collect_list(F.struct("episode_id", "x", "y")).alias("d"))
    return packed.select("tx", "ty", F.col("d.episode_id").alias("ids"), F.col("d.x").alias("xs"), F.col("d.y").alias("ys"))


def _strip(v: np.ndarray, r: float) -> np.ndarray:
    """Area of the disk at the origin left of v."""
    v = np.clip(v, -r, r)
    return r * r * (math.pi / 2 + np.arcsin(v / r)) + v * np.sqrt(np.maximum(0.0, r * r - v * v))


def _corner(x: np.ndarray, y: np.ndarray, r: float) -> np.ndarray:
    """Area of the disk at the origin left of x and below y."""
    sx, sy = _strip(x, r), _strip(y, r)
    out = x * x + y * y >= r * r
    far = np.where((x <= 0) & (y <= 0), 0.0, np.where((x >= 0) & (y >= 0), sx + sy - math.pi * r * r, np.where(x < 0, sx, sy)))
    return np.where(out, far, (sx + sy) / 2 - math.pi * r * r / 4 + x * y)


def cell_areas(x: np.ndarray, y: np.ndarray, r: float) -> np.ndarray:
    """Areas of disks at the origin in the cells between the lattice lines x and y of each disk: (disks, rows, columns)."""
    c = _corner(x[:, None, :], y[:, :, None], r)
    return c[:, 1:, 1:] - c[:, 1:, :-1] - c[:, :-1, 1:] + c[:, :-1, :-1]


def _inside_cells(corners: np.ndarray, x0: float, y0: float, step: float, per: int) -> np.ndarray:
    """Whether the centres of a tile's cells (row, column) are inside, by the edges that cross their row to the right of them."""
    e = corners.reshape(-1, 4)
    up = e[:, 1] < e[:, 3]
    ax, ay, bx, by = np.where(up, e[:, 0], e[:, 2]), np.where(up, e[:, 1], e[:, 3]), np.where(up, e[:, 2], e[:, 0]), np.where(up, e[:, 3], e[:, 1])
    y = y0 + (np.arange(per) + 0.5) * step
    edge, row = np.nonzero((ay[:, None] <= y) & (y < by[:, None]))
    at = ax[edge] + (y[row] - ay[edge]) * (bx[edge] - ax[edge]) / (by[edge] - ay[edge])
    left = np.clip(np.ceil((at - x0) / step - 0.5), 0, per).astype(np.int64)  # centres left of the crossing
    turns = np.zeros((per, per + 1), np.int64)
    np.add.at(turns, (row, left), 1)
    return np.cumsum(turns[:, ::-1], axis=1)[:, ::-1][:, 1:] % 2 == 1


def tile_owners(polygons: DataFrame, step: float, tile: float) -> DataFrame:
    """(tx, ty, units, owners): for each cell of a tile, row by row, the place in units of the polygon that holds its centre, the last in key
    order on a tie; -1: none.  Polygons come one by one, so a tile with many of them needs no more memory than one with few."""
    per = round(tile / step)
    if abs(per * step - tile) > 1e-9:
        raise ValueError("the tile must be a multiple of the step")
    kind = dict(polygons.dtypes)["unit"]

    def burn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, units, owners = None, [], np.zeros(0)

        def row() -> pd.DataFrame:
            left, places = np.unique(owners[owners >= 0], return_inverse=True)
            owners[owners >= 0] = places
            return pd.DataFrame({"tx": [at[0]], "ty": [at[1]], "units": [[units[k] for k in left]], "owners": [owners.astype("<i4").tobytes()]})

        for batch in batches:
            for unit, tx, ty, whole, corners in zip(batch.unit, batch.tx, batch.ty, batch.whole, batch.corners, strict=True):
                if at != (tx, ty):
                    if at is not None and (owners >= 0).any():
                        yield row()
                    at, units, owners = (tx, ty), [], np.full((per, per), -1, np.int64)
                owners[np.ones((per, per), bool) if whole else _inside_cells(np.asarray(corners, float), tx * tile, ty * tile, step, per)] = len(units)
                units.append(unit)
        if at is not None and (owners >= 0).any():
            yield row()

    pieces = tile_pieces(polygons, tile, "unit").drop("left").repartition("tx", "ty").sortWithinPartitions("tx", "ty", "unit")
    return pieces.mapInPandas(burn, f"tx long, ty long, units array<{kind}>, owners binary")


def overlap_weights(points: DataFrame, polygons: DataFrame, radius: float = 270.0, step: float = 25.0, tile: float = 1000.0) -> DataFrame:
    """(episode_id, unit, weight): shares of the buffer by polygon.  A cell belongs to the polygon that holds its centre, to
    the last in key order on a tie; cells in no polygon go before the shares are made.

    Cells are given to polygons once for each tile, whatever the number of disks; a pack of disks then adds up the parts of the cells."""
    return by_place(points, lambda places: _overlap_weights(places, polygons, radius, step, tile))


def _overlap_weights(points: DataFrame, polygons: DataFrame, radius: float, step: float, tile: float) -> DataFrame:
    per, wide = round(tile / step), math.ceil(2 * radius / step) + 1
    kinds = dict(points.dtypes)["episode_id"], dict(polygons.dtypes)["unit"]
    offset = np.arange(wide + 1)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, of, areas = [], [], []
            for tx, ty, ids, xs, ys, units, owners in batch[["tx", "ty", "ids", "xs", "ys", "units", "owners"]].itertuples(index=False):
                owner, n = np.frombuffer(owners, "<i4").reshape(per, per), len(units)
                for a in range(0, len(ids), 256):
                    x, y = np.asarray(xs[a : a + 256], float), np.asarray(ys[a : a + 256], float)
                    i0, j0 = np.floor((x - radius) / step).astype(np.int64), np.floor((y - radius) / step).astype(np.int64)
                    i, j = i0[:, None] + offset - tx * per, j0[:, None] + offset - ty * per
                    ex, ey = (i0[:, None] + offset) * step - x[:, None], (j0[:, None] + offset) * step - y[:, None]
                    area = cell_areas(ex, ey, radius)
                    i, j = i[:, :-1], j[:, :-1]
                    held = ((i >= 0) & (i < per))[:, None, :] & ((j >= 0) & (j < per))[:, :, None] & (area > 1e-9)
                    whose = owner[np.clip(j, 0, per - 1)[:, :, None], np.clip(i, 0, per - 1)[:, None, :]]
                    held &= whose >= 0
                    sums = np.bincount((np.arange(len(x))[:, None, None] * n + whose)[held], weights=area[held], minlength=len(x) * n)
                    found = np.flatnonzero(sums)
                    rows += [ids[a + k] for k in (found // n).tolist()]
                    of += [units[k] for k in (found % n).tolist()]
                    areas.append(sums[found])
            yield pd.DataFrame({"episode_id": rows, "unit": of, "area": np.concatenate(areas) if areas else np.zeros(0)})

    met = _packs(points, radius, tile).join(tile_owners(polygons, step, tile), ["tx", "ty"])
    out = met.mapInPandas(measure, f"episode_id {kinds[0]}, unit {kinds[1]}, area double").groupBy("episode_id", "unit").agg(F.sum("area").alias("area"))
    return out.withColumn("weight", share_of_group("area", "episode_id")).drop("area")


def _signs(e: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each piece of a polygon in a tile: 1 if the polygon lies to its left at its middle, -1 if to its right."""
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    y = (low + high) / 2
    x = (e[:, 0] + e[:, 2]) / 2
    pairs, own = left.reshape(-1, 2), np.arange(len(e))
    odd = ((pairs[:, 0] <= y[:, None]) & (y[:, None] < pairs[:, 1])).sum(axis=1)
    for a in range(0, len(e), 256):
        k = own[a : a + 256]
        at = e[:, 0] + (y[k, None] - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])  # of each edge at the height of each middle
        odd[k] += ((low <= y[k, None]) & (y[k, None] < high) & (at < x[k, None]) & (own != k[:, None])).sum(axis=1)
    return np.where(odd % 2 == 1, 1.0, -1.0)


def _left_of(x: np.ndarray, y: np.ndarray, e: np.ndarray, r: float) -> np.ndarray:
    """Area of each disk (x, y) to the left of each edge, between the edge's heights: chords where the edge lies in the disk, arcs
    where it has passed it.  (disks, edges)."""
    up = e[:, 1] < e[:, 3]
    ax, ay = np.where(up, e[:, 0], e[:, 2]) - x[:, None], np.where(up, e[:, 1], e[:, 3]) - y[:, None]
    by = np.where(up, e[:, 3], e[:, 1]) - y[:, None]
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    low, high = np.clip(ay, -r, r), np.clip(by, -r, r)
    # where the edge's line meets the circle: x = ax + (y - ay) * slope
    k = ax - ay * slope
    half = np.sqrt(np.maximum(0.0, (1 + slope**2) * r * r - k * k)) / (1 + slope**2)
    middle = -k * slope / (1 + slope**2)
    breaks = [low, np.clip(middle - half, low, high), np.clip(middle + half, low, high), high]
    arcs = [(v * np.sqrt(np.maximum(0.0, r * r - v * v)) + r * r * np.arcsin(v / r)) / 2 for v in breaks]
    total = np.zeros_like(low)
    for a, b, arc_a, arc_b in zip(breaks, breaks[1:], arcs, arcs[1:]):
        m = (a + b) / 2
        reach, edge = np.sqrt(np.maximum(0.0, r * r - m * m)), k + m * slope
        arc = arc_b - arc_a
        total += np.where(edge >= reach, 2 * arc, np.where(edge <= -reach, 0.0, arc + (k + m * slope) * (b - a)))
    return total


def _centre(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and half sides from lower to upper ends.  Half sides are taken to the micrometre, so that boxes exactly as far apart as a bound
    are told by their distance and not by how their ends were rounded."""
    half = np.round((b - a) / 2, 6)
    return a + half, half


def _boxed(polygons: DataFrame) -> DataFrame:
    """(unit, rings, box, hole): box is (x0, x1, y0, y1) where the polygon is a rectangle along the axes, hole that of a rectangle cut out of
    it; any other polygon has no box."""
    even = lambda r: (r[0]["x"] == r[3]["x"]) & (r[1]["x"] == r[2]["x"]) & (r[0]["y"] == r[1]["y"]) & (r[2]["y"] == r[3]["y"])
    odd = lambda r: (r[0]["y"] == r[3]["y"]) & (r[1]["y"] == r[2]["y"]) & (r[0]["x"] == r[1]["x"]) & (r[2]["x"] == r[3]["x"])
    plain = lambda r: F.when(F.size(r) == 4, even(r) | odd(r)).otherwise(False)
    span = lambda r: F.struct(*[f(r[0][c], r[2][c]).alias(n) for n, f, c in (("x0", F.least, "x"), ("x1", F.greatest, "x"), ("y0", F.least, "y"), ("y1", F.greatest, "y"))])
    a, b = F.get("rings", 0), F.get("rings", 1)
    out = polygons.select("unit", "rings", F.when(F.size("rings").between(1, 2) & F.forall("rings", plain), span(a)).alias("box"))
    out = out.withColumn("hole", F.when(F.col("box").isNotNull() & (F.size("rings") == 2), span(b)))
    held = F.expr("hole.x0 >= box.x0 and hole.x1 <= box.x1 and hole.y0 >= box.y0 and hole.y1 <= box.y1")
    return out.withColumn("box", F.when(F.col("hole").isNull() | held, F.col("box")))


def _box_areas(points: DataFrame, boxed: DataFrame, radius: float, tile: float) -> DataFrame:
    """(episode_id, unit, area) of rectangles, from their corners: a disk is filed to the tile of its centre, a rectangle to all tiles from which a
    disk can reach it, so the two meet once."""
    kinds = dict(points.dtypes)["episode_id"], dict(boxed.dtypes)["unit"]
    names = [f"{a}{b}" for a in ("box_", "hole_") for b in ("x0", "x1", "y0", "y1")]
    flat = boxed.distinct().select("unit", *[F.col(f"{a}.{b}").alias(f"{a}_{b}") for a in ("box", "hole") for b in ("x0", "x1", "y0", "y1")])
    reach = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - radius) / tile), F.floor((F.col(b) + radius) / tile)))
    filed = flat.withColumn("tx", reach("box_x0", "box_x1")).withColumn("ty", reach("box_y0", "box_y1"))
    disks = points.select("episode_id", "x", "y").filter("x is not null and y is not null").withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    filed = filed.join(disks.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")

    def packed(df: DataFrame, columns: list[str], size: int, name: str) -> DataFrame:
        counts = df.groupBy("tx", "ty").agg(F.ceil(F.count("*") / size).cast("long").alias("packs"))
        dealt = df.join(small_side(counts), ["tx", "ty"]).withColumn(name, F.pmod(F.xxhash64(*columns), F.col("packs")))
        rows = dealt.groupBy("tx", "ty", name).agg(F.collect_list(F.struct(*columns)).alias("d"))
        return rows.select("tx", "ty", *[F.col(f"d.{c}").alias(f"{c}s") for c in columns])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ids, xs, ys, units, *ends in batch[["episode_ids", "xs", "ys", "units", *[f"{n}s" for n in names]]].itertuples(index=False):
                sides = [np.asarray(e, float) for e in ends]
                (cx, hx), (cy, hy) = _centre(*sides[:2]), _centre(*sides[2:4])
                for a in range(0, len(ids), 64):
                    x, y = np.asarray(xs[a : a + 64], float)[:, None], np.asarray(ys[a : a + 64], float)[:, None]
                    near = (np.abs(cx - x) < hx + radius) & (np.abs(cy - y) < hy + radius)
                    row, col = np.nonzero(near)
                    area = np.zeros(len(row))
                    for sign, (x0, x1, y0, y1) in ((1.0, sides[:4]), (-1.0, sides[4:])):
                        some = np.flatnonzero(~np.isnan(x0[col]))
                        px, py, c = x[row[some], 0], y[row[some], 0], col[some]
                        west, east, south, north = x0[c] - px, x1[c] - px, y0[c] - py, y1[c] - py
                        area[some] += sign * (_corner(east, north, radius) - _corner(west, north, radius) - _corner(east, south, radius) + _corner(west, south, radius))
                    found = np.flatnonzero(area > 1e-6)
                    yield pd.DataFrame({"episode_id": np.asarray(ids[a : a + 64])[row[found]], "unit": np.asarray(units)[col[found]], "area": area[found]})

    met = packed(disks, ["episode_id", "x", "y"], PACK, "pack").join(packed(filed, ["unit", *names], BOXES, "part"), ["tx", "ty"])
    return met.mapInPandas(measure, f"episode_id {kinds[0]}, unit {kinds[1]}, area double")


def overlap_areas(points: DataFrame, polygons: DataFrame, radius: float = 270.0, tile: float = 1000.0) -> DataFrame:
    """(episode_id, unit, area): exact areas of the disks inside the polygons; pairs that do not meet have no row.  Rectangles along the
    axes are measured from their corners, other polygons tile by tile."""
    return _overlap_areas(points, _known(polygons), radius, tile)


def _known(polygons: DataFrame) -> DataFrame:
    """Polygons as a written table: rings that are made by a formula would be made anew for each number that is read from them."""
    return Scratch(polygons.sparkSession, "polygons").written(polygons.select("unit", "rings"), "polygons")


def _overlap_areas(points: DataFrame, polygons: DataFrame, radius: float, tile: float) -> DataFrame:
    boxed = _boxed(polygons)
    plain, others = boxed.filter("box is not null"), boxed.filter("box is null").select("unit", "rings")
    parts = []
    if not plain.isEmpty():
        parts.append(_box_areas(points, plain, radius, tile))
    if not parts or not others.isEmpty():
        parts.append(_shape_areas(points, others, radius, tile))
    out = reduce(DataFrame.unionByName, parts)
    return out.repartition("episode_id").groupBy("episode_id", "unit").agg(F.sum("area").alias("area")).filter("area > 1e-6")


def _shape_areas(points: DataFrame, polygons: DataFrame, radius: float, tile: float) -> DataFrame:
    kinds = dict(points.dtypes)["episode_id"], dict(polygons.dtypes)["unit"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, of, areas = [], [], []
            for tx, ty, ids, xs, ys, unit, whole, corners, left in batch[["tx", "ty", "ids", "xs", "ys", "unit", "whole", "corners", "left"]].itertuples(index=False):
                x, y = np.asarray(xs, float), np.asarray(ys, float)
                if whole:
                    x0, x1, y0, y1 = tx * tile - x, (tx + 1) * tile - x, ty * tile - y, (ty + 1) * tile - y
                    area = _corner(x1, y1, radius) - _corner(x0, y1, radius) - _corner(x1, y0, radius) + _corner(x0, y0, radius)
                else:
                    e, border = np.asarray(corners, float).reshape(-1, 4), np.asarray(left, float)
                    s = _signs(e, border)
                    at = np.full(len(border) // 2, tx * tile)
                    e = np.concatenate([e, np.stack([at, border[::2], at, border[1::2]], 1)])
                    s = np.concatenate([s, -np.ones(len(at))])
                    area = np.zeros(len(x))
                    for a in range(0, len(e), 512):
                        area += _left_of(x, y, e[a : a + 512], radius) @ s[a : a + 512]
                found = np.flatnonzero(np.abs(area) > 1e-9)  # a tile's part; the whole is judged in the end
                rows += [ids[k] for k in found.tolist()]
                of += [unit] * len(found)
                areas.append(area[found])
            yield pd.DataFrame({"episode_id": rows, "unit": of, "area": np.concatenate(areas) if areas else np.zeros(0)})

    met = _packs(points, radius, tile).join(tile_pieces(polygons, tile, "unit"), ["tx", "ty"])
    return met.mapInPandas(measure, f"episode_id {kinds[0]}, unit {kinds[1]}, area double")


def overlap_shares(points: DataFrame, polygons: DataFrame, radius: float = 270.0, tile: float = 1000.0, near: float = NEAR) -> DataFrame:
    """(episode_id, unit, weight): the buffer's exact area in a polygon over its area in all polygons whose boxes meet that polygon's box
    widened by `near`.  Not normalised: a buffer's values add up to 1 only if all its polygons are near one another.

    Polygons are taken to be a coverage; where some overlap, each counts with its own area.  The areas of a place meet in one row, as
    many as polygons that its buffer touches."""
    return by_place(points, lambda places: _overlap_shares(places, polygons, radius, tile, near))


def _overlap_shares(points: DataFrame, polygons: DataFrame, radius: float, tile: float, near: float) -> DataFrame:
    polygons = _known(polygons)
    ends = lambda f, c: f(F.transform(F.flatten("rings"), lambda v: v[c]))
    boxes = polygons.select("unit", *[ends(f, c).alias(n) for n, f, c in (("x0", F.array_min, "x"), ("x1", F.array_max, "x"), ("y0", F.array_min, "y"), ("y1", F.array_max, "y"))])
    boxes = boxes.groupBy("unit").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    kinds = dict(points.dtypes)["episode_id"], dict(polygons.dtypes)["unit"]

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, units, *columns in batch.itertuples(index=False):
                area, x0, x1, y0, y1 = (np.asarray(c, float) for c in columns)
                (cx, hx), (cy, hy) = _centre(x0, x1), _centre(y0, y1)
                weight = np.empty(len(area))
                for a in range(0, len(area), 256):
                    b = slice(a, a + 256)
                    close = (np.abs(cx[b, None] - cx) <= hx[b, None] + hx + near) & (np.abs(cy[b, None] - cy) <= hy[b, None] + hy + near)
                    weight[b] = area[b] / (close @ area)
                yield pd.DataFrame({"episode_id": key, "unit": units, "weight": weight})

    held = _overlap_areas(points, polygons, radius, tile).join(small_side(boxes), "unit")
    columns = ("unit", "area", "x0", "x1", "y0", "y1")
    row = held.groupBy("episode_id").agg(F.collect_list(F.struct(*columns)).alias("d")).select("episode_id", *[F.col(f"d.{c}").alias(c) for c in columns])
    return row.mapInPandas(share, f"episode_id {kinds[0]}, unit {kinds[1]}, weight double")
