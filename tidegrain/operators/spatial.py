"""Projection, buffer weights and nearest features as equi-joins on grid cells.

A disk is (x, y) and a radius in metres; polygons are (unit, rings) with rings an array of rings, a ring an array of
struct<x, y> whose first vertex is not repeated; holes and further parts are rings like any other, as a point is inside if it is in
an odd number of them.  Lines are segments (x1, y1, x2, y2).  Nothing here is a cross join: candidates always meet on the cell of
a lattice that does not depend on the data, so an episode's result does not depend on the rest of the cohort."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weighted import share_of_group
from ..shared import Scratch, partitions, small_side, written
from .overlap import cell_areas, overlap_areas, overlap_shares, overlap_weights  # noqa: F401
from .places import by_place
from .tiles import edges_of, inside, odd_crossings, tiled  # noqa: F401

#: Ellipsoids: semi-major axis in m, flattening.  Fixed values.
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)
#: Standard parallels, origin and central meridian of the projection of the contiguous states.  Fixed values.
CONUS_ALBERS = (29.5, 45.5, 37.5, -96.0)
#: Groups of features that nearest() reports one by one; more are refused.
GROUPS = 10_000
#: Points of a leaf of nearest(), points times features of one, and features of a chunk.
POINTS, WORK, FEATURES = 512, 4_000_000, 512


def _cone(lat_1: float, lat_2: float, lat_0: float, ellipsoid: tuple[float, float]) -> tuple[float, float, float, float, float]:
    """(a, e, n, c, rho0) of the projection."""
    a, f = ellipsoid
    e = math.sqrt(f * (2 - f))
    sines = [math.sin(math.radians(p)) for p in (lat_1, lat_2, lat_0)]
    m1, m2 = (math.cos(math.radians(p)) / math.sqrt(1 - (e * s) ** 2) for p, s in zip((lat_1, lat_2), sines, strict=False))
    q = [_authalic(s, e, math.log) for s in sines]
    n = (m1**2 - m2**2) / (q[1] - q[0])
    c = m1**2 + n * q[0]
    return a, e, n, c, a * math.sqrt(c - n * q[2]) / n


def _authalic(s, e: float, log):
    """q of Snyder's equal-area formulas, from the sine of the latitude."""
    e2 = e * e
    return (1 - e2) * (s / (1 - e2 * s * s) - log((1 - e * s) / (1 + e * s)) / (2 * e))


def albers(lon: Column, lat: Column, lat_1: float = 29.5, lat_2: float = 45.5, lat_0: float = 37.5, lon_0: float = -96.0, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """Forward ellipsoidal equal-area conic projection (Snyder 1987, p. 101)."""
    a, e, n, c, rho0 = _cone(lat_1, lat_2, lat_0, ellipsoid)
    rho = F.lit(a / n) * F.sqrt(F.lit(c) - n * _authalic(F.sin(F.radians(lat)), e, F.log))
    theta = n * F.radians(lon - lon_0)
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def albers_inverse(x: np.ndarray, y: np.ndarray, lat_1: float = 29.5, lat_2: float = 45.5, lat_0: float = 37.5, lon_0: float = -96.0, ellipsoid: tuple[float, float] = WGS84) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat) in degrees of projected points, in numpy: the latitude by Newton steps on q (Snyder 1987, p. 102)."""
    a, e, n, c, rho0 = _cone(lat_1, lat_2, lat_0, ellipsoid)
    theta = np.arctan2(math.copysign(1, n) * x, math.copysign(1, n) * (rho0 - y))
    q = (c - (np.hypot(x, rho0 - y) * n / a) ** 2) / n
    lat = np.arcsin(np.clip(q / 2, -1, 1))
    for _ in range(6):
        s = np.sin(lat)
        lat = lat + (1 - (e * s) ** 2) ** 2 / (2 * np.cos(lat)) * (q - _authalic(s, e, np.log)) / (1 - e * e)
    return lon_0 + np.degrees(theta / n), np.degrees(lat)


def buffer_ring(x: Column, y: Column, radius: float, vertices: int = 400) -> Column:
    """The polygon that stands for a disk: an array of struct<x, y>, counter-clockwise from the east."""
    angle = lambda k: k * F.lit(2 * math.pi / vertices)
    return F.transform(F.sequence(F.lit(0), F.lit(vertices - 1)), lambda k: F.struct((x + radius * F.cos(angle(k))).alias("x"), (y + radius * F.sin(angle(k))).alias("y")))


def disk_share(x0: Column, x1: Column, y0: Column, y1: Column, r: float) -> Column:
    """Exact area of the disk of radius r at the origin inside a rectangle."""

    def strip(v: Column) -> Column:  # area left of v
        v = F.greatest(F.lit(-r), F.least(F.lit(r), v))
        return r * r * (math.pi / 2 + F.asin(v / r)) + v * F.sqrt(F.greatest(F.lit(0.0), r * r - v * v))

    def corner(x: Column, y: Column) -> Column:  # area left of x and below y
        out = x * x + y * y >= r * r
        return (
            F.when(out & (x <= 0) & (y <= 0), 0.0)
            .when(out & (x >= 0) & (y >= 0), strip(x) + strip(y) - math.pi * r * r)
            .when(out & (x < 0), strip(x))
            .when(out, strip(y))
            .otherwise((strip(x) + strip(y)) / 2 - math.pi * r * r / 4 + x * y)
        )

    return corner(x1, y1) - corner(x0, y1) - corner(x1, y0) + corner(x0, y0)


def disk_cells(points: DataFrame, radius: float, step: float) -> DataFrame:
    """The columns of points and (i, j, area) of every lattice cell of side step that the disk at (x, y) covers in part."""
    span = lambda c: F.sequence(F.floor((F.col(c) - radius) / step), F.floor((F.col(c) + radius) / step))
    out = points.withColumn("i", F.explode(span("x"))).withColumn("j", F.explode(span("y")))
    edge = lambda k, c, more: (F.col(k) + more) * step - F.col(c)
    return out.withColumn("area", disk_share(edge("i", "x", 0), edge("i", "x", 1), edge("j", "y", 0), edge("j", "y", 1), radius)).filter("area > 1e-9")


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str = "episode_id", tile: float = 1000.0) -> DataFrame:
    """(key, unit): every point with the polygon that holds it, the first in key order on a tie, missing if none does."""
    at = points.select(key, "x", "y", F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"))
    held = at.join(tiled(polygons, tile, "unit"), ["tx", "ty"]).filter(F.col("whole") | odd_crossings(F.col("x"), F.col("y"), F.col("edges")))
    return points.select(key).distinct().join(held.groupBy(key).agg(F.min("unit").alias("unit")), key, "left")


def grid_weights(points: DataFrame, x0: float, y0: float, cell: float, width: int, height: int, radius: float = 270.0, offset: int = 0) -> DataFrame:
    """(episode_id, unit, weight): shares of the buffer by raster cell, row-major from the top left corner (x0, y0).  All cells of a
    buffer are measured beside its row, each corner of the lattice once."""
    span = np.arange(math.ceil(2 * radius / cell) + 2)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.iloc[a : a + 2048]
                x, y = part.x.to_numpy(float), part.y.to_numpy(float)
                i, j = (np.floor((v - radius) / cell).astype(np.int64)[:, None] + span for v in (x, y))
                area = cell_areas(i * cell - x[:, None], j * cell - y[:, None], radius)
                i, j = i[:, :-1], j[:, :-1]
                held = ((i >= 0) & (i < width))[:, None, :] & ((j >= 0) & (j < height))[:, :, None] & (area > 1e-9)
                area = np.where(held, area, 0.0)
                share = area / np.maximum(area.sum(axis=(1, 2), keepdims=True), 1e-300)
                row, b, a_ = np.nonzero(held)
                yield pd.DataFrame({"episode_id": part.episode_id.to_numpy()[row], "unit": j[row, b] * width + i[row, a_] + offset, "weight": share[held]})

    moved = points.select("episode_id", (F.col("x") - x0).alias("x"), (y0 - F.col("y")).alias("y")).filter("x is not null and y is not null")
    kind = dict(points.dtypes)["episode_id"]
    dealt = moved.repartition(partitions(points.sparkSession), "episode_id").dropDuplicates(["episode_id", "x", "y"])  # a repeated row is one buffer
    return dealt.mapInPandas(measure, f"episode_id {kind}, unit long, weight double")


def _clipped(x: np.ndarray, y: np.ndarray, at: float, keep_above: bool) -> tuple[np.ndarray, np.ndarray]:
    """The polygon cut at x = at."""
    kept = x >= at if keep_above else x <= at
    if kept.all():
        return x, y
    nx, ny, nk = np.roll(x, -1), np.roll(y, -1), np.roll(kept, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = y + (at - x) * (ny - y) / (nx - x)
    xs = np.stack([x, np.full_like(x, at)], 1)[np.stack([kept, kept != nk], 1)]
    ys = np.stack([y, cut], 1)[np.stack([kept, kept != nk], 1)]
    return xs, ys


def _area(x: np.ndarray, y: np.ndarray) -> float:
    return abs(float(np.dot(x - x[0], np.roll(y, -1) - y[0]) - np.dot(np.roll(x, -1) - x[0], y - y[0]))) / 2 if len(x) > 2 else 0.0


def degree_grid_weights(points: DataFrame, lon0: float, lat0: float, cell: float, width: int, height: int, radius: float = 270.0, offset: int = 0, valid: DataFrame | None = None, vertices: int = 400, forward: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """(episode_id, unit, weight) over a grid in degrees, row-major from the top left corner (lon0, lat0): the buffer's polygon is
    taken to degrees and clipped to each cell that it meets.  valid(unit): cells with data; others go before the shares are made.
    forward: from degrees to the grid's own coordinates, in which the corner and the cell are then given.

    points(episode_id, lon, lat).  A buffer in one cell, which most are, needs no clipping."""
    x, y = albers(F.col("lon"), F.col("lat"))
    placed = points.select("episode_id", x.alias("x"), y.alias("y")).filter("x is not null and y is not null")
    turn = 2 * np.pi * np.arange(vertices) / vertices

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, (px, py) in enumerate(zip(batch.x, batch.y, strict=True)):
                lon, lat = albers_inverse(px + radius * np.cos(turn), py + radius * np.sin(turn))
                gx, gy = forward(lon, lat) if forward else (lon, lat)
                u, v = (gx - lon0) / cell, (lat0 - gy) / cell
                for i in range(int(np.floor(u.min())), int(np.floor(u.max())) + 1):
                    cu, cv = _clipped(*_clipped(u, v, i, True), i + 1, False)
                    for j in range(int(np.floor(cv.min())), int(np.floor(cv.max())) + 1) if len(cv) else ():
                        dv, du = _clipped(*_clipped(cv, cu, j, True), j + 1, False)
                        if 0 <= i < width and 0 <= j < height and (area := _area(du, dv)) > 0:
                            out.append((k, j * width + i + offset, area))
            made = pd.DataFrame(out, columns=["row", "unit", "area"]).astype({"row": "int64", "unit": "int64", "area": "float64"})
            yield made.assign(episode_id=batch.episode_id.to_numpy()[made.pop("row").to_numpy()])

    kind = dict(points.dtypes)["episode_id"]
    out = placed.mapInPandas(cells, f"unit long, area double, episode_id {kind}")
    if valid is not None:
        out = out.join(valid.select("unit").distinct(), "unit", "left_semi")
    return out.select("episode_id", "unit", share_of_group("area", "episode_id").alias("weight"))


def same_grid(a: dict[str, float], b: dict[str, float], tolerance: float = 1e-9) -> bool:
    """Two grids (x0, y0, cell, width, height) are one."""
    return a["width"] == b["width"] and a["height"] == b["height"] and all(abs(a[k] - b[k]) <= tolerance for k in ("x0", "y0", "cell"))


def wrong_weight_sums(weights: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(episode_id, total) of the episodes whose weights do not add up to 1."""
    return weights.groupBy("episode_id").agg(F.sum("weight").alias("total")).filter(F.abs(F.col("total") - 1) >= tolerance)


def segment_distance(x: Column, y: Column) -> Column:
    """From (x, y) to the segment (x1, y1, x2, y2); a point is a segment of length 0."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    size = dx * dx + dy * dy
    t = F.when(size == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / F.nullif(size, F.lit(0.0)))))
    return F.sqrt(F.pow(F.col("x1") + t * dx - x, 2) + F.pow(F.col("y1") + t * dy - y, 2))


def segments_of(polygons: DataFrame, *keep: str) -> DataFrame:
    """The edges of polygons as segments."""
    out = polygons.select(*keep, F.explode(edges_of(F.col("rings"))).alias("e"))
    return out.select(*keep, F.col("e.ax").alias("x1"), F.col("e.ay").alias("y1"), F.col("e.bx").alias("x2"), F.col("e.by").alias("y2"))


def _filed(segments: DataFrame, side: float | Column) -> DataFrame:
    """Segments with the lattice cells (gx, gy) that they pass, column by column along the line."""
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    out = segments.withColumn("gx", F.explode(F.sequence(F.floor(low / side), F.floor(high / side))))
    slope = F.coalesce((F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)), F.lit(0.0))
    at = lambda x: F.col("y1") + (x - F.col("x1")) * slope
    steep = F.col("x1") == F.col("x2")
    a = F.when(steep, F.col("y1")).otherwise(at(F.greatest(low, F.col("gx") * side)))
    b = F.when(steep, F.col("y2")).otherwise(at(F.least(high, (F.col("gx") + 1) * side)))
    hair = side * 1e-9  # rounding may put a crossing on the other side of a cell's edge
    return out.withColumn("gy", F.explode(F.sequence(F.floor((F.least(a, b) - hair) / side), F.floor((F.greatest(a, b) + hair) / side))))


def _leaves(at: DataFrame, known: DataFrame, sides: list[float], growth: int, scratch: Scratch) -> DataFrame:
    """at with (level, lx, ly, packs): the leaf of each point in a tree of cells that is made from the counts of points and features, the
    largest cell with few enough of both; and into how many packs the leaf's points go, as its smallest cells can hold any number."""
    fine = lambda x, y: [F.floor(F.col(x) / sides[0]).alias("ix"), F.floor(F.col(y) / sides[0]).alias("iy")]
    mine = scratch.written(at.groupBy(*fine("x", "y")).agg(F.count("*").alias("np")), "cells")
    theirs = known.groupBy(*fine("x1", "y1")).agg(F.count("*").alias("nf"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(float(growth**k)).alias("width")) for k in range(len(sides))])).alias("l")
    up = lambda df: df.select("*", levels).select("*", "l.level", F.floor(F.col("ix") / F.col("l.width")).alias("lx"), F.floor(F.col("iy") / F.col("l.width")).alias("ly")).drop("l")
    counts = up(mine.withColumn("nf", F.lit(0).cast("long")).unionByName(theirs.withColumn("np", F.lit(0).cast("long")))).groupBy("level", "lx", "ly").agg(F.sum("np").alias("np"), F.sum("nf").alias("nf"))
    fit = counts.filter((F.col("np") > 0) & ((F.col("level") == 0) | (F.col("np") <= POINTS) & (F.col("np") * F.col("nf") <= WORK)))
    best = up(mine.drop("np")).join(fit, ["level", "lx", "ly"]).groupBy("ix", "iy").agg(F.max(F.struct("level", "lx", "ly", F.ceil(F.col("np") / POINTS).cast("long").alias("packs"))).alias("b"))
    best = scratch.written(best.select("ix", "iy", "b.*"), "leaves")
    return at.withColumns(dict(zip(("ix", "iy"), fine("x", "y"), strict=True))).join(small_side(best), ["ix", "iy"]).drop("ix", "iy")


def _measured(by_point: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ids, xs, ys, gs, *ends in batch[["ids", "xs", "ys", "gs", "x1", "y1", "x2", "y2"]].itertuples(index=False):
                order = np.argsort(gs, kind="stable")
                g, (x1, y1, x2, y2) = np.asarray(gs)[order], (np.asarray(e, float)[order] for e in ends)
                first = np.flatnonzero(np.diff(g, prepend=-1))
                dx, dy = x2 - x1, y2 - y1
                size = dx * dx + dy * dy
                for a in range(0, len(ids), 256):
                    x, y = np.asarray(xs[a : a + 256], float)[:, None], np.asarray(ys[a : a + 256], float)[:, None]
                    t = np.clip(((x - x1) * dx + (y - y1) * dy) / np.where(size == 0, 1.0, size), 0.0, 1.0)
                    far = np.minimum.reduceat((x1 + t * dx - x) ** 2 + (y1 + t * dy - y) ** 2, first, axis=1)
                    out.append(pd.DataFrame({by_point: np.repeat(np.asarray(ids[a : a + 256]), len(first)), "g": np.tile(g[first], len(x)), "distance": np.sqrt(far).ravel()}))
            yield pd.concat(out) if out else pd.DataFrame({by_point: [], "g": [], "distance": []})

    return measure


def nearest(points: DataFrame, segments: DataFrame, key: str = "episode_id", cell: float = 1000.0, growth: int = 4, by: list[str] | None = None) -> DataFrame:
    """(key, *by, distance): exact distance to the nearest segment, of each group of `by`; a row for every point and group, missing
    where the point has no place or the group no features.

    Points that are close together search together.  They are the leaves of a tree of cells (sides cell / growth * growth^k) that is cut where
    points, or points times features, are many.  A leaf's centre is at most u from some feature of a group, told by one feature for each
    occupied cell of each level around it; with h, the leaf's half diagonal, the nearest feature of any of its points is within u + 2h
    of the centre.  These candidates are found on cells as large as that distance, and go to numpy with the leaf's points, in packs of both:
    a cell with a third of all features or points is the work of many tasks, and nothing is copied by group before the last step.
    Points of one place search once, and so do features that are equal in place and group."""
    return by_place(points, lambda places: _nearest(places, segments, key, cell, growth, by or []), key)


def _nearest(points: DataFrame, segments: DataFrame, key: str, cell: float, growth: int, by: list[str]) -> DataFrame:
    spark = points.sparkSession
    known = segments.select(*by, "x1", "y1", "x2", "y2").filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null").distinct()
    kinds = dict(segments.dtypes)
    listed = F.lit(0).alias("g")
    groups = [r.asDict() for r in known.select(*by).distinct().limit(GROUPS + 1).collect()] if by else [{}]  # metadata, refused beyond the bound
    if len(groups) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups of features")
    everyone = points.select(key).distinct()
    if by:
        if not groups:
            return everyone.select(key, *[F.lit(None).cast(kinds[c]).alias(c) for c in by], F.lit(None).cast("double").alias("distance"))
        rows = [F.struct(*[F.lit(g[c]).cast(kinds[c]).alias(c) for c in by], F.lit(k).alias("g")) for k, g in enumerate(groups)]
        names = spark.range(1).select(F.explode(F.array(*rows)).alias("n")).select(F.col("n.g").alias("g"), *[F.col(f"n.{c}").alias(f"__{c}") for c in by])
        same = F.lit(True)
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
        known = known.join(F.broadcast(names), same)  # at most GROUPS rows
        everyone = everyone.select(key, F.explode(F.array(*rows)).alias("__g")).select(key, "__g.*")
    else:
        known, everyone = known.withColumn("g", listed), everyone.withColumn("g", listed)
    scratch = Scratch(spark, "nearest")
    # projected once, not again in each step below
    known = scratch.written(known.select("g", "x1", "y1", "x2", "y2"), "known")
    at = scratch.written(points.select(key, "x", "y").filter("x is not null and y is not null"), "at")
    ends = known.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    own = at.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if ends[0] is None or own[0] is None:
        scratch.drop()
        return everyone.drop("g").withColumn("distance", F.lit(None).cast("double"))
    reach = max([1.0] + [max(ends[k + 1], own[k + 1]) - min(ends[k], own[k]) for k in (0, 2)]) * 1.01
    sides = [cell / growth]
    while sides[-1] < reach:
        sides.append(sides[-1] * growth)
    leaf = ["level", "lx", "ly"]

    placed = scratch.written(_leaves(at, known, sides, growth, scratch), "placed")
    packs = placed.groupBy(*leaf, F.pmod(F.xxhash64(key, "x", "y"), F.col("packs")).alias("pack")).agg(F.collect_list(F.struct(key, "x", "y")).alias("p"))
    packs = packs.select(*leaf, F.col(f"p.{key}").alias("ids"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
    box = placed.groupBy(*leaf).agg(*[f(c).alias(n) for n, f, c in (("a", F.min, "x"), ("b", F.max, "x"), ("c", F.min, "y"), ("d", F.max, "y"))])
    centres = scratch.written(box.select(*leaf, ((F.col("a") + F.col("b")) / 2).alias("x"), ((F.col("c") + F.col("d")) / 2).alias("y"), (F.hypot(F.col("b") - F.col("a"), F.col("d") - F.col("c")) / 2).alias("h")), "centres")

    # one feature of each group in each occupied cell of each level: some feature is within u
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("side")) for k, s in enumerate(sides)])).alias("s")
    cells = lambda df, x, y, *more: df.select(*more, level, x.alias("__x"), y.alias("__y")).select(*more, "s.k", F.floor(F.col("__x") / F.col("s.side")).alias("gx"), F.floor(F.col("__y") / F.col("s.side")).alias("gy"))
    some = cells(known, F.col("x1"), F.col("y1"), "g", "x1", "y1").groupBy("k", "gx", "gy", "g").agg(F.min(F.struct("x1", "y1")).alias("f"))
    ring = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)).alias(c)
    around = cells(centres, F.col("x"), F.col("y"), *leaf, "x", "y").select(*leaf, "x", "y", "k", ring("gx"), "gy").select(*leaf, "x", "y", "k", "gx", ring("gy"))
    bound = around.join(some, ["k", "gx", "gy"]).groupBy(*leaf, "g").agg(F.min(F.hypot(F.col("x") - F.col("f.x1"), F.col("y") - F.col("f.y1"))).alias("u"))
    asks = centres.join(bound, leaf).withColumn("r", (F.col("u") + 2 * F.col("h")) * (1 + 1e-9) + 1e-6)
    asks = scratch.written(asks.withColumn("k", F.greatest(F.lit(0), F.floor(F.log2("r"))).cast("int")).select(*leaf, "g", "x", "y", "r", "k"), "asks")

    # every feature within r of a leaf's centre, on cells of side 2^k <= r
    used = sorted(r[0] for r in asks.select("k").distinct().collect())  # as many as there are orders of distance
    side = F.pow(F.lit(2.0), F.col("k"))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("r")) / side), F.floor((F.col(c) + F.col("r")) / side)))
    wanted = asks.withColumn("gx", span("x")).withColumn("gy", span("y"))
    filed = _filed(known.withColumn("k", F.explode(F.array(*map(F.lit, used)))), side)
    met = wanted.join(filed, ["g", "k", "gx", "gy"]).filter(segment_distance(F.col("x"), F.col("y")) <= F.col("r"))
    met = scratch.written(met.select(*leaf, "g", "x1", "y1", "x2", "y2"), "met")
    many = met.groupBy(*leaf).agg(F.ceil(F.count("*") / FEATURES).cast("long").alias("parts"))
    dealt = met.join(small_side(many), leaf).withColumn("part", F.pmod(F.xxhash64("g", "x1", "y1", "x2", "y2"), F.col("parts")))
    chunks = dealt.groupBy(*leaf, "part").agg(F.collect_set(F.struct("g", "x1", "y1", "x2", "y2")).alias("f")).select(*leaf, F.col("f.g").alias("gs"), *[F.col(f"f.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    kind = dict(points.dtypes)[key]
    far = packs.join(chunks, leaf).mapInPandas(_measured(key), f"{key} {kind}, g int, distance double")
    done = written(far.groupBy(key, "g").agg(F.min("distance").alias("distance")), "nearest")
    scratch.drop()
    return everyone.join(done, [key, "g"], "left").drop("g")


def proximity(points: DataFrame, segments: DataFrame | None = None, polygons: DataFrame | None = None, by: list[str] | None = None, key: str = "episode_id", cell: float = 1000.0) -> DataFrame:
    """nearest() to lines, points and polygons; 0 inside a polygon."""
    by = by or []
    columns = [*by, "x1", "y1", "x2", "y2"]
    lines = segments.select(*columns) if segments is not None else None
    if polygons is None:
        return nearest(points, lines, key, cell, by=by)
    return by_place(points, lambda places: _proximity(places, lines, polygons, by, key, cell), key)


def _proximity(points: DataFrame, lines: DataFrame | None, polygons: DataFrame, by: list[str], key: str, cell: float) -> DataFrame:
    rims = segments_of(polygons, *by)
    out = _nearest(points, rims if lines is None else lines.unionByName(rims), key, cell, 4, by)
    at = points.select(key, "x", "y", F.floor(F.col("x") / cell).alias("tx"), F.floor(F.col("y") / cell).alias("ty"))
    held = at.join(tiled(polygons, cell, *by), ["tx", "ty"]).filter(F.col("whole") | odd_crossings(F.col("x"), F.col("y"), F.col("edges")))
    within = held.select(key, *by).distinct().withColumn("__in", F.lit(True))
    return out.join(within, [key, *by], "left").withColumn("distance", F.when(F.col("__in"), 0.0).otherwise(F.col("distance"))).drop("__in")


def bounded_nearest(points: DataFrame, segments: DataFrame, by: list[str], key: str = "episode_id") -> DataFrame:
    """Distance by group within the point's tile; nothing there: no row.  points carry tx, ty, and segments the tiles whose padded
    area they meet (one row each)."""
    return points.join(segments, ["tx", "ty"]).groupBy(key, *by).agg(F.min(segment_distance(F.col("x"), F.col("y"))).alias("distance"))
