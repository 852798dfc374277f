"""Polygons cut to square tiles, so that a point or a disk meets only the edges near it.

Edges are filed one by one to the rows of tiles that they pass.  A row of tiles of one polygon is cut from right to left: the heights at
which the polygon lies on a tile's right border are those on the next border, changed by the edges in between, so each tile gets its
own pieces of edges and at most a few pieces of border, and a tile without edges is whole or absent.  No tile sees a polygon's other edges.

polygons have rings, an array of rings, a ring an array of struct<x, y> whose first vertex is not repeated; a point is inside if it is in an
odd number of rings.  Rows of equal rings and keys are one polygon; other rows of equal keys are polygons of their own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import partitions


def edges_of(rings: Column) -> Column:
    """All edges of rings: array of struct<ax, ay, bx, by>."""
    of_ring = lambda r: F.transform(F.sequence(F.lit(0), F.size(r) - 1), lambda k: F.struct(
        F.get(r, k)["x"].alias("ax"), F.get(r, k)["y"].alias("ay"), F.get(r, (k + 1) % F.size(r))["x"].alias("bx"), F.get(r, (k + 1) % F.size(r))["y"].alias("by")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 2), of_ring))


def odd_crossings(x: Column, y: Column, edges: Column) -> Column:
    """Half-open ray casting to the right."""
    crossed = F.filter(edges, lambda e: ((e["ay"] > y) != (e["by"] > y)) & (x < (e["bx"] - e["ax"]) * (y - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"]))
    return F.size(crossed) % 2 == 1


def inside(x: Column, y: Column, ring: Column) -> Column:
    return odd_crossings(x, y, edges_of(F.array(ring)))


def _cut(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, y0: float, tile: float) -> tuple[np.ndarray, ...]:
    """(column, xa, ya, xb, yb): the pieces of the edges in a row of tiles that begins at y0, from left to right."""
    slope = (bx - ax) / (by - ay)
    clip = lambda y: np.where(y < y0, y0, np.where(y > y0 + tile, y0 + tile, y))
    ca, cb = clip(ay), clip(by)
    ax, bx = np.where(ca == ay, ax, ax + (ca - ay) * slope), np.where(cb == by, bx, ax + (cb - ay) * slope)
    ay, by = ca, cb
    swap = ax > bx
    ax, bx, ay, by = np.where(swap, bx, ax), np.where(swap, ax, bx), np.where(swap, by, ay), np.where(swap, ay, by)
    first = np.floor(ax / tile).astype(np.int64)
    n = np.floor(bx / tile).astype(np.int64) - first + 1
    at = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    column = first[at] + step
    with np.errstate(divide="ignore", invalid="ignore"):
        height = lambda x: ay[at] + (x - ax[at]) * ((by - ay) / (bx - ax))[at]
        low, high = np.minimum(ay, by)[at], np.maximum(ay, by)[at]
        xa, xb = column * tile, (column + 1) * tile
        starts, ends = step == 0, step == n[at] - 1
        ya, yb = np.where(starts, ay[at], np.clip(height(xa), low, high)), np.where(ends, by[at], np.clip(height(xb), low, high))
    kept = ya != yb
    return tuple(v[kept] for v in (column, np.where(starts, ax[at], xa), ya, np.where(ends, bx[at], xb), yb))


def _row(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, ty: int, tile: float) -> list[tuple]:
    """(tx, whole, corners, left) of the tiles of one polygon in the row ty.  corners: the pieces of edges and of the right border, four
    numbers each; left: where the polygon lies on the left border, pairs of heights."""
    y0, x_of = ty * tile, lambda c: c * tile
    column, *pieces = _cut(ax, ay, bx, by, y0, tile)
    order = np.argsort(-column, kind="stable")
    column, pieces = column[order], np.stack(pieces, 1)[order]
    edges = np.flatnonzero(np.diff(column, prepend=np.iinfo(np.int64).min)).tolist() + [len(column)]
    out, border, before = [], np.zeros(0), None
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        c = int(column[a])
        if before is not None and len(border):  # the tiles between two that have edges
            whole = len(border) == 2 and border[0] == y0 and border[1] == y0 + tile
            for tx in range(c + 1, before):
                right = [v for s in border.reshape(-1, 2).tolist() for v in (x_of(tx + 1), s[0], x_of(tx + 1), s[1])]
                out.append((tx, whole, None if whole else right, None if whole else border.tolist()))
        own, right = pieces[a:b], border.reshape(-1, 2)
        ends, times = np.unique(np.concatenate([border, own[:, 1], own[:, 3]]), return_counts=True)
        border, before = ends[times % 2 == 1], c
        shut = np.stack([np.full(len(right), x_of(c + 1)), right[:, 0], np.full(len(right), x_of(c + 1)), right[:, 1]], 1)
        out.append((c, False, np.concatenate([own, shut]).ravel().tolist(), border.tolist()))
    return out


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, of batches whose rows are sorted by it; a key may go on in the next batch."""
    left: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        new = np.zeros(len(batch), bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        if left and any(left[-1][k].iat[-1] != v[0] for k, v in zip(keys, values, strict=True)):
            yield pd.concat(left)
            left = []
        edges = [0, *np.flatnonzero(new).tolist(), len(batch)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            left.append(batch.iloc[a:b])
            if b < len(batch):
                yield pd.concat(left) if len(left) > 1 else left[0]
                left = []
    if left:
        yield pd.concat(left)


def tile_pieces(polygons: DataFrame, tile: float, *keep: str) -> DataFrame:
    """(*keep, tx, ty, whole, corners, left) of every tile that a polygon meets; see _row().  A tile that lies wholly inside has no corners."""
    kinds = dict(polygons.dtypes)
    named = {k: f"__k{n}" for n, k in enumerate(keep)}
    filed = polygons.select(F.struct(*[F.col(k).alias(v) for k, v in named.items()] or [F.lit(0).alias("__none")]).alias("__keep"), F.col("rings"))
    filed = filed.select("__keep", F.xxhash64("__keep", "rings").alias("poly"), F.posexplode(edges_of(F.col("rings"))).alias("pos", "e")).filter("e.ay <> e.by")
    filed = filed.select("__keep", "poly", "pos", "e.*")
    filed = filed.withColumn("ty", F.explode(F.sequence(F.floor(F.least("ay", "by") / tile), F.floor(F.greatest("ay", "by") / tile))))
    # a polygon's keys travel as text beside its edges, once for each row of tiles in the end
    filed = filed.select(F.to_json("__keep", {"ignoreNullFields": "false"}).alias("keep"), "poly", "ty", "pos", "ax", "ay", "bx", "by")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in runs(batches, ["poly", "ty"]):
            e = g[["ax", "ay", "bx", "by"]].to_numpy(float)[np.unique(g.pos.to_numpy(), return_index=True)[1]]
            ty = int(g.ty.iat[0])
            out += [(g.keep.iat[0], tx, ty, *more) for tx, *more in _row(*e.T, ty, tile)]
            if len(out) > 2000:
                yield pd.DataFrame(out, columns=["keep", "tx", "ty", "whole", "corners", "left"])
                out = []
        yield pd.DataFrame(out, columns=["keep", "tx", "ty", "whole", "corners", "left"])

    # a number of its own, as rows that are few bytes are still much work for one task
    cut = filed.repartition(partitions(polygons.sparkSession), "poly", "ty").sortWithinPartitions("poly", "ty").mapInPandas(rows, "keep string, tx long, ty long, whole boolean, corners array<double>, left array<double>")
    schema = ", ".join(f"{v}: {kinds[k]}" for k, v in named.items())
    back = F.from_json("keep", f"struct<{schema}>") if keep else F.lit(None)
    return cut.withColumn("__keep", back).select(*[F.col(f"__keep.{v}").alias(k) for k, v in named.items()], "tx", "ty", "whole", "corners", "left")


def tiled(polygons: DataFrame, tile: float, *keep: str) -> DataFrame:
    """(*keep, tx, ty, whole, edges): tile_pieces() with the edges that a ray from a point of the tile to the right can cross, as structs."""
    n = F.floor(F.size("corners") / 4).cast("int")
    at = lambda k, c: F.get("corners", k * 4 + c)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(at(k, 0).alias("ax"), at(k, 1).alias("ay"), at(k, 2).alias("bx"), at(k, 3).alias("by")))
    return tile_pieces(polygons, tile, *keep).select(*keep, "tx", "ty", "whole", F.when(~F.col("whole"), edges).alias("edges"))
