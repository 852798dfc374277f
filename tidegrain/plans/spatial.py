"""Spatial patterns: buffer weights from places in degrees, and distances to features, over time where features have years.

points(episode_id, lon, lat).  Polygons are (unit, rings) in metres of the same projection, or in degrees with degrees=True."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recode import ROADS, WATER, code_class, road_county, valid_coordinates
from ..operators.engine import duration_weighted, temporal_aggregate
from ..operators.engine import keys as level_keys
from ..operators.projections import Projection
from ..operators.spatial import albers, bounded_nearest, degree_grid_weights, grid_weights, nearest, overlap_shares, overlap_weights, wrong_weight_sums
from ..operators.spatial import proximity as proximity_distances
from ..shared import written
from ..sources.vectors import projected
from .patterns import episode_years

#: Side in degrees of a tile of the water search and the metres around it that are searched too.  Fixed values.
TILE, PAD = 0.5, 15_000.0


def placed(points: DataFrame) -> DataFrame:
    """Points with x, y in metres; missing where the place is no place."""
    ok = valid_coordinates(F.col("lon").cast("double"), F.col("lat").cast("double"))
    x, y = albers(F.col("lon").cast("double"), F.col("lat").cast("double"))
    return points.select("*", F.when(ok, x).alias("x"), F.when(ok, y).alias("y"))


def _metric(polygons: DataFrame, degrees: bool) -> DataFrame:
    if not degrees:
        return polygons
    shapes = polygons if "lines" in polygons.columns else polygons.withColumn("lines", F.array().cast("array<array<struct<x: double, y: double>>>"))
    return projected(shapes, albers)


def boundary_overlap_fast(points: DataFrame, polygons: DataFrame, radius: float = 270.0, step: float = 25.0, degrees: bool = False) -> DataFrame:
    """(episode_id, unit, weight): shares of the buffer by polygon, summing to 1."""
    return overlap_weights(placed(points), _metric(polygons, degrees), radius, step)


def boundary_overlap(points: DataFrame, polygons: DataFrame, radius: float = 270.0, degrees: bool = False) -> DataFrame:
    """(episode_id, unit, weight): the buffer's exact area in a polygon over its area in the polygons near that one; not normalised."""
    return overlap_shares(placed(points), _metric(polygons, degrees), radius)


def buffer_grid(points: DataFrame, grid: dict[str, float], radius: float = 270.0, offset: int = 0, degrees: bool = True, valid: DataFrame | None = None, own: Projection | None = None) -> DataFrame:
    """(episode_id, unit, weight) over the cells of a raster's grid (x0, y0, cell, width, height); written, and checked to sum to 1.
    own: the raster's projection, where it is neither in degrees nor in that of the buffers."""
    g = (grid["x0"], grid["y0"], grid["cell"], int(grid["width"]), int(grid["height"]))
    ok = valid_coordinates(F.col("lon").cast("double"), F.col("lat").cast("double"))
    out = degree_grid_weights(points.filter(ok), *g, radius, offset, valid, forward=own.forward if own else None) if degrees or own else grid_weights(placed(points), *g, radius, offset)
    out = written(out, "grid-weights")
    if not wrong_weight_sums(out).isEmpty():
        raise ValueError("weights of a buffer do not add up to 1")
    return out


def proximity(episodes: DataFrame, points: DataFrame, segments: DataFrame | None = None, polygons: DataFrame | None = None, category: str | None = None, categories: list[str] | None = None, yearly: bool = False, level: str = "participant", cell: float = 1000.0) -> DataFrame:
    """Distance to the nearest feature, 0 inside a polygon, weighted by days: static features by the length of stay, features with a
    `year` by the days in each year that has some.  One column `distance`, or one for each of `categories`."""
    by = (["year"] if yearly else []) + ([category] if category else [])
    found = proximity_distances(placed(points), segments, polygons, by, cell=cell)
    columns = ["distance"]
    if category:
        columns = categories or [r[0] for r in found.select(category).distinct().orderBy(category).limit(1000).collect()]
        found = found.groupBy("episode_id", *(["year"] if yearly else [])).pivot(category, columns).agg(F.first("distance"))
    if not yearly:
        return duration_weighted(found, episodes, columns, level)
    return temporal_aggregate(episode_years(episodes).join(found, ["episode_id", "year"], "left"), level_keys(level), columns)


def road_distances(points: DataFrame, roads: DataFrame, cell: float = 1000.0) -> DataFrame:
    """roads(year, MTFCC, x1, y1, x2, y2) -> (episode_id, year, dist_pri, dist_sec, dist_prisec), over the whole network; a row for
    every episode and every year that has a road of one of the classes."""
    names = F.coalesce(*[F.when(F.col("MTFCC") == code, F.lit(name)) for name, code in ROADS.items()])
    kept = roads.filter(F.col("MTFCC").isin(*ROADS.values())).select("year", names.alias("class"), "x1", "y1", "x2", "y2")
    found = nearest(placed(points), kept, cell=cell, by=["year", "class"])
    out = found.groupBy("episode_id", "year").pivot("class", list(ROADS)).agg(F.first("distance"))
    return out.select("episode_id", "year", F.col("pri").alias("dist_pri"), F.col("sec").alias("dist_sec"), F.least("pri", "sec").alias("dist_prisec"))


def road_files(counties: DataFrame) -> DataFrame:
    """counties(county, year) -> (county, year, code, name): the road file of each county of the 2010 list in each year."""
    code = road_county(F.col("county"), F.col("year"))
    return counties.select("county", "year", code.alias("code")).distinct().withColumn("name", F.format_string("tl_%d_%s_roads.zip", "year", "code"))


def _tiles(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / TILE), F.floor(high / TILE))


def water_distances(points: DataFrame, features: DataFrame) -> DataFrame:
    """features(layer, fcode, lon1, lat1, lon2, lat2) -> (episode_id, dist_flow, dist_water, dist_area, dist_coast, dist_blue) within the
    point's tile and PAD metres around it; nothing there is missing.  Where a tile has no feature of a category's codes, all features of
    its layer count, but for the coast, which stays empty inland.  Only points with valid coordinates have a row."""
    layers = {"flow": "flowline", "water": "waterbody", "area": "area", "coast": "flowline"}
    part = [F.when(F.lower("layer").contains(layer), F.struct(F.lit(c).alias("category"), code_class(features, WATER[c]).alias("good"))) for c, layer in layers.items()]
    rows = features.withColumn("c", F.explode(F.array_compact(F.array(*part)))).select("c.category", "c.good", "lon1", "lat1", "lon2", "lat2")
    south, north = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    high = PAD / 110_574.0  # degrees of latitude
    wide = PAD / (111_320.0 * F.cos(F.radians(F.least(F.lit(85.0), F.greatest(F.abs(south), F.abs(north)) + TILE + high))))
    rows = rows.withColumn("tx", F.explode(_tiles(F.least("lon1", "lon2") - wide, F.greatest("lon1", "lon2") + wide))).withColumn("ty", F.explode(_tiles(south - high, north + high)))
    any_good = rows.groupBy("tx", "ty", "category").agg(F.max("good").alias("any_good"))
    rows = rows.join(any_good, ["tx", "ty", "category"]).filter("good or (not any_good and category <> 'coast')")
    a, b = albers(F.col("lon1"), F.col("lat1")), albers(F.col("lon2"), F.col("lat2"))
    rows = rows.select("tx", "ty", "category", a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    at = placed(points).filter("x is not null").withColumns({"tx": F.floor(F.col("lon") / TILE), "ty": F.floor(F.col("lat") / TILE)})
    found = bounded_nearest(at, rows, ["category"]).groupBy("episode_id").pivot("category", list(layers)).agg(F.first("distance"))
    out = at.select("episode_id").join(found, "episode_id", "left")
    return out.select("episode_id", *[F.col(c).alias(f"dist_{c}") for c in layers], F.least(*layers).alias("dist_blue"))


def tile_count(extent: float, side: float = TILE) -> int:
    """Tiles that cover an extent in degrees; one at least, also for a cohort without places."""
    return max(1, math.ceil(extent / side)) if math.isfinite(extent) else 1
