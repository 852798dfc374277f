"""Vector files as rows: (properties, kind, rings | segments).  GeoJSON is parsed with SQL functions; WKB, as GeoParquet has it, in
numpy inside tasks.  Coordinates lose a third dimension, collections fall into their parts, and what is empty goes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINT = "struct<x: double, y: double>"
_SHAPE = f"rings array<array<{_POINT}>>, lines array<array<{_POINT}>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(properties map<string, string>, rings, lines) of a FeatureCollection, or of one feature in each line."""
    geometry = "struct<type: string, coordinates: string>"
    feature = f"struct<properties: map<string, string>, geometry: {geometry}>"
    raw = spark.read.text(path, wholetext=path.endswith((".geojson", ".json")))
    parsed = raw.select(F.from_json("value", f"struct<features: array<{feature}>, properties: map<string, string>, geometry: {geometry}>").alias("f"))
    single = F.array(F.struct(F.col("f.properties").alias("properties"), F.col("f.geometry").alias("geometry")))
    rows = parsed.select(F.explode(F.coalesce("f.features", single)).alias("g")).filter("g.geometry.type is not null")
    c, kind = F.col("g.geometry.coordinates"), F.col("g.geometry.type")
    as_ = lambda depth: F.from_json(c, "array<" * depth + "double" + ">" * depth)
    point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    path_ = lambda line: F.transform(line, point)
    none = F.array().cast(f"array<array<{_POINT}>>")
    rings = F.when(kind == "Polygon", F.transform(as_(3), path_)).when(kind == "MultiPolygon", F.transform(F.flatten(as_(4)), path_)).otherwise(none)
    lines = (
        F.when(kind == "LineString", F.array(path_(as_(2)))).when(kind == "MultiLineString", F.transform(as_(3), path_))
        .when(kind == "Point", F.array(F.array(point(as_(1))))).when(kind == "MultiPoint", F.transform(as_(2), lambda p: F.array(point(p)))).otherwise(none)
    )
    return cleaned(rows.select("g.properties", rings.alias("rings"), lines.alias("lines")))


def cleaned(shapes: DataFrame) -> DataFrame:
    """Rings without their closing vertex and of three at least, lines with finite points only, no empty shapes."""
    finite = lambda p: ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < 1e300) & (F.abs(p["y"]) < 1e300)
    whole = lambda line: F.filter(line, lambda p: F.coalesce(finite(p), F.lit(False)))
    open_ = lambda r: F.when((F.size(r) > 1) & (F.get(r, F.lit(0)) == F.element_at(r, -1)), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)
    rings = F.filter(F.transform("rings", lambda r: open_(whole(r))), lambda r: F.size(r) >= 3)
    lines = F.filter(F.transform("lines", whole), lambda r: F.size(r) >= 1)
    return shapes.withColumns({"rings": rings, "lines": lines}).filter("size(rings) > 0 or size(lines) > 0")


def segments(shapes: DataFrame, *keep: str) -> DataFrame:
    """(*keep, x1, y1, x2, y2) of the lines; a point is a segment of length 0."""
    step = lambda line: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(line) - 2)), lambda k: F.struct(
        F.get(line, k).alias("a"), F.coalesce(F.get(line, k + 1), F.get(line, k)).alias("b")))
    out = shapes.select(*keep, F.explode(F.flatten(F.transform("lines", step))).alias("s"))
    return out.select(*keep, F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def projected(shapes: DataFrame, forward) -> DataFrame:
    """rings and lines through forward(x, y) -> (x, y), such as albers."""
    move = lambda p: (lambda q: F.struct(q[0].alias("x"), q[1].alias("y")))(forward(p["x"], p["y"]))
    return shapes.withColumns({c: F.transform(c, lambda line: F.transform(line, move)) for c in ("rings", "lines")})


def _parts(data: bytes, at: int = 0) -> tuple[list, list, int]:
    """(rings, lines, end) of a WKB geometry."""
    order = "<" if data[at] == 1 else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    deep = 2 + (kind & 0x80000000 > 0 or kind % 10000 // 1000 in (1, 3)) + (kind & 0x40000000 > 0 or kind % 10000 // 1000 in (2, 3))
    at += 9 if kind & 0x20000000 else 5
    kind = (kind & 0xFFFF) % 1000

    def path(at: int, n: int | None = None) -> tuple[list, int]:
        if n is None:
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
        v = np.frombuffer(data, order + "f8", n * deep, at).reshape(n, deep)
        return [{"x": float(x), "y": float(y)} for x, y in v[:, :2]], at + 8 * n * deep

    if kind == 1:
        line, at = path(at, 1)
        return [], [line], at
    if kind == 2:
        line, at = path(at)
        return [], [line], at
    (n,) = struct.unpack_from(order + "I", data, at)
    at, rings, lines = at + 4, [], []
    for _ in range(n):
        if kind == 3:
            ring, at = path(at)
            rings.append(ring)
        else:
            more_rings, more_lines, at = _parts(data, at)
            rings, lines = rings + more_rings, lines + more_lines
    return rings, lines, at


def from_wkb(df: DataFrame, column: str = "geometry") -> DataFrame:
    """A binary column -> rings and lines; the other columns stay."""
    keep = [f for f in df.schema.fields if f.name != column]

    shape = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_parts(b)[:2] if b is not None else ([], []) for b in batch.column(column).to_pylist()]
            columns = [batch.column(f.name) for f in keep] + [pa.array([m[k] for m in made], shape) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in keep], "rings", "lines"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], _SHAPE])
    return cleaned(df.select(*[f.name for f in keep], column).mapInArrow(parse, schema))


def polygons_of(rings: list) -> list[list]:
    """Rings as polygons: each a shell and the holes right inside it, by how many rings a ring lies in."""
    xy = [np.array([(p["x"], p["y"]) for p in r]) for r in rings]
    boxes = [(*v.min(axis=0), *v.max(axis=0)) for v in xy]

    def holds(outer: int, inner: int) -> bool:
        """Whether most vertices and middles of edges of a ring are in another; a few may lie on it."""
        if boxes[outer][0] > boxes[inner][0] or boxes[outer][1] > boxes[inner][1] or boxes[outer][2] < boxes[inner][2] or boxes[outer][3] < boxes[inner][3]:
            return False
        v = xy[inner]
        x, y = np.concatenate([v, (v + np.roll(v, -1, axis=0)) / 2]).T
        (ax, ay), (bx, by) = xy[outer].T[:, :, None], np.roll(xy[outer], -1, axis=0).T[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            crossed = ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        return 2 * (crossed.sum(axis=0) % 2 == 1).sum() > len(x)

    area = [abs(float(np.dot(v[:, 0] - v[0, 0], np.roll(v[:, 1], -1) - np.roll(v[:, 1], 1)))) for v in xy]
    around = [[o for o in range(len(rings)) if o != i and area[o] > area[i] and holds(o, i)] for i in range(len(rings))]
    shells = {i: [rings[i]] for i in range(len(rings)) if len(around[i]) % 2 == 0}
    for i, outer in enumerate(around):
        if i not in shells:
            shells[min(outer, key=lambda o: (-len(around[o]), area[o]))].append(rings[i])
    return list(shells.values())


def _packed(rings: list, lines: list) -> bytes:
    points = lambda line: struct.pack("<I", len(line)) + b"".join(struct.pack("<2d", p["x"], p["y"]) for p in line)
    polygons = [struct.pack("<BII", 1, 3, len(p)) + b"".join(points([*r, r[0]]) for r in p) for p in polygons_of(rings)]
    parts = [polygons[0] if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(polygons)] if polygons else []
    parts += [struct.pack("<BI", 1, 1) + struct.pack("<2d", x[0]["x"], x[0]["y"]) if len(x) == 1 else struct.pack("<BI", 1, 2) + points(x) for x in lines]
    return parts[0] if len(parts) == 1 else struct.pack("<BII", 1, 7, len(parts)) + b"".join(parts)


def write_geo(df: DataFrame, path: str) -> None:
    """Parquet with a WKB column in place of rings and lines; replaces what is there.  Rings are written as polygons with holes."""
    keep = [f for f in df.schema.fields if f.name not in ("rings", "lines")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shapes = zip(batch.column("rings").to_pylist(), batch.column("lines").to_pylist(), strict=True)
            columns = [*[batch.column(f.name) for f in keep], pa.array([_packed(r, x) for r, x in shapes], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in keep], "geometry"])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in keep], "geometry binary"])
    df.select(*[f.name for f in keep], "rings", "lines").mapInArrow(pack, schema).write.mode("overwrite").parquet(path)


def quadkey(lon: Column, lat: Column, level: int = 9) -> Column:
    """The key of the web map tile of a place."""
    n = 1 << level
    s = F.sin(F.radians(lat))
    x = F.least(F.lit(n - 1), F.floor((lon + 180) / 360 * n)).cast("int")
    y = F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * np.pi)) * n))).cast("int")
    digit = lambda k: F.shiftright(x, k).bitwiseAND(F.lit(1)) + 2 * F.shiftright(y, k).bitwiseAND(F.lit(1))
    return F.concat(*[digit(k).cast("string") for k in range(level - 1, -1, -1)])


def footprints(spark: SparkSession, path: str, least: float = 0.0, most: float = 1e12) -> DataFrame:
    """(quadkey, lon, lat, area) of building outlines, one GeoJSON feature in each line, by area in square metres."""
    shapes = read_geojson(spark, path).filter("size(rings) > 0").select(F.get("rings", F.lit(0)).alias("r"))
    turn = lambda k: (k + 1) % F.size("r")
    wide = F.cos(F.radians(F.get("r", F.lit(0))["y"])) * 111_320.0 * 110_574.0
    at = lambda k, c: F.get("r", k)[c] - F.get("r", F.lit(0))[c]
    cross = F.transform(F.sequence(F.lit(0), F.size("r") - 1), lambda k: F.struct(
        (at(k, "x") * at(turn(k), "y") - at(turn(k), "x") * at(k, "y")).alias("c"), (at(k, "x") + at(turn(k), "x")).alias("x"), (at(k, "y") + at(turn(k), "y")).alias("y")))
    total = lambda f: F.aggregate("cross", F.lit(0.0), lambda acc, e: acc + f(e))
    out = shapes.withColumn("cross", cross).withColumn("twice", total(lambda e: e["c"])).filter("twice <> 0")
    centre = lambda c: F.get("r", F.lit(0))[c] + total(lambda e: e["c"] * e[c]) / (3 * F.col("twice"))
    out = out.select(centre("x").alias("lon"), centre("y").alias("lat"), (F.abs("twice") / 2 * wide).alias("area"))
    return out.filter(F.col("area").between(least, most)).select(quadkey(F.col("lon"), F.col("lat")).alias("quadkey"), "lon", "lat", "area")
