"""Readers, rasters, vectors, periods and results on small files made here."""

import json
import struct
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrain.operators import spatial
from tidegrain.plans import catalog, results
from tidegrain.plans import spatial as plans
from tidegrain.sources import periods, rasters, readers, tables, vectors


def tiff(a: np.ndarray, x0: float, y0: float, cell: float, nodata: float | None = None, tile: int = 0, packed: bool = True, predictor: int = 1) -> bytes:
    """A GeoTIFF of (rows, columns[, bands])."""
    a = a if a.ndim == 3 else a[..., None]
    h, w, bands = a.shape
    bw, bh = (tile, tile) if tile else (w, 2)
    blocks = []
    for y in range(0, h, bh):
        for x in range(0, w, bw):
            b = a[y : y + bh, x : x + bw]
            if tile:
                b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])).astype(a.dtype)
            blocks.append(zlib.compress(b.tobytes()) if packed else b.tobytes())
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * a.dtype.itemsize] * bands), (259, 3, [8 if packed else 1]), (277, 3, [bands]), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [kind] * bands),
            (33550, 12, [cell, cell, 0.0]), (33922, 12, [0.0, 0.0, 0.0, x0, y0, 0.0])]
    tags += [(322, 4, [bw]), (323, 4, [bh])] if tile else [(278, 4, [bh])]
    if nodata is not None:
        tags.append((42113, 2, str(nodata).encode() + b"\0"))
    body, offsets = b"", []
    for b in blocks:
        offsets.append(8 + len(body))
        body += b
    tags += [(324 if tile else 273, 4, offsets), (325 if tile else 279, 4, [len(b) for b in blocks])]
    entries = b""
    for tag, code, values in sorted(tags, key=lambda t: t[0]):
        data = values if isinstance(values, bytes) else struct.pack("<" + {3: "H", 4: "I", 12: "d"}[code] * len(values), *values)
        if len(data) > 4:
            at, body = 8 + len(body), body + data
            data = struct.pack("<I", at)
        entries += struct.pack("<HHI", tag, code, len(values)) + data.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


@pytest.mark.parametrize("tile,packed,predictor,kind", [(0, True, 1, "f4"), (16, True, 2, "i2"), (0, False, 1, "u1"), (16, False, 1, "f8")])
def test_raster_bands(tile, packed, predictor, kind):
    a = (np.arange(23 * 37 * 2).reshape(23, 37, 2) % 200).astype(kind)
    data = tiff(a, -100.0, 40.0, 0.25, -1.0, tile, packed, predictor)
    assert rasters.grid_of(data) == rasters.Grid(-100.0, 40.0, 0.25, 37, 23, 2, -1.0)
    assert (rasters.band_of(data, 1) == a[..., 0]).all() and (rasters.band_of(data, 2) == a[..., 1]).all()


def test_raster_readers(spark, tmp_path):
    a = np.arange(12, dtype="f4").reshape(3, 4)
    a[0, 0] = -9999
    for name in ("night_2015.tif", "night_201601-201603.tif"):
        (tmp_path / name).write_bytes(tiff(a, -100.0, 40.0, 0.5, -9999.0))
    with zipfile.ZipFile(tmp_path / "ppt_20150102.zip", "w") as z:
        z.writestr("ppt.tif", tiff(a, -100.0, 40.0, 0.5))
    got = readers.vnl(spark, str(tmp_path), years=[2016]).toPandas()
    assert sorted(got.grid_id) == list(range(2, 13)) and set(map(str, got.start_date)) == {"2016-01-01"} and set(map(str, got.end_date)) == {"2016-03-31"}
    w = spark.createDataFrame([(3,), (7,), (99,)], "grid_id long")
    assert {(r.grid_id, r.day, r.night) for r in readers.noise(spark, {"day": str(tmp_path / "night_2015.tif"), "night": str(tmp_path / "night_201601-201603.tif")}, w).collect()} == {(3, 3.0, 3.0), (7, 7.0, 7.0)}
    day = readers.prism_part1(spark, {"ppt": str(tmp_path)}).toPandas()
    assert len(day) == 11 and set(map(str, day.date)) == {"2015-01-02"}
    assert rasters.checked_grid(spark, str(tmp_path / "night_2015.tif"))["width"] == 4
    (tmp_path / "far.tif").write_bytes(tiff(a, 10.0, 50.0, 0.5))
    with pytest.raises(ValueError):
        rasters.checked_grid(spark, str(tmp_path / "far.tif"))
    one = rasters.dated_cells(spark, str(tmp_path), "night*", F.lit("2016-02-01").cast("date"), F.lit("2016-02-02").cast("date"), {"a": 1}, w)
    assert sorted(r.grid_id for r in one.collect()) == [3, 7]
    assert spark.range(1).select(F.size(rasters.box_cells(-100.1, 39.9, -99.6, 40.1)).alias("n")).first().n == 6


def test_degree_grid_weights(spark):
    """Against a fine sum over points of the disk."""
    pts = [(1, -99.99995, 39.9999), (2, -99.9, 39.9), (3, -100.25, 40.0003), (4, None, 40.0)]
    df = spark.createDataFrame(pts, "episode_id long, lon double, lat double")
    got = {(r.episode_id, r.unit): r.weight for r in spatial.degree_grid_weights(df, -101.0, 41.0, 0.25, 8, 8).collect()}
    rng = np.random.default_rng(1)
    x, y = spatial.albers(F.col("lon"), F.col("lat"))
    for r in df.select("episode_id", x.alias("x"), y.alias("y")).filter("x is not null").collect():
        rad, ang = 270 * np.sqrt(rng.random(400_000)), 2 * np.pi * rng.random(400_000)
        lon, lat = spatial.albers_inverse(r.x + rad * np.cos(ang), r.y + rad * np.sin(ang))
        unit = np.floor((41 - lat) / 0.25).astype(int) * 8 + np.floor((lon + 101) / 0.25).astype(int)
        for u, n in zip(*np.unique(unit, return_counts=True)):
            assert got.pop((r.episode_id, u)) == pytest.approx(n / 400_000, abs=3e-3)
    assert all(w < 1e-4 for w in got.values())
    grid = {"x0": -101.0, "y0": 41.0, "cell": 0.25, "width": 8, "height": 8}
    valid = spark.createDataFrame([(36,)], "unit long")
    assert all(r.weight == 1 and r.unit == 36 for r in plans.buffer_grid(df, grid, valid=valid).collect())


def test_projection_there_and_back(spark):
    pts = pd.DataFrame({"lon": np.linspace(-124, -67, 40), "lat": np.linspace(25, 49, 40)})
    x, y = spatial.albers(F.col("lon"), F.col("lat"))
    p = spark.createDataFrame(pts).select("lon", "lat", x.alias("x"), y.alias("y")).toPandas()
    lon, lat = spatial.albers_inverse(p.x.to_numpy(), p.y.to_numpy())
    assert np.allclose(lon, p.lon, atol=1e-10) and np.allclose(lat, p.lat, atol=1e-10)


GEO = {"type": "FeatureCollection", "features": [
    {"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]}},
    {"type": "Feature", "properties": {"id": "b"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0, 9], [1, 1, 9]], [[5, 5], [6, 5], [7, 7]]]}},
    {"type": "Feature", "properties": {"id": "c"}, "geometry": {"type": "Point", "coordinates": [3, 3]}},
    {"type": "Feature", "properties": {"id": "d"}, "geometry": None}, {"type": "Feature", "properties": {"id": "e"}, "geometry": {"type": "Polygon", "coordinates": []}},
]}


def test_vectors(spark, tmp_path):
    (tmp_path / "f.geojson").write_text(json.dumps(GEO))
    shapes = vectors.read_geojson(spark, str(tmp_path / "f.geojson")).withColumn("id", F.col("properties")["id"])
    rows = {r.id: r for r in shapes.collect()}
    assert set(rows) == {"a", "b", "c"} and [len(x) for x in rows["a"].rings] == [4, 4]
    assert vectors.segments(shapes, "id").groupBy("id").count().orderBy("id").collect() == [("b", 3), ("c", 1)]
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 9.0, 9.0)], "episode_id long, x double, y double")
    polygons = shapes.filter("id = 'a'").select(F.col("id").alias("unit"), "rings")
    assert {r.episode_id: r.unit for r in spatial.points_in_polygons(points, polygons, tile=1.0).collect()} == {1: "a", 2: None, 3: None}
    assert {r.episode_id: round(r.distance, 6) for r in spatial.proximity(points, polygons=polygons, cell=1.0).collect()} == {1: 0.0, 2: 0.5, 3: round(50**0.5, 6)}
    vectors.write_geo(shapes.drop("properties"), str(tmp_path / "g"))
    back = {r.id: r for r in vectors.from_wkb(spark.read.parquet(str(tmp_path / "g"))).collect()}
    assert all(back[k].rings == rows[k].rings and back[k].lines == rows[k].lines for k in rows)
    (tmp_path / "b.geojsonl").write_text(json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [[[-96, 40], [-95.999, 40], [-95.999, 40.001], [-96, 40.001], [-96, 40]]]}}) + "\n")
    b = vectors.footprints(spark, str(tmp_path / "b.geojsonl")).first()
    assert (round(b.lon, 6), round(b.lat, 6)) == (-95.9995, 40.0005) and abs(b.area - 85.28 * 110.574) < 30 and len(b.quadkey) == 9
    assert spark.range(1).select(vectors.quadkey(F.lit(0.1), F.lit(0.1), 3).alias("q")).first().q == "122"


def test_nearest_keeps_every_row(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, None), (3, 100.0, 0.0)], "episode_id long, x double, y double")
    lines = spark.createDataFrame([("p", 0.0, 3.0, 200.0, 3.0), ("q", 90.0, -50.0, 110.0, 50.0)], "kind string, x1 double, y1 double, x2 double, y2 double")
    got = {(r.episode_id, r.kind): r.distance and round(r.distance, 6) for r in spatial.nearest(points, lines, cell=1.0, by=["kind"]).collect()}
    assert len(got) == 6 and got[1, "p"] == 3 and got[3, "q"] == 0 and got[2, "p"] is None
    assert [r.distance for r in spatial.nearest(points, lines.limit(0), by=["kind"]).collect()] == [None] * 3


def test_boundary_patterns(spark):
    ring = lambda a, b: [(float(x), float(y)) for x, y in ((a, 39.9), (b, 39.9), (b, 40.1), (a, 40.1))]
    polygons = spark.createDataFrame([("w", [ring(-100.1, -100.0)]), ("e", [ring(-100.0, -99.9)])], "unit string, rings array<array<struct<x: double, y: double>>>")
    points = spark.createDataFrame([(1, -100.0, 40.0), (2, -99.95, 40.0), (3, 500.0, 40.0)], "episode_id long, lon double, lat double")
    for pattern in ("boundary_overlap_fast", "boundary_overlap"):
        got = {(r.episode_id, r.unit): round(r.weight, 2) for r in results.get_pattern(pattern)(points, polygons, degrees=True).collect()}
        assert got == {(1, "w"): 0.5, (1, "e"): 0.5, (2, "e"): 1.0}
    assert {"static_areal", "nhd_proximity", "grid_weights"} <= set(results.PATTERNS) and catalog


def test_table_readers(spark, tmp_path):
    pd.DataFrame({"grid_id": [1, 2, 1], "date": ["2015-01-01", "2015-01-01", "2016-01-01"], "value": [1.0, 2.0, 3.0]}).to_parquet(tmp_path / "tmax_2015.parquet")
    pd.DataFrame({"grid_id": [2, 3], "date": ["2015-01-01", "2015-01-01"], "value": [5.0, 6.0]}).to_pickle(tmp_path / "ppt_2015.pkl")
    got = readers.prism(spark, {"tmax": [str(tmp_path / "tmax_2015.parquet")], "ppt": [str(tmp_path / "ppt_2015.pkl")]}).toPandas()
    assert len(got) == 4 and got[got.grid_id == 2][["tmax", "ppt"]].values.tolist() == [[2.0, 5.0]]
    pd.DataFrame({"grid_id": [1, 2], "date": pd.to_datetime(["2015-01-01", "2015-01-02"]).date, "value": [-1000.0, 250.0], "feature": "uv", "year": 2015}).to_parquet(tmp_path / "uv.parquet")
    assert [(r.grid_id, r.uv) for r in readers.temis(spark, str(tmp_path / "uv.parquet"), ["uv"], [2015]).orderBy("grid_id").collect()] == [(1, None), (2, 0.25)]
    head = "Date,FIPS,LON,LAT,value\n"
    (tmp_path / "o3.csv").write_text(head + "2015/01/01,1001020100,0,0,30.5\nJan-02-2015,1001020100,0,0,x\n2015/01/01,99,0,0,1\n")
    (tmp_path / "pm.csv").write_text(head + "2015/01/01,1001020100,0,0,7\n2015/01/03,1001020100,0,0,8\n")
    w = spark.createDataFrame([("01001020100",)], "unit string")
    rows = readers.get_reader("faqsd")(spark, {2015: str(tmp_path / "o3.csv")}, {2015: str(tmp_path / "pm.csv")}, w, 2015, 2016).orderBy("date").collect()
    assert [(str(r.date), r.o3, r.pm25) for r in rows] == [("2015-01-01", 30.5, 7.0), ("2015-01-02", None, None)]
    with pytest.raises(FileNotFoundError):
        readers.faqsd(spark, {2015: "a"}, {2015: "b"}, None, 2017, 2018)
    pd.DataFrame({"episode_id": [1, 2], "year": [2015, 2016], "distance_primary": [1.0, np.nan], "distance_secondary": [2.0, 3.0], "distance_prisec": [1.0, 3.0]}).to_parquet(tmp_path / "roads.parquet")
    assert [tuple(r) for r in readers.tiger_roads(spark, str(tmp_path / "roads.parquet"), [2016]).collect()] == [(2, 2016, None, 3.0, 3.0)]
    pd.DataFrame({"period": ["2013360-2014008"], "grid_id": [4], "bc": [0.5]}).to_parquet(tmp_path / "bc.parquet")
    assert [str(r.start_date) for r in readers.acag(spark, str(tmp_path / "bc.parquet"), "bc", [2014]).collect()] == ["2013-12-26"]
    with pytest.raises(ValueError):
        readers.register_reader("nhd")(readers.nhd)
    daily = spark.createDataFrame([("01001020100", "2015-01-01", 1.0), ("x", "2015-01-01", 2.0)], "unit string, date string, v double").withColumn("date", F.col("date").cast("date"))
    daily.write.parquet(str(tmp_path / "daily"))
    assert readers.dated_table(spark, str(tmp_path / "daily"), w, "2015-01-01", "2015-12-31").count() == 1
    assert readers.rekeyed(spark.createDataFrame([(1, 77, 1.0)], "episode_id int, code int, weight double"), "code", 5).first().unit == "00077"


def test_periods(spark, tmp_path):
    for name in ("MOD.A2015032.h5", "x_20150101.nc", "y_2014.tif", "readme"):
        (tmp_path / name).write_bytes(b"0")
    got = [(r.name, str(r.start_date)) for r in periods.files(spark, str(tmp_path)).collect()]
    assert got == [("y_2014.tif", "2014-01-01"), ("x_20150101.nc", "2015-01-01"), ("MOD.A2015032.h5", "2015-02-01")]
    (tmp_path / "m.csv").write_text("file,start,end\nMOD.A2015032.h5,2015-02-01,2015-02-20\nx_20150101.nc,2015/01/01,\ny_2014.tif,2014-05-01,\n")
    found = periods.files(spark, str(tmp_path), "[MOxy]*")
    given = {r.name: str(r.end_date) for r in periods.two_week_ends(periods.with_manifest(found, spark, str(tmp_path / "m.csv"))).collect()}
    assert given == {"y_2014.tif": "2014-05-16", "x_20150101.nc": "2015-01-16", "MOD.A2015032.h5": "2015-02-20"}
    with pytest.raises(ValueError):
        periods.with_manifest(periods.files(spark, str(tmp_path), "y*"), spark, str(tmp_path / "m.csv"))
    days = lambda *d: spark.createDataFrame([(x,) for x in d], "d string").select(F.col("d").cast("date").alias("start_date"))
    ends = lambda *d: [str(r.end_date) for r in periods.two_week_ends(days(*d)).orderBy("start_date").collect()]
    assert ends("2015-01-01", "2015-01-15", "2015-01-29", "2015-03-12") == ["2015-01-14", "2015-01-28", "2015-02-11", "2015-03-25"]  # a gap keeps the usual step


def test_tables_refuse(spark, tmp_path):
    raw = spark.createDataFrame([("01001", "2015", "1", None), ("01001", "2015", "x", None), ("1001", "2015.5", "y", None), ("", "1800", "z", None)], "k string, y string, v string, w string")
    messages = tables.refused(tables.table_report(raw, "k", 5, ["v", "w"], year="y"), ["v", "w"])
    assert messages == ["1 of 4 rows: no key", "1 of 4 rows: ill-formed key", "2 of 4 rows: no usable year or date", "1 of 4 rows: duplicate of a key and period", "column w has no data", "column v is mostly no numbers"]
    assert tables.numeric_columns(raw, ["k"]) == ["y"]


def test_results(spark, tmp_path):
    weights = spark.createDataFrame([(1, "01001"), (2, "01002"), (3, "36061")], "episode_id int, unit string")
    values = spark.createDataFrame([("06001",), ("01002",)], "unit string")
    text = results.diagnosis("v", weights, values, 10.0)
    assert "3 units in 01 (2), 36 (1)" in text and "1 in common" in text and results.diagnosis("v", weights, values, 90.0) is None
    points = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 1.0)], "episode_id long, lon double, lat double")
    made = []
    make = lambda: made.append(1) or weights
    for p in (points, points.orderBy(F.desc("episode_id")), points.limit(1)):
        assert results.kept_weights(spark, str(tmp_path), p, {"radius": 270}, make).count() == 3
    assert len(made) == 2
    a, b = spark.createDataFrame([("x", 1.0)], "pid string, v double"), spark.createDataFrame([("x", 9.0, 2.0), ("y", 9.0, 3.0)], "pid string, v double, w double")
    assert {tuple(r) for r in results.partial([a, b]).collect()} == {("x", 1.0, 2.0), ("y", None, 3.0)}
    assert plans.tile_count(float("nan")) == 1 and plans.tile_count(0.7) == 2


def test_datasets(spark, tmp_path):
    from tidegrain.sources import datasets

    folder = f"file://{tmp_path}/sets"
    df = spark.createDataFrame([("01001", 2012, 1.0), ("01002", 2015, 2.0)], "unit string, year int, v double")
    assert datasets.datasets(spark, folder).count() == 0
    datasets.register(df, folder, "food", "table", {"boundary": "tract"}, ("year",))
    assert datasets.dataset(spark, folder, "food").count() == 2 and [r.kind for r in datasets.datasets(spark, folder).collect()] == ["table"]
    with pytest.raises(ValueError):
        datasets.register(df, folder, "food", "table")
    datasets.remove(spark, folder, "food")
    with pytest.raises(ValueError):
        datasets.dataset(spark, folder, "food")
    assert [r.unit for r in datasets.restricted(df, df).collect()] == ["01002"]
    assert datasets.labelled(df, spark.createDataFrame([("v",), ("x",), ("unit",)], "name string")).columns == ["v", "unit"]
    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"y": "2015"}, "geometry": {"type": "LineString", "coordinates": [[-96, 40], [-96, 41]]}}]}))
    made = datasets.prepared_features(vectors.read_geojson(spark, str(tmp_path / "r.geojson")), "y").first()
    assert made.year == 2015 and abs(made.lines[0][0].x) < 1e-6


def test_uploads(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿GEOID, rate ,,place\n01001,1.5,x,Zürich\n , ,,\n01003,N/A,,\n01005,10,,\"a, \"\"b\"\"\"\n".encode())
    df = tables.read_upload(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["GEOID", "rate", "place"] and [tuple(r) for r in df.collect()] == [("01001", "1.5", "Zürich"), ("01003", "N/A", None), ("01005", "10", 'a, "b"')]
    assert [tuple(r)[1:] for r in tables.preview(df).orderBy("place").collect()] == [("GEOID", 3, True, 1001.0, 1005.0), ("rate", 3, True, 1.5, 10.0), ("place", 3, False, None, None)]
    assert tables.sampled(df) == {"GEOID": ["01001", "01003", "01005"], "rate": ["1.5", "10", "N/A"], "place": ["Zürich", 'a, "b"']}
    (tmp_path / "b.csv").write_bytes("k,v\n1,Zürich\n".encode("latin-1"))
    assert tables.read_upload(spark, str(tmp_path / "b.csv")).first().v == "Zürich"
    for name, data, said in (("c.csv", "k,v\n , \n", "no data rows"), ("d.csv", " ,\n1,2\n", "no column names")):
        (tmp_path / name).write_text(data)
        with pytest.raises(ValueError, match=said):
            tables.read_upload(spark, str(tmp_path / name))
