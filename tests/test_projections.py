"""Projections against published examples, one another and the ways in which files tell them."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrain.operators import spatial
from tidegrain.operators.projections import SPHERE, Projection, of_epsg, of_tiff, of_wkt
from tidegrain.plans import spatial as plans

CLARKE = (6378206.4, 1 - math.sqrt(1 - 0.00676866))
#: (projection, lon, lat, x, y) of Snyder 1987, appendix A.
PUBLISHED = [
    (Projection("albers", 29.5, 45.5, 23.0, -96.0, ellipsoid=CLARKE), -75.0, 35.0, 1885472.7, 1535925.0),
    (Projection("lambert", 33.0, 45.0, 23.0, -96.0, ellipsoid=CLARKE), -75.0, 35.0, 1894410.9, 1564649.5),
    (Projection("mercator", lon_0=-75.0, scale=0.9996, ellipsoid=CLARKE), -73.5, 40.5, 127106.5, 4484124.4),
    (Projection("sinusoidal", lon_0=-90.0, ellipsoid=CLARKE), -75.0, -50.0, 1075471.5, -5540628.0),
]
OTHERS = [of_epsg(32614), of_epsg(32720), of_epsg(26917), of_epsg(5070), of_epsg(3857), Projection("sinusoidal", ellipsoid=SPHERE), Projection("lambert", 40.0, 40.0, 40.0, -97.0), Projection("degrees")]


@pytest.mark.parametrize("p,lon,lat,x,y", PUBLISHED, ids=lambda v: v.kind if isinstance(v, Projection) else "")
def test_published_examples(spark, p, lon, lat, x, y):
    assert np.allclose(p.forward(lon, lat), (x, y), atol=0.06)
    assert np.allclose(p.inverse(x, y), (lon, lat), atol=1e-6)


@pytest.mark.parametrize("p", [r[0] for r in PUBLISHED] + OTHERS, ids=lambda p: f"{p.kind}{p.lon_0:g}")
def test_there_and_back_as_columns_too(spark, p):
    g = np.random.default_rng(1)
    south = p.false_y > 0
    lon, lat = p.lon_0 + g.uniform(-3, 3, 50) if p.kind == "mercator" else g.uniform(-120, -70, 50), g.uniform(-60, -5, 50) if south else g.uniform(20, 55, 50)
    x, y = p.forward(lon, lat)
    back = p.inverse(x, y)
    assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
    cx, cy = p.columns(F.col("lon"), F.col("lat"))
    got = spark.createDataFrame(list(zip(lon.tolist(), lat.tolist())), "lon double, lat double").select(cx.alias("x"), cy.alias("y")).toPandas()
    assert np.abs(got.x - x).max() < 1e-6 and np.abs(got.y - y).max() < 1e-6


def test_transverse_mercator_keeps_shapes_and_lengths():
    """Along the central meridian lengths are those of the meridian, times the scale; everywhere x and y change alike."""
    p, d = Projection("mercator", lon_0=9.0), 1e-4
    a, f = p.ellipsoid
    e2 = f * (2 - f)
    s = np.linspace(0, math.radians(60), 200_001)
    arc = np.trapezoid(a * (1 - e2) / (1 - e2 * np.sin(s) ** 2) ** 1.5, s)
    assert abs(p.forward(9.0, 60.0)[1] - arc) < 1e-3
    lon, lat = np.array([7.0, 10.5, 12.0]), np.array([10.0, 45.0, 70.0])
    (x0, y0), (x1, y1), (x2, y2) = p.forward(lon, lat), p.forward(lon + d, lat), p.forward(lon, lat + d)
    n, m = a / np.sqrt(1 - e2 * np.sin(np.radians(lat)) ** 2) * np.cos(np.radians(lat)), a * (1 - e2) / (1 - e2 * np.sin(np.radians(lat)) ** 2) ** 1.5
    assert np.allclose(np.hypot(x1 - x0, y1 - y0) / n, np.hypot(x2 - x0, y2 - y0) / m, rtol=1e-5)


def test_told_by_wkt():
    text = 'PROJCS["NAD_1983_UTM_Zone_17N",GEOGCS["GCS_North_American_1983",DATUM["D_North_American_1983",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",-81.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'
    assert np.allclose(of_wkt(text).forward(-80.0, 30.0), of_epsg(26917).forward(-80.0, 30.0), atol=1e-6)
    feet = text.replace("Transverse_Mercator", "Lambert_Conformal_Conic").replace('["Scale_Factor",0.9996]', '["Standard_Parallel_1",29.5],PARAMETER["Standard_Parallel_2",30.5]').replace('UNIT["Meter",1.0]', 'UNIT["Foot_US",0.3048006096012192]').replace("500000.0", "1968500.0")
    metres = Projection("lambert", 29.5, 30.5, 0.0, -81.0, false_x=600_000.0, ellipsoid=spatial.GRS80)
    assert np.allclose(of_wkt(feet).forward(-80.0, 30.0), np.array(metres.forward(-80.0, 30.0)) / 0.3048006096012192, atol=1e-3)
    assert of_wkt('GEOGCS["GCS_North_American_1983",DATUM["D",SPHEROID["GRS_1980",6378137.0,298.257222101]],UNIT["Degree",0.017]]').kind == "degrees"
    with pytest.raises(ValueError, match="no projection Krovak"):
        of_wkt(text.replace("Transverse_Mercator", "Krovak"))


def _tiff_keys(keys, doubles=()):
    directory = [1, 1, 0, len(keys)] + [v for k in sorted(keys.items()) for v in ((k[0], 0, 1, k[1]) if isinstance(k[1], int) else (k[0], 34736, 1, doubles.index(k[1])))]
    body = struct.pack(f"<{len(directory)}H", *directory)
    more = struct.pack(f"<{len(doubles)}d", *doubles)
    entries = struct.pack("<HHII", 34735, 3, len(directory), 8) + (struct.pack("<HHII", 34736, 12, len(doubles), 8 + len(body)) if doubles else b"")
    data = b"II*\0" + struct.pack("<I", 8 + len(body) + len(more)) + body + more + struct.pack("<H", 2 if doubles else 1) + entries + b"\0" * 4
    return of_tiff(lambda at, n: data[at : at + n])


def test_told_by_geotiff_keys():
    assert _tiff_keys({1024: 2, 2048: 4326}).kind == "degrees" and _tiff_keys({1024: 1, 3072: 32614}) == of_epsg(32614)
    p = _tiff_keys({1024: 1, 2048: 4269, 3072: 32767, 3075: 11, 3078: 29.5, 3079: 45.5, 3084: -96.0, 3085: 23.0}, (29.5, 45.5, -96.0, 23.0))
    assert np.allclose(p.forward(-75.0, 35.0), of_epsg(5070).forward(-75.0, 35.0), atol=1e-6)
    with pytest.raises(ValueError, match="no projection of kind 15"):
        _tiff_keys({1024: 1, 3075: 15})


def test_buffers_on_a_raster_in_its_own_projection(spark):
    """On the buffers' own projection the clipped polygon gives what square cells give; on another one, cells of about the same area."""
    points = spark.createDataFrame([(1, -96.001, 37.502), (2, -95.998, 37.499)], "episode_id long, lon double, lat double")
    own = Projection("albers", 29.5, 45.5, 37.5, -96.0)
    grid = {"x0": -1000.0, "y0": 1000.0, "cell": 200.0, "width": 10, "height": 10}
    ask = lambda g, **more: {(r.episode_id, r.unit): r.weight for r in plans.buffer_grid(points, g, **more).collect()}
    square, clipped = ask(grid, degrees=False), ask(grid, own=own)
    assert all(abs(square.get(k, 0) - clipped.get(k, 0)) < 2e-4 for k in set(square) | set(clipped)) and len(clipped) >= 12
    utm = of_epsg(32614)
    x, y = utm.forward(-96.0, 37.5)
    turned = ask({**grid, "x0": float(x) - 1000, "y0": float(y) + 1000}, own=utm)
    assert sum(v for (e, _), v in turned.items() if e == 1) == pytest.approx(1) and max(turned.values()) < 200**2 / (math.pi * 270**2) * 1.01
