"""Repair of rings, and shapes between projections."""

import math

import numpy as np
import pytest

from tidegrain.operators import spatial
from tidegrain.operators.projections import of_epsg
from tidegrain.sources import rings, vector_files

CASES = {
    "bow tie": ([[(0, 0), (4, 4), (4, 0), (0, 4)]], 8.0, [3, 3]),
    "spike": ([[(0, 0), (4, 0), (4, 4), (9, 9), (4, 4), (0, 4)]], 16.0, [4]),
    "spike along an edge": ([[(0, 0), (4, 0), (2, 0), (4, 0), (4, 4), (0, 4)]], 16.0, [5]),
    "shared edge": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(4, 0), (8, 0), (8, 4), (4, 4)]], 32.0, [6]),
    "part of an edge shared": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(4, 1), (8, 1), (8, 3), (4, 3)]], 24.0, [8]),
    "hole outside its shell": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(6, 6), (7, 6), (7, 7), (6, 7)]], 17.0, None),
    "hole across its shell": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(3, 1), (6, 1), (6, 2), (3, 2)]], 17.0, [8, 4]),
    "hole that touches": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 2), (2, 1), (2, 3)]], 14.0, None),
    "twice the same": ([[(0, 0), (4, 0), (4, 4)]] * 2, 0.0, []),
    "three times": ([[(0, 0), (4, 0), (4, 4)]] * 3, 8.0, [3]),
    "five-pointed star": ([[(math.cos(4 * math.pi * k / 5), math.sin(4 * math.pi * k / 5)) for k in range(5)]], None, None),
    "sound": ([[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 2), (2, 2), (2, 1)]], 15.0, None),
}


def area(made):
    return sum(float(np.dot(r[:, 0], np.roll(r[:, 1], -1)) - np.dot(r[:, 1], np.roll(r[:, 0], -1))) / 2 for r in made)


def odd(x, y, shape):
    out = np.zeros(x.shape, bool)
    for r in shape:
        for (ax, ay), (bx, by) in zip(r, [*r[1:], r[0]], strict=True):
            if ay != by:
                out ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


@pytest.mark.parametrize("name", CASES)
def test_repaired_rings_have_the_same_inside(name):
    shape, size, sides = CASES[name]
    made = rings.remade([np.array(r, float) for r in shape])
    if name in ("sound", "hole outside its shell"):
        assert made is None
        return
    x, y = np.random.default_rng(1).uniform(-2, 10, (2, 4000))
    assert (odd(x, y, shape) == odd(x, y, [r.tolist() for r in made])).all()
    assert size is None or area(made) == pytest.approx(size)
    assert sides is None or sorted(map(len, made), reverse=True) == sides
    assert all(rings.cuts(rings.edges([r])) == {} for r in made)  # nothing crosses any more


def test_random_tangles_keep_their_inside():
    g = np.random.default_rng(7)
    for _ in range(20):
        shape = [g.uniform(0, 10, (int(g.integers(3, 14)), 2)) for _ in range(int(g.integers(1, 4)))]
        made = rings.remade(shape)
        made = shape if made is None else made
        x, y = g.uniform(0, 10, (2, 3000))
        assert (odd(x, y, [r.tolist() for r in shape]) == odd(x, y, [r.tolist() for r in made])).all()
        assert rings.cuts(rings.edges(made)) == {}


def test_repaired_shapes_have_exact_areas(spark):
    table = [(name, [[{"x": 100.0 * x, "y": 100.0 * y} for x, y in r] for r in shape], []) for name, (shape, *_) in CASES.items()]
    shapes = spark.createDataFrame(table, "unit string, rings array<array<struct<x: double, y: double>>>, lines array<array<struct<x: double, y: double>>>")
    fixed = rings.repaired(shapes)
    assert {r.unit for r in fixed.collect()} == set(CASES) - {"twice the same"}
    point = spark.createDataFrame([(1, 300.0, 300.0)], "episode_id long, x double, y double")
    got = {r.unit: r.area for r in spatial.overlap_areas(point, fixed, 5000.0, 250.0).collect()}
    assert all(got[name] == pytest.approx(1e4 * size) for name, (_, size, _) in CASES.items() if size)


def test_shapes_between_projections(spark, tmp_path):
    utm, conus = of_epsg(26917), of_epsg(5070)
    lon, lat = np.array([-81.0, -80.5, -80.7]), np.array([29.0, 29.2, 30.0])
    x, y = utm.forward(lon, lat)
    ring = [{"x": float(a), "y": float(b)} for a, b in zip(x, y)]
    shapes = spark.createDataFrame([("a", [ring], []), ("b", [], [ring[:2], ring[1:]]), ("c", [], [])], "unit string, rings array<array<struct<x: double, y: double>>>, lines array<array<struct<x: double, y: double>>>")
    got = {r.unit: r for r in rings.reprojected(shapes, utm, conus).collect()}
    want = np.array(conus.forward(lon, lat)).T
    at = lambda line: np.array([(p.x, p.y) for p in line])
    assert np.allclose(at(got["a"].rings[0]), want, atol=1e-4) and [len(v) for v in got["b"].lines] == [2, 2] and np.allclose(at(got["b"].lines[1]), want[1:], atol=1e-4) and got["c"].rings == []
    (tmp_path / "a.shp").write_bytes(b"")
    assert vector_files.projection_of(str(tmp_path / "a.shp")).kind == "degrees"
    (tmp_path / "a.prj").write_text('PROJCS["x",GEOGCS["y",DATUM["z",SPHEROID["GRS_1980",6378137.0,298.257222101]],UNIT["Degree",0.0174]],PROJECTION["Sinusoidal"],PARAMETER["Central_Meridian",-90.0],UNIT["Meter",1.0]]')
    assert vector_files.projection_of(str(tmp_path / "a.shp")).kind == "sinusoidal"
