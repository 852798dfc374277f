"""What is measured once for each place."""

import pytest
from pyspark.sql import functions as F

from tidegrain.operators import places, spatial

SQUARE = "unit string, rings array<array<struct<x double, y double>>>"


def _square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


@pytest.fixture
def crowd(spark):
    """1000 episodes at 4 places, one without a place and one with two."""
    many = spark.range(1000).selectExpr("id as episode_id", "double(id % 4) * 100 as x", "double(50) as y")
    return many.union(spark.createDataFrame([(2000, None, 1.0), (2001, 0.0, 50.0), (2001, 300.0, 50.0)], "episode_id long, x double, y double"))


def test_a_place_is_measured_once(crowd):
    seen = []

    def measure(spots):
        seen.append(spots.count())
        return spots.groupBy("episode_id").agg(F.sum("x").alias("total"), F.count("x").alias("n"))

    got = {r.episode_id: (r.total, r.n) for r in places.by_place(crowd, measure).collect()}
    assert seen == [4 + 1 + 2] and len(got) == 1002
    assert got[3] == (300.0, 1) and got[2000] == (None, 0) and got[2001] == (300.0, 2)


def test_operators_by_place_give_every_episode_its_rows(spark, crowd):
    squares = spark.createDataFrame([("a", [_square(-200.0, -200.0, 300.0)]), ("b", [_square(150.0, 0.0, 120.0)])], SQUARE)
    for f in (spatial.overlap_weights, spatial.overlap_shares):
        got = f(crowd, squares, 100.0).groupBy("episode_id").agg(F.sum("weight").alias("w")).collect()
        assert {r.episode_id for r in got} == {*range(1000), 2001} and all(r.w == pytest.approx(1.0) for r in got)
    far = {r.episode_id: r.distance for r in spatial.proximity(crowd, polygons=squares).collect()}
    assert len(far) == 1002 and far[2000] is None and far[2001] == 0.0 and far[3] == pytest.approx(30.0) and far[7] == far[3]


def test_rectangles_are_measured_as_other_polygons_are(spark):
    points = spark.range(300).selectExpr("id as episode_id", "double(id) * 2.7 - 300 as x", "double(id % 7) * 41.3 as y")
    box, hole = _square(10.3, -20.1, 200.0), _square(60.0, 30.0, 90.0)
    plain = [("box", [box]), ("ring", [box, hole]), ("turned", [hole[::-1], box]), ("two", [box, _square(500.0, 0.0, 50.0)])]
    # a vertex more on a side: no rectangle any more
    bent = [(u, [[*r[:1], ((r[0][0] + r[1][0]) / 2, (r[0][1] + r[1][1]) / 2), *r[1:]] for r in rings]) for u, rings in plain]
    ask = lambda shapes: {(r.episode_id, r.unit): r.area for r in spatial.overlap_areas(points, spark.createDataFrame(shapes, SQUARE), 150.0).collect()}
    got, want = ask(plain), ask(bent)
    assert got == pytest.approx(want, abs=1e-5) and len(got) > 60
