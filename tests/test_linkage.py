"""Identities that hold for any cohort, and small fixtures of known results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrain import cohort, queries
from tidegrain.functions import dates, recode, weighted
from tidegrain.operators import engine, spatial
from tidegrain.plans import patterns
from tidegrain.plans import spatial as plans_spatial
from tidegrain.sources import tables

DATA = "/root/testdata/sf0.001"


def test_participant_is_the_day_weighted_episode(spark):
    r = queries.Roles(spark, DATA)
    whole = patterns.yearly_areal(r.episodes, r.weights, r.yearly, ["v"]).toPandas().set_index("pid").v
    parts = patterns.yearly_areal(r.episodes, r.weights, r.yearly, ["v"], "episode", days_suffix="_d").toPandas().dropna()
    parts["x"] = parts.v * parts.v_d
    sums = parts.groupby("pid")[["x", "v_d"]].sum()
    assert np.allclose(whole.dropna().sort_index(), (sums.x / sums.v_d).sort_index(), rtol=1e-9)


def test_result_does_not_depend_on_partitions(spark):
    r = queries.Roles(spark, DATA)
    one, many = (patterns.static_areal(r.episodes.repartition(n), r.weights.repartition(n), r.static, ["v"]).toPandas().set_index("pid").v for n in (1, 17))
    assert np.allclose(one.sort_index(), many.sort_index(), rtol=1e-12, equal_nan=True)


def test_raise_policy_raises(spark):
    df = spark.createDataFrame([(1, None, 1.0)], "k int, v double, w double")
    with pytest.raises(Exception, match="missing value"):
        df.groupBy("k").agg(weighted.weighted_mean(F.col("v"), F.col("w"), "raise")).collect()


def test_blank_dates_give_no_days(spark):
    df = spark.createDataFrame([("2020-01-01", None)], "a string, b string").select(F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    assert df.select(dates.overlap_days(F.col("a"), F.col("b"), F.col("a"), F.col("a")).alias("d")).first().d is None
    eps = df.selectExpr("'p' as pid", "0L as episode_id", "a as start_date", "b as end_date")
    assert patterns.episode_years(eps).count() == 0 and engine.stays(eps).count() == 0


def test_albers_published_example(spark):
    clarke = (6378206.4, 1 - 6356583.8 / 6378206.4)
    x, y = spatial.albers(F.lit(-75.0), F.lit(35.0), lat_0=23.0, ellipsoid=clarke)
    row = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(row.x - 1885472.7) < 0.1 and abs(row.y - 1535925.0) < 0.1


def test_disk_cells_cover_the_disk(spark):
    p = spark.createDataFrame([(1, 1000.3, 987.1), (2, 0.0, 0.0)], "episode_id long, x double, y double")
    areas = spatial.disk_cells(p, 270.0, 25.0).groupBy("episode_id").agg(F.sum("area").alias("a"), F.max("area").alias("m")).collect()
    assert all(abs(r.a - math.pi * 270**2) < 1e-3 and r.m <= 625.0001 for r in areas)


def test_overlap_weights_two_boxes_and_any_cohort(spark):
    box = lambda a, b: [[(float(x), float(y)) for x, y in ((a, 0), (b, 0), (b, 3000), (a, 3000))]]
    polys = spark.createDataFrame([("A", box(0, 1013)), ("B", box(1013, 3000))], "unit string, rings array<array<struct<x: double, y: double>>>")
    one = spark.createDataFrame([(1, 1000.0, 1000.0)], "episode_id long, x double, y double")
    two = one.unionByName(spark.createDataFrame([(2, 8300.0, 1000.0)], one.schema))
    a, b = ({r.unit: r.weight for r in spatial.overlap_weights(p, polys).filter("episode_id = 1").collect()} for p in (one, two))
    assert set(a) == {"A", "B"} and abs(sum(a.values()) - 1) < 1e-9 and a == pytest.approx(b)


def test_grid_weights_sum_to_one(spark):
    p = spark.createDataFrame([(1, 1000.0, 1000.0)], "episode_id long, x double, y double")
    rows = spatial.grid_weights(p, 0.0, 3000.0, 100.0, 30, 30).collect()
    assert abs(sum(r.weight for r in rows) - 1) < 1e-9
    centre = sum(r.weight * (r.unit % 30 + 0.5) for r in rows) * 100, 3000 - sum(r.weight * (r.unit // 30 + 0.5) for r in rows) * 100
    assert centre == pytest.approx((1000, 1000))


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pts, seg = rng.uniform(0, 50_000, (40, 2)), rng.uniform(0, 50_000, (25, 4))
    seg[:, 2:] = seg[:, :2] + rng.normal(0, 3000, (25, 2))
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "episode_id long, x double, y double")
    lines = spark.createDataFrame([tuple(map(float, s)) for s in seg], "x1 double, y1 double, x2 double, y2 double")
    got = {r.episode_id: r.distance for r in spatial.nearest(points, lines, cell=500.0).collect()}

    def far(p, s):
        d = s[2:] - s[:2]
        t = np.clip(((p - s[:2]) @ d) / (d @ d), 0, 1)
        return np.linalg.norm(s[:2] + t * d - p)

    assert got == pytest.approx({i: min(far(p, s) for s in seg) for i, p in enumerate(pts)})


def test_filters_keep_missing_values_on_exclude(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert df.filter(recode.feature_filter(F.col("x"), ["a"], exclude=True)).count() == 1
    assert df.filter(recode.condition({"x": {"ne": "a"}})).count() == 1


def test_padded_never_truncates(spark):
    got = [r.c for r in spark.createDataFrame([("7",), ("1234567",), (None,)], "x string").select(recode.padded(F.col("x")).alias("c")).collect()]
    assert got == ["00007", "1234567", None]


def test_flags_with_missing_inputs(spark):
    df = spark.createDataFrame([(600.0, None), (None, 0.1), (1.0, 0.1)], "lapop1 double, lapop1share double")
    assert [r.LATracts1 for r in recode.food_access_flags(df).collect()] == [1, None, 0]


def test_validate_counts(spark):
    bad = spark.createDataFrame([("", "8/9/2017", "8/1/2017", "-200", "40"), ("a", "8/9/2017", None, "x", "40")], "pid string, startDate string, endDate string, longitude string, latitude string")
    got = {r["check"]: r.n for r in cohort.validate(bad).collect()}
    assert got == {"pid_missing": 1, "coord_range": 1, "coord_not_numeric": 1, "date_order": 1, "date_missing": 1}
    assert cohort.validate(bad.drop("pid")).first()["check"] == "missing_columns"


def test_episodes_and_coverage(spark):
    df = spark.createDataFrame([("00002", "8/9/2017", "8/19/2017", -90.0, 40.0), ("x", "1/1/2008", "1/2/2008", -155.0, 20.0)], "pid string, startDate string, endDate string, longitude double, latitude double")
    eps = cohort.episodes(df)
    assert [(r.pid, r.episode_id) for r in eps.orderBy("episode_id").collect()] == [("00002", 0), ("x", 1)]
    r = cohort.coverage(eps, {"ndi": (2013, 2019), "noise": (None, None)}).collect()
    assert [(x.in_time, x.in_region, x.covered, x.pct) for x in r] == [(1, 1, 1, 50.0), (2, 1, 1, 50.0)]


def test_tables_round_trip_and_clean(spark, tmp_path):
    (tmp_path / "t.csv").write_text("code,year,v\n1001,2015,1.5\n 1002,2016,N/A\n")
    raw = tables.read_table(spark, str(tmp_path / "t.csv"))
    out = tables.registered_table(raw, "code", 5, ["v"], year="year")
    assert [tuple(r) for r in out.orderBy("unit").collect()] == [("01001", 2015, 1.5), ("01002", 2016, None)]
    tables.write_table(out, str(tmp_path / "t.parquet"))
    assert tables.read_table(spark, str(tmp_path / "t.parquet")).count() == 2
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.doc")


def test_periods_from_names(spark):
    df = spark.createDataFrame([("2013001-2013014.nc",), ("x_201304-201306.tif",), ("d20150102.hdf",), ("v2016.csv",)], "n string")
    a, b = tables.period_from_name(F.col("n"))
    assert [(str(r.a), str(r.b)) for r in df.select(a.alias("a"), b.alias("b")).collect()] == [("2013-01-01", "2013-01-14"), ("2013-04-01", "2013-06-30"), ("2015-01-02", "2015-01-02"), ("2016-01-01", "2016-12-31")]


def test_merge_renames_clashes(spark):
    c = spark.createDataFrame([(1, 0.5)], "episode_id int, ndi double")
    p = spark.createDataFrame([(1, 0.7)], "episode_id int, ndi double")
    assert patterns.merge([p], ["episode_id"], c, ["bg"]).columns == ["episode_id", "ndi", "ndi_bg_dup"]


@pytest.mark.parametrize("by", [[], ["category"]])
def test_nearest_takes_all_orders(spark, by):
    r = queries.Roles(spark, "/root/testdata/sf0.001")
    people = queries._placed(r.t("orders"), "o_orderkey").select("o_orderkey", "x", "y").toPandas()
    shops = queries._placed(r.t("supplier").join(r.t("nation"), F.col("s_nationkey") == F.col("n_nationkey")), "s_suppkey").select("n_regionkey", "x", "y").toPandas()
    got = queries.QUERIES["n1_nearest_by_category_all" if by else "n1_nearest_all"](spark, "/root/testdata/sf0.001").collect()
    groups = shops.n_regionkey.unique() if by else [None]
    want = {}
    for g in groups:
        own = shops[shops.n_regionkey == g] if by else shops
        for k, x, y in people.itertuples(index=False):
            want[k, g] = ((own.x - x) ** 2 + (own.y - y) ** 2).min() ** 0.5
    assert len(got) == len(want) == len(people) * len(groups)
    assert all(abs(row.distance - want[row.episode_id, row.category if by else None]) < 0.01 for row in got)


def _star(x, y, r, n, seed):
    g = np.random.default_rng(seed)
    a, far = np.sort(g.uniform(0, 2 * math.pi, n)), g.uniform(0.3, 1, n) * r
    return list(zip((x + far * np.cos(a)).tolist(), (y + far * np.sin(a)).tolist(), strict=True))


RINGS = "unit string, rings array<array<struct<x: double, y: double>>>"


def _inside(x, y, rings):
    """Even-odd rule in numpy, over all edges."""
    odd = np.zeros(np.shape(x), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            if ay != by:
                odd ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd


def test_tiles_hold_what_the_polygon_holds(spark):
    shapes = [("star", [_star(0, 0, 4000, 60, 1), _star(0, 0, 900, 12, 2)]), ("box", [[(-2500.0, -2500.0), (3000.0, -2500.0), (3000.0, 2000.0), (-2500.0, 2000.0)]]), ("thin", [[(0.0, 0.0), (5000.0, 10.0), (0.0, 20.0)]]), ("box", [[(100.0, 100.0), (200.0, 100.0), (200.0, 200.0)]])]
    shapes.append(shapes[0])  # a repeated row
    polygons = spark.createDataFrame(shapes, RINGS)
    g = np.random.default_rng(3)
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(g.uniform(-4500, 5500, (400, 2)))]
    at = spark.createDataFrame(places, "episode_id long, x double, y double").withColumns({"tx": F.floor(F.col("x") / 500), "ty": F.floor(F.col("y") / 500)})
    held = at.join(spatial.tiled(polygons, 500.0, "unit"), ["tx", "ty"]).filter(F.col("whole") | spatial.odd_crossings(F.col("x"), F.col("y"), F.col("edges")))
    got = {(r.episode_id, r.unit) for r in held.collect()}
    want = {(k, unit) for unit, rings in shapes for k, x, y in places if _inside(x, y, rings)}
    assert got == want and len(want) > 100


def test_exact_areas_and_shares_against_a_fine_grid(spark):
    shapes = [("star", [_star(0, 0, 1500, 40, 1), _star(0, 0, 200, 9, 2)]), ("box", [[(400.0, -300.0), (1300.0, -300.0), (1300.0, 100.0), (400.0, 100.0)]]), ("far", [[(1900.0, -900.0), (2600.0, -900.0), (2600.0, 900.0), (1900.0, 900.0)]])]
    g = np.random.default_rng(4)
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(g.uniform(-1200, 1900, (25, 2)))]
    radius, fine = 600.0, 4.0
    points = spark.createDataFrame([*places, (99, None, 0.0)], "episode_id long, x double, y double")
    got = {(r.episode_id, r.unit): r.area for r in spatial.overlap_areas(points, spark.createDataFrame(shapes, RINGS), radius, 500.0).collect()}
    i = np.arange(-radius + fine / 2, radius, fine)
    dx, dy = (v[(np.add.outer(i**2, i**2) <= radius**2).ravel()] for v in (c.ravel() for c in np.meshgrid(i, i)))
    want = {(k, u): float(_inside(x + dx, y + dy, rings).sum() * fine**2) for k, x, y in places for u, rings in shapes}
    assert all(abs(got.get(key, 0.0) - a) < 0.004 * math.pi * radius**2 for key, a in want.items()) and len(got) > 30
    boxes = {u: (min(x for r in rings for x, _ in r), max(x for r in rings for x, _ in r), min(y for r in rings for _, y in r), max(y for r in rings for _, y in r)) for u, rings in shapes}
    near = lambda a, b: boxes[b][0] <= boxes[a][1] + 500 and boxes[b][1] >= boxes[a][0] - 500 and boxes[b][2] <= boxes[a][3] + 500 and boxes[b][3] >= boxes[a][2] - 500
    shares = {(r.episode_id, r.unit): r.weight for r in spatial.overlap_shares(points, spark.createDataFrame(shapes, RINGS), radius, 500.0).collect()}
    assert shares == pytest.approx({(k, u): a / sum(b for (m, v), b in got.items() if m == k and near(u, v)) for (k, u), a in got.items()})
    assert not near("box", "far") and any((k, "box") in got and (k, "far") in got for k, *_ in places)


def test_a_hot_tile_is_dealt_in_packs(spark, monkeypatch):
    from tidegrain.operators import overlap

    polygons = spark.createDataFrame([("a", [_star(500, 500, 400, 30, 5)]), ("b", [_star(600, 500, 400, 30, 6)])], RINGS)
    points = spark.range(300).selectExpr("id as episode_id", "400 + id % 17 * 10.3 as x", "400 + id % 13 * 11.1 as y").withColumns({c: F.col(c).cast("double") for c in ("x", "y")})
    ask = lambda: [{(r.episode_id, r.unit): r.weight for r in f(points, polygons).collect()} for f in (spatial.overlap_weights, spatial.overlap_shares)]
    whole = ask()
    monkeypatch.setattr(overlap, "PACK", 20)
    assert overlap._packs(points, 270.0, 1000.0).count() >= 15
    assert all(a == pytest.approx(b) for a, b in zip(whole, ask(), strict=True)) and len(whole[0]) >= 300


def test_nearest_with_a_hot_cell_of_features_and_one_of_points(spark):
    rng = np.random.default_rng(8)
    hot = rng.uniform(0, 200, (100_000, 2)) + [40_000, 40_000]
    lone = rng.uniform(-400_000, 400_000, (50, 2))
    at = np.concatenate([rng.uniform(39_000, 41_000, (150, 2)), rng.uniform(-300_000, 300_000, (150, 2)), np.full((700, 2), 123.25)])
    feats = spark.createDataFrame(pd.DataFrame(np.concatenate([hot, lone]), columns=["x1", "y1"])).withColumns({"x2": F.col("x1"), "y2": F.col("y1"), "kind": F.when((F.col("x1") * 8).cast("long") % 3 == 0, "a").when((F.col("x1") * 8).cast("long") % 3 == 1, "b")})
    points = spark.createDataFrame(pd.DataFrame({"episode_id": range(1000), "x": at[:, 0], "y": at[:, 1]}))
    every, kind = np.concatenate([hot, lone]), np.fix(np.concatenate([hot, lone])[:, 0] * 8).astype(int)
    kind = np.where(kind < 0, -((-kind) % 3), kind % 3)  # the remainder has the sign of the number
    far = np.hypot(at[:, None, 0] - every[None, :, 0], at[:, None, 1] - every[None, :, 1])
    got = {r.episode_id: r.distance for r in spatial.nearest(points, feats).collect()}
    assert got == pytest.approx(dict(enumerate(far.min(axis=1).tolist())))
    by = {(r.episode_id, r.kind): r.distance for r in spatial.nearest(points, feats, by=["kind"]).collect()}
    names = {0: "a", 1: "b"}
    want = {(k, name): far[k][[names.get(v) == name for v in kind.tolist()]].min() for name in ("a", "b", None) for k in range(0, 1000, 7)}
    assert {k: v for k, v in by.items() if k in want} == pytest.approx(want) and len(by) == 3000


def test_nearest_splits_hot_cells(spark):
    from tidegrain.shared import Scratch

    at = spark.range(5000).select(F.col("id").alias("episode_id"), (F.col("id") % 100 * 1.0).alias("x"), F.lit(7.0).alias("y"))
    feats = spark.range(3000).select((F.col("id") * 0.01).alias("x1"), F.lit(0.0).alias("y1")).withColumns({"x2": F.col("x1"), "y2": F.col("y1")})
    scratch = Scratch(spark, "test")
    leaves = spatial._leaves(at, feats, [250.0, 1000.0], 4, scratch).groupBy("level", "lx", "ly", "packs").count().collect()
    scratch.drop()
    assert [r.packs for r in leaves] == [10] and leaves[0].level == 0


def test_county_of_a_road_file(spark):
    df = spark.createDataFrame([("46113", 2014), ("46113", 2015), ("46113", None), ("12001", 2020), (None, 2015)], "county string, year int")
    assert [r[0] for r in df.select(recode.road_county(F.col("county"), F.col("year"))).collect()] == ["46113", "46102", "46113", "12001", None]
    rows = plans_spatial.road_files(df.filter("county is not null and year is not null")).orderBy("county", "year").collect()
    assert [r.name for r in rows] == ["tl_2020_12001_roads.zip", "tl_2014_46113_roads.zip", "tl_2015_46102_roads.zip"]


@pytest.mark.parametrize("level", ["participant", "episode"])
def test_linking_sources_together_is_linking_each(spark, level):
    from tidegrain.plans import link
    from tidegrain.queries_link import five_variables

    r, calls = queries.Roles(spark, DATA), []
    got = five_variables(r, level, calls).toPandas()
    keys = engine.keys(level)
    singles = {
        "poor": patterns.yearly_areal(r.episodes, r.weights, r.yearly, ["v"], level).withColumnRenamed("v", "poor"), "old": patterns.yearly_areal(r.episodes, r.weights, r.yearly, ["v2"], level).withColumnRenamed("v2", "old"),
        "shade": patterns.static_areal(r.episodes, r.weights, r.static, ["v2"], level).withColumnRenamed("v2", "shade"), "dust": patterns.gridded(r.episodes, r.weights, r.daily, ["v2"], level).withColumnRenamed("v2", "dust"),
    }
    assert calls == [1] and list(got.columns) == [*keys, "poor", "old", "walk", "shade", "dust"]
    for name, one in singles.items():
        both = got[[*keys, name]].merge(one.toPandas(), on=keys, how="left", suffixes=("", "_alone"))
        assert len(both) == len(got) and np.allclose(both[name], both[f"{name}_alone"], equal_nan=True) and both[name].notna().any()
    everyone = r.episodes.toPandas()
    assert got[keys[-1]].tolist() == (everyone.sort_values("episode_id").pid.drop_duplicates().tolist() if level == "participant" else sorted(everyone.episode_id))
    sources = [link.Source(n, g, k, r.yearly, {"v": "v"}) for n, g, k in (("a", "tracts", "yearly"), ("b", "cells", "static"), ("c", "tracts", "yearly"), ("d", "tracts", "static"))]
    steps = link.plan(sources)
    assert [(s.what, s.geography, s.kind) for s in steps] == [("weights", "tracts", ""), ("weights", "cells", ""), ("values", "tracts", "yearly"), ("values", "cells", "static"), ("values", "tracts", "static")]
    assert steps[2].columns == {"a": {"v": "v"}, "c": {"v": "v_c_dup"}}
    for bad, said in ((sources[:1] * 2, "two sources"), ([], "no sources"), ([link.Source("a", "g", "hourly", r.yearly, {})], "not one of"), ([link.Source("a", "g", "daily", r.yearly, {"v": "v"})], "no column date")):
        with pytest.raises(ValueError, match=said):
            link.plan(bad)
    with pytest.raises(ValueError, match="no geography"):
        link.link(r.episodes, r.episodes, sources, {})


def test_kept_weights_are_made_once(spark, tmp_path):
    from tidegrain.plans import link

    calls = []
    points = spark.createDataFrame([(1, -96.0, 37.5), (2, -96.001, 37.5)], "episode_id long, lon double, lat double")
    stays = spark.createDataFrame([("p", 1, "2019-01-01", "2019-01-10"), ("q", 2, "2019-01-01", "2019-01-10")], "pid string, episode_id long, start_date string, end_date string").withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    shape = spark.createDataFrame([("a", [[(-1000.0, -1000.0), (1000.0, -1000.0), (1000.0, 1000.0), (-1000.0, 1000.0)]])], RINGS)

    def counted(p):
        calls.append(1)
        return link.polygons(shape, "square").make(p)

    values = spark.createDataFrame([("a", 2.5)], "unit string, v double")
    ask = lambda: link.link(stays, points, [link.Source("s", "square", "static", values, {"v": "v"})], {"square": link.Geography(counted, {"polygons": "square"})}, folder=str(tmp_path / "kept")).collect()
    assert [(r.pid, r.v) for r in ask()] == [("p", 2.5), ("q", 2.5)] == [(r.pid, r.v) for r in ask()] and calls == [1]
