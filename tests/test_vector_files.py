"""Shapefiles and GeoPackages written here byte by byte."""

import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from tidegrain import cohort, shared
from tidegrain.sources import rasters, vector_files, vectors

SQUARE, HOLE, PART = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)], [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)], [(9.0, 9.0), (9.0, 10.0), (10.0, 9.0), (9.0, 9.0)]
RECORDS = [
    (5, [SQUARE, HOLE, PART], "Doña Ana", 35013, True, "20200131", False),
    (0, [], "nothing", 1, None, "", False),
    (15, [PART], "Zürich", None, False, "20201231", False),
    (3, [[(0.0, 0.0), (1.0, 1.0)], [(5.0, 5.0), (6.0, 5.0), (7.0, 7.0)]], "roads", -5, None, "", False),
    (11, [[(3.0, 3.5)]], "", 7, None, "", False),
    (5, [SQUARE], "gone", 8, None, "", True),
    (28, [[(1.0, 2.0), (3.0, 4.0)]], "points", 9, None, "", False),
]


def content(kind, parts):
    flat = [p for part in parts for p in part]
    xy = b"".join(struct.pack("<2d", *p) for p in flat)
    if kind == 0:
        return struct.pack("<i", 0)
    if kind == 11:
        return struct.pack("<i", kind) + xy + struct.pack("<2d", 99.0, 1.0)
    box = struct.pack("<4d", min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat))
    if kind == 28:
        return struct.pack("<i", kind) + box + struct.pack("<i", len(flat)) + xy + struct.pack("<4d", 0, 1, 0, 1)
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    tail = struct.pack(f"<{2 + len(flat)}d", 0, 9, *[9.0] * len(flat)) if kind == 15 else b""
    return struct.pack("<i", kind) + box + struct.pack(f"<2i{len(parts)}i", len(parts), len(flat), *starts) + xy + tail


def shapefile(records, page="utf-8", cpg=True, driver=0):
    shp, shx = b"", b""
    for k, (kind, parts, *_) in enumerate(records):
        c = content(kind, parts)
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(c) // 2)
        shp += struct.pack(">2i", k + 1, len(c) // 2) + c
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    fields = [("NAME", "C", 20), ("FIPS", "N", 8), ("OK", "L", 1), ("DAY", "D", 8)]
    start, width = 32 + 32 * len(fields) + 1, 1 + sum(w for *_, w in fields)
    dbf = struct.pack("<4BIHH17xBxx", 3, 120, 1, 1, len(records), start, width, driver)
    dbf += b"".join(n.encode().ljust(11, b"\0") + t.encode() + struct.pack("<4xBB14x", w, 0) for n, t, w in fields) + b"\r"
    for *_, name, fips, ok, day, gone in records:
        dbf += (b"*" if gone else b" ") + name.encode(page).ljust(20) + ("" if fips is None else str(fips)).rjust(8).encode() + {True: b"T", False: b"N", None: b"?"}[ok] + day.ljust(8).encode()
    return {".shp": head(len(shp)) + shp, ".shx": head(len(shx)) + shx, ".dbf": dbf + b"\x1a"} | ({".cpg": page.encode()} if cpg else {})


def put(folder, name, files):
    for suffix, data in files.items():
        (folder / f"{name}{suffix}").write_bytes(data)
    return str(folder / f"{name}.shp")


def rows_of(df):
    at = lambda lines: [[(p.x, p.y) for p in line] for line in lines]
    return {r.properties["FIPS"]: (r.properties, at(r.rings), at(r.lines)) for r in df.collect()}


@pytest.mark.parametrize("records", [1, 3, 100])
def test_shapefile_by_records(spark, tmp_path, records):
    got = rows_of(vector_files.read_vector_files(spark, put(tmp_path, "a", shapefile(RECORDS)), records=records))
    assert set(got) == {"35013", None, "-5", "7", "9"}
    assert got["35013"] == ({"NAME": "Doña Ana", "FIPS": "35013", "OK": "true", "DAY": "2020-01-31"}, [r[:-1] for r in (SQUARE, HOLE, PART)], [])
    assert got[None][0] == {"NAME": "Zürich", "FIPS": None, "OK": "false", "DAY": "2020-12-31"} and got[None][1] == [PART[:-1]]
    assert got["-5"][2] == RECORDS[3][1] and got["7"][2] == [[(3.0, 3.5)]] and got["7"][0]["NAME"] is None and got["9"][2] == [[(1.0, 2.0)], [(3.0, 4.0)]]
    df = vector_files.read_vector_files(spark, str(tmp_path / "a.shp"), records=records)
    assert df.rdd.getNumPartitions() == -(-len(RECORDS) // records)


def test_code_pages_zips_and_folders(spark, tmp_path):
    put(tmp_path, "a", shapefile(RECORDS[:1], "cp850", cpg=False, driver=2))
    put(tmp_path, "b", shapefile(RECORDS[2:3], "latin-1", cpg=False))
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for suffix, data in shapefile(RECORDS[3:5]).items():
            z.writestr(f"c{suffix}", data)
    got = rows_of(vector_files.read_vector_files(spark, str(tmp_path)))
    assert got["35013"][0]["NAME"] == "Doña Ana" and got[None][0]["NAME"] == "Zürich" and got["-5"][2] == RECORDS[3][1]
    assert vector_files.read_vector_files(spark, put(tmp_path, "d", shapefile([]))).count() == 0
    (tmp_path / "d.shx").unlink()
    with pytest.raises(Exception, match="no .shx file"):
        vector_files.read_vector_files(spark, str(tmp_path / "d.shp")).count()


@pytest.mark.parametrize("records", [2, 100])
def test_geopackage_by_row_ids(spark, tmp_path, records):
    con = sqlite3.connect(tmp_path / "p.gpkg")
    con.executescript("create table gpkg_contents (table_name text, data_type text); create table gpkg_geometry_columns (table_name text, column_name text); create table gpkg_other (a int);")
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<2d", *p) for p in r)
    wkb = {1: struct.pack("<BII", 1, 3, 2) + ring(SQUARE) + ring(HOLE), 2: struct.pack("<BI2d", 1, 1, 5.0, 6.0), 3: struct.pack("<BI", 1, 2) + ring([(0.0, 0.0), (1.0, 1.0)])}
    head = lambda envelope, empty=0: b"GP\0" + bytes([1 | envelope << 1 | empty << 4]) + struct.pack("<i", 4326) + b"\0" * {0: 0, 1: 32, 2: 48, 4: 64}[envelope]
    for table in ("places", "it's"):
        con.execute("insert into gpkg_contents values (?, 'features')", (table,))
        con.execute("insert into gpkg_geometry_columns values (?, 'geom')", (table,))
        con.execute(f'create table "{table}" (fid integer primary key, geom blob, FIPS text, pop real)')
    con.executemany("insert into places values (?, ?, ?, ?)", [(1, head(1) + wkb[1], "a", 1.5), (2, head(0) + wkb[2], "b", None), (7, head(4) + wkb[3], "c", 2.0), (9, None, "d", 0.0), (10, head(0, 1) + wkb[2], "e", 0.0)])
    con.commit()
    con.close()
    path = str(tmp_path / "p.gpkg")
    got = rows_of(vector_files.read_vector_files(spark, path, layer="places", records=records))
    assert set(got) == {"a", "b", "c"} and got["a"] == ({"fid": "1", "FIPS": "a", "pop": "1.5"}, [SQUARE[:-1], HOLE[:-1]], []) and got["b"][2] == [[(5.0, 6.0)]] and got["c"][2] == [[(0.0, 0.0), (1.0, 1.0)]]
    assert vector_files.read_vector_files(spark, path, layer="it's").count() == 0
    with pytest.raises(Exception, match="layers of this name: 2"):
        vector_files.read_vector_files(spark, path).count()


def test_holes_are_written_as_holes(spark, tmp_path):
    shapes = vector_files.read_vector_files(spark, put(tmp_path, "a", shapefile(RECORDS))).withColumn("FIPS", F.col("properties")["FIPS"])
    vectors.write_geo(shapes.drop("properties"), str(tmp_path / "g"))
    kinds = {r.FIPS: struct.unpack_from("<II", r.geometry, 1) for r in spark.read.parquet(str(tmp_path / "g")).collect()}
    assert kinds["35013"] == (6, 2) and kinds[None] == (3, 1)
    nested = [[{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b))] for a, b in ((0, 10), (1, 9), (2, 8), (3, 7), (20, 30))]
    assert [[r[0]["x"] for r in p] for p in vectors.polygons_of(nested)] == [[0, 1], [2, 3], [20]]


def test_preconverted_years_replace_themselves(spark, tmp_path):
    cells = spark.createDataFrame([(1, "2019-01-01", 1.0), (2, "2020-01-01", 2.0)], "grid_id int, date string, value double").withColumn("date", F.col("date").cast("date"))
    path = str(tmp_path / "cells")
    for part in (cells, cells, cells.filter("grid_id = 2").withColumn("value", F.lit(3.0))):
        rasters.preconverted(part, path, "uv", F.array(F.lit(1), F.lit(2)))
    assert sorted((r.grid_id, r.value, r.year) for r in spark.read.parquet(path).collect()) == [(1, 1.0, 2019), (2, 3.0, 2020)]


def test_episodes_find_columns_in_any_case(spark):
    df = spark.createDataFrame([("p", "2019-01-01", "2019-02-01", -90.0, 40.0)], "patid string, STARTDATE string, EndDate string, Longitude double, latitude double")
    (r,) = cohort.episodes(df).collect()
    assert (r.pid, str(r.start_date), r.lon) == ("p", "2019-01-01", -90.0)
    with pytest.raises(ValueError, match="no column endDate"):
        cohort.episodes(df.drop("EndDate"))


def test_row_numbers_leave_other_columns_alone(spark):
    df = spark.createDataFrame([(5, 1), (6, 2)], "__part int, __at int")
    assert sorted(map(tuple, shared.numbered(df, "n").collect())) == [(5, 1, 0), (6, 2, 1)]
