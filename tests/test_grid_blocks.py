"""GeoTIFF and NetCDF files written here byte by byte, read block by block."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrain.sources import grid_blocks, rasters, readers


def lzw(data):
    """Codes of growing width, the table begun anew when it is full."""
    bits, n = 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = bits << width | code, n + width

    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = len(table) + 2
        width = max(width, (len(table) + 2).bit_length() if len(table) + 1 in (511, 1023, 2047) else width)
        if len(table) + 1 == 4094:
            put(256, width)
            table, width = {bytes([k]): k for k in range(256)}, 9
        word = data[k : k + 1]
    if word:
        put(table[word], width)
        if len(table) + 2 in (511, 1023, 2047):
            width += 1
    put(257, width)
    pad = -n % 8
    return (bits << pad).to_bytes((n + pad) // 8, "big")


def tiff(a, tile=0, packing=1, predictor=1, big=False, order="<", nodata=None, planar=1, rows=3):
    """A GeoTIFF of (rows, columns, bands) in either size of the format."""
    h, w, bands = a.shape
    bw, bh = (tile, tile) if tile else (w, rows)
    blocks = []
    for band in range(bands) if planar == 2 else [slice(None)]:
        for y in range(0, h, bh):
            for x in range(0, w, bw):
                b = a[y : y + bh, x : x + bw, band].reshape(min(bh, h - y), min(bw, w - x), -1)
                if tile:
                    b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.diff(b, axis=1, prepend=np.zeros_like(b[:, :1])).astype(a.dtype)
                raw = b.astype(a.dtype.newbyteorder(order)).tobytes()
                if predictor == 3:
                    size = a.dtype.itemsize
                    planes = np.frombuffer(b.astype(a.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(b.shape[0], -1, size).transpose(0, 2, 1).reshape(b.shape[0], -1, b.shape[2])
                    raw = np.diff(planes, axis=1, prepend=np.zeros_like(planes[:, :1])).astype(np.uint8).tobytes()
                blocks.append({1: bytes, 5: lzw, 8: zlib.compress}[packing](raw))
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * a.dtype.itemsize] * bands), (259, 3, [packing]), (277, 3, [bands]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * bands),
            (33550, 12, [0.25, 0.25, 0.0]), (33922, 12, [0.0, 0.0, 0.0, -100.0, 40.0, 0.0])]
    tags += [(322, 4, [bw]), (323, 4, [bh])] if tile else [(278, 4, [bh])]
    if nodata is not None:
        tags.append((42113, 2, str(nodata).encode() + b"\0"))
    head, long_ = (16, 16) if big else (8, 4)
    body, at = b"", []
    for b in blocks:
        at.append(head + len(body))
        body += b
    tags += [(324 if tile else 273, long_, at), (325 if tile else 279, long_, [len(b) for b in blocks])]
    entries, whole = b"", 8 if big else 4
    for tag, code, values in sorted(tags, key=lambda t: t[0]):
        data = values if isinstance(values, bytes) else struct.pack(order + {3: "H", 4: "I", 12: "d", 16: "Q"}[code] * len(values), *values)
        if len(data) > whole:
            place, body = head + len(body), body + data
            data = struct.pack(order + ("Q" if big else "I"), place)
        entries += struct.pack(order + ("HHQ" if big else "HHI"), tag, code, len(values)) + data.ljust(whole, b"\0")
    mark = {"<": b"II", ">": b"MM"}[order]
    first = struct.pack(order + "HHHQ", 43, 8, 0, head + len(body)) if big else struct.pack(order + "HI", 42, head + len(body))
    return mark + first + body + struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * whole


CASES = [
    (0, 5, 1, False, "<", "u1", 1), (16, 5, 2, False, "<", "i2", 1), (16, 8, 3, False, "<", "f4", 1), (16, 5, 3, True, "<", "f8", 1), (0, 1, 1, True, ">", "u2", 1), (32, 8, 1, True, "<", "f4", 2), (0, 8, 2, False, ">", "i4", 2),
]


@pytest.mark.parametrize("tile,packing,predictor,big,order,kind,planar", CASES)
def test_tiffs(spark, tmp_path, tile, packing, predictor, big, order, kind, planar):
    a = (np.random.default_rng(1).integers(0, 120, (41, 50, 2)) + np.arange(50)[None, :, None]).astype(kind)
    a[0, 0, 1] = 250
    data = tiff(a, tile, packing, predictor, big, order, 250, planar)
    assert all((rasters.band_of(data, b) == a[..., b - 1]).all() for b in (1, 2)) and rasters.grid_of(data) == rasters.Grid(-100.0, 40.0, 0.25, 50, 41, 2, 250.0)
    (tmp_path / "a.tif").write_bytes(data)
    found = spark.createDataFrame([(str(tmp_path / "a.tif"),)], "path string")
    got = {r.grid_id: r.value for r in grid_blocks.grid_cells(spark, found, 2).collect()}
    assert got == {k: float(v) for k, v in enumerate(a[..., 1].ravel()) if k}
    wanted = spark.createDataFrame([(1,), (51,), (2050,), (2051,), (-3,)], "grid_id long")
    assert {r.grid_id: r.value for r in grid_blocks.grid_cells(spark, found, 2, wanted, 1).collect()} == {51: float(a[1, 0, 1]), 2050: float(a[40, 49, 1])}


def test_long_lzw_runs_through_all_widths():
    data = np.random.default_rng(2).integers(0, 64, 40_000, dtype=np.uint8).tobytes() + b"\0" * 9000
    assert grid_blocks.lzw(lzw(data)) == data and grid_blocks.lzw(lzw(b"")) == b""


def netcdf(version, dims, variables, records=0):
    """dims: [(name, size)], size 0 for records; variables: {name: (dimension numbers, attributes, type code, array)}."""
    count = (lambda n: struct.pack(">q", n)) if version == 5 else (lambda n: struct.pack(">i", n))
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: count(len(s)) + pad(s.encode())
    kinds = {3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
    attributes = lambda d: struct.pack(">i", 12) + count(len(d)) + b"".join(name(k) + struct.pack(">i", c) + count(len(v) if c == 2 else 1) + pad(v.encode() if c == 2 else np.array(v, kinds[c]).tobytes()) for k, (c, v) in d.items()) if d else b"\0" * 4 + count(0)
    lone = sum(dims[d[0]][1] == 0 for d, *_ in variables.values()) == 1

    def build(places):
        out = b"CDF" + bytes([version]) + count(records) + struct.pack(">i", 10) + count(len(dims)) + b"".join(name(n) + count(s) for n, s in dims) + attributes({"title": (2, "made here")}) + struct.pack(">i", 11) + count(len(variables))
        for n, (d, held, code, a) in variables.items():
            size = np.dtype(kinds[code]).itemsize * int(np.prod([dims[k][1] for k in d if dims[k][1]]))
            out += name(n) + count(len(d)) + b"".join(count(k) for k in d) + attributes(held) + struct.pack(">i", code) + count(-(-size // 4) * 4) + (struct.pack(">q", places[n]) if version > 1 else struct.pack(">i", places[n]))
        return out

    at, places, body = len(build(dict.fromkeys(variables, 0))), {}, b""
    for n, (d, _, code, a) in variables.items():
        if dims[d[0]][1]:
            places[n] = at + len(body)
            body += pad(a.astype(kinds[code]).tobytes())
    rec = [n for n, (d, *_) in variables.items() if not dims[d[0]][1]]
    for r in range(records):
        for n in rec:
            if r == 0:
                places[n] = at + len(body)
            raw = variables[n][3][r].astype(kinds[variables[n][2]]).tobytes()
            body += raw if lone else pad(raw)
    return build(places) + body


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("form", ["plain", "records", "lon first"])
def test_netcdf_of_two_weeks(spark, tmp_path, version, form, monkeypatch):
    monkeypatch.setattr(grid_blocks, "BAND", 60)
    a = np.random.default_rng(5).normal(size=(21, 30)).astype("f4")  # row 0 is the north
    a[3, 4] = np.nan
    south = a[::-1]
    dims, lat = [("time", 0), ("lat", 21), ("lon", 30)], np.linspace(20, 30, 21)
    held = {"_FillValue": (5, -999.0)}
    if form == "plain":
        variables = {"lat": ([1], {}, 6, lat), "lon": ([2], {}, 5, np.arange(30.0)), "PM25": ([1, 2], held, 5, south), "other": ([1, 2], {}, 3, south)}
    elif form == "records":
        variables = {"PM25": ([0, 1, 2], held, 5, np.stack([south, south + 1])), "time": ([0], {}, 4, np.arange(2)), "lat": ([1], {}, 6, lat)}
    else:
        variables = {"lat": ([1], {}, 6, lat), "PM25": ([2, 1], held, 5, south.T)}
    for name in ("V5.2019001-2019014.nc", "V5.2012001-2012014.nc", "V5.2020001-2020014.nc", "V5.nodate.nc"):
        (tmp_path / name).write_bytes(netcdf(version, dims, variables, 2 if form == "records" else 0))
    got = {r.grid_id: (r.value, str(r.start_date), str(r.end_date)) for r in readers.acag_netcdf(spark, str(tmp_path)).collect()}
    assert got == {k + 1: (float(v), "2019-01-01", "2019-01-14") for k, v in enumerate(a.ravel()) if not np.isnan(v)}
    wanted = spark.createDataFrame([(1,), (95,), (630,), (700,)], "grid_id long")
    some = readers.acag_netcdf(spark, str(tmp_path), "pm25", [2019, 2020], wanted, "PM25").collect()
    assert sorted((r.grid_id, r.pm25, str(r.start_date)) for r in some) == sorted((k, float(a.ravel()[k - 1]), d) for k in (1, 630) for d in ("2019-01-01", "2020-01-01"))


def test_only_blocks_with_wanted_cells_are_read(spark, tmp_path):
    a = np.arange(64 * 64, dtype="f4").reshape(64, 64, 1)
    (tmp_path / "a.tif").write_bytes(tiff(a, 16, 8))
    blocks = grid_blocks.block_table(spark, spark.createDataFrame([(f"file://{tmp_path}/a.tif",)], "path string"))
    wanted = spark.createDataFrame([(0,), (1,), (64 * 17,), (64 * 64 - 1,)], "grid_id long")
    kept = grid_blocks.wanted_blocks(blocks, wanted)
    assert blocks.count() == 16 and sorted((r.row, r.col) for r in kept.collect()) == [(0, 0), (16, 0), (48, 48)]
    size = lambda df: df.agg(F.sum("size")).first()[0]
    assert size(kept) < 0.25 * size(blocks)
    assert {r.grid_id for r in grid_blocks.block_cells(spark, kept).collect()} >= {0, 1, 64 * 17, 64 * 64 - 1}
