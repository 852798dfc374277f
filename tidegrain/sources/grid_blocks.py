"""Grids in files as tables of blocks: where in the file each block of cells lies.  Only blocks that hold a wanted cell are read.

block_table() reads the headers, one row for each block: the tiles or strips of a GeoTIFF (also over 4 GB), bands of rows of a variable of a
classic NetCDF file (versions 1, 2 and 5), chunks of an HDF5 file.  It is a table like any other, so which blocks are read is a semi-join with the blocks of the
wanted cells, and the blocks that are left, of all files together, are dealt over the tasks, which read their byte ranges.

Cells count row by row from the north-west corner whatever the order in the file: rows of ascending latitudes are turned over, and a variable
(lon, lat) is taken as (lat, lon).  Paths may be local, or of any store that pyarrow reaches.  HDF5 files, which NetCDF-4 files are, give the
chunks of a variable (hdf5.py).  HDF4 has no decoder here."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.recode import no_data
from ..shared import partitions
from .hdf5 import hdf5_blocks, unfiltered

#: Cells of a band of rows of a NetCDF variable; layouts of blocks that the files of one call may have.
BAND, LAYOUTS = 65_536, 100
#: Sizes and codes of the types of TIFF fields, kinds of samples, and types of NetCDF values.  Fixed values.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 11: (4, "f"), 12: (8, "d"), 13: (4, "I"), 16: (8, "Q"), 18: (8, "Q")}
SAMPLES = {1: "u", 2: "i", 3: "f"}
NETCDF = {1: "i1", 2: "S1", 3: "i2", 4: "i4", 5: "f4", 6: "f8", 7: "u1", 8: "u2", 9: "u4", 10: "i8", 11: "u8"}
Read = Callable[[int, int], bytes]


def opened(path: str) -> Read:
    """A function (place, length) -> bytes of a file."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    f = store.open_input_file(at)

    def read(place: int, n: int) -> bytes:
        return f.read_at(n, place)

    return read


def tiff_fields(read: Read) -> tuple[str, dict[int, tuple]]:
    """(byte order, fields of the first image), in both sizes of the format."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    version = struct.unpack_from(order + "H", head, 2)[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    count, width, whole = ("Q", 20, 8) if big else ("H", 12, 4)
    (at,) = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)
    (n,) = struct.unpack(order + count, read(at, struct.calcsize(count)))
    entries, found = read(at + struct.calcsize(count), n * width), {}
    for k in range(n):
        tag, kind, many = struct.unpack_from(order + ("HHQ" if big else "HHI"), entries, k * width)
        if kind not in FIELDS:
            continue
        size, code = FIELDS[kind]
        value = entries[k * width + width - whole : (k + 1) * width]
        if size * many > whole:
            value = read(struct.unpack(order + ("Q" if big else "I"), value)[0], size * many)
        found[tag] = (value[:many],) if code == "s" else struct.unpack_from(order + code * many, value)
    return order, found


def lzw(data: bytes) -> bytes:
    """The dictionary coding of TIFF: codes of 9 to 12 bits, the highest bit first, each width ending one code early."""
    out, at, bits, width, held, last = [], 0, 0, 9, 0, b""
    table = [bytes([k]) for k in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        at = held >> bits
        held &= (1 << bits) - 1
        if at == 256:
            table, width, last = table[:258], 9, b""
        elif at == 257:
            break
        else:
            now = table[at] if at < len(table) else last + last[:1]
            out.append(now)
            if last:
                table.append(last + now[:1])
                width = 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
            last = now
    return b"".join(out)


def unpacked(raw: bytes, packing: int | list[int], size: int = 1) -> bytes:
    """The bytes of a block: packing is a compression of TIFF or the list of an HDF5 chunk's filters, for values of `size` bytes."""
    if isinstance(packing, list):
        return unfiltered(raw, packing, size)
    if packing not in (1, 5, 8, 32946):
        raise ValueError(f"no decoder for compression {packing}")
    return raw if packing == 1 else lzw(raw) if packing == 5 else zlib.decompress(raw)


def samples(raw: bytes, kind: np.dtype, w: int, inner: int, predictor: int) -> np.ndarray:
    """(rows, w, inner) of an unpacked block, its predictor undone."""
    row = w * inner * kind.itemsize
    rows = len(raw) // row
    if predictor == 3:  # differences of bytes, the highest bytes of a row's numbers first
        b = np.frombuffer(raw, np.uint8, rows * row).reshape(rows, -1, inner)
        b = np.cumsum(b, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, w * inner)
        return np.ascontiguousarray(b.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, w, inner)
    if predictor not in (1, 2):
        raise ValueError(f"no decoder for predictor {predictor}")
    block = np.frombuffer(raw, kind, rows * w * inner).reshape(rows, w, inner)
    return np.cumsum(block, axis=1, dtype=kind) if predictor == 2 else block


def _tiff_blocks(read: Read, band: int) -> tuple[dict, list[tuple[int, int, int, int]]]:
    """(layout, (place, size, row, column) of each block)."""
    order, f = tiff_fields(read)
    width, height, n, planar = f[256][0], f[257][0], f.get(277, (1,))[0], f.get(284, (1,))[0]
    if not 1 <= band <= n:
        raise ValueError(f"no band {band} of {n}")
    w, h = (f[322][0], f[323][0]) if 322 in f else (width, min(f.get(278, (height,))[0], height))
    starts, sizes = (f[324], f[325]) if 322 in f else (f[273], f[279])
    across, down = -(-width // w), -(-height // h)
    skip = across * down * (band - 1) if planar == 2 else 0
    mark = f[42113][0].split(b"\0")[0].strip() if 42113 in f else b""
    layout = {"width": width, "height": height, "w": w, "h": h, "kind": f"{order}{SAMPLES[f.get(339, (1,))[0]]}{f[258][0] // 8}", "inner": n if planar == 1 else 1, "pick": band - 1 if planar == 1 else 0,
              "packing": f.get(259, (1,))[0], "predictor": f.get(317, (1,))[0], "nodata": float(mark) if mark else None, "turn": False, "swap": False}
    return layout, [(starts[skip + k], sizes[skip + k], k // across * h, k % across * w) for k in range(across * down) if sizes[skip + k]]


class NetCdf:
    """The header of a classic NetCDF file: dimensions, and variables by name with (dimensions, attributes, type, place)."""

    def __init__(self, read: Read):
        self.read, self.at = read, 0
        self.data = read(0, 1 << 16)
        magic = self._bytes(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.wide, self.far = magic[3] == 5, magic[3] > 1
        self.records = self._count()
        self.dims = [(self._name(), self._count()) for _ in range(self._list(10))]
        self._attributes()
        self.variables: dict[str, tuple[list[int], dict, str, int]] = {}
        sizes = {}
        for _ in range(self._list(11)):
            name, dims = self._name(), [self._count() for _ in range(self._count())]
            held, kind, size = self._attributes(), NETCDF[self._int()], self._count()
            self.variables[name] = (dims, held, ">" + kind, self._number(8 if self.far else 4))
            if dims and self.dims[dims[0]][1] == 0:
                sizes[name] = size
        only = next(iter(sizes), None)
        width = lambda n: int(np.prod([self.dims[d][1] for d in self.variables[n][0][1:]])) * np.dtype(self.variables[n][2]).itemsize
        #: Bytes from one record to the next; a lone record variable is not padded.
        self.record = width(only) if len(sizes) == 1 else sum(-(-width(n) // 4) * 4 for n in sizes)

    def _bytes(self, n: int) -> bytes:
        while self.at + n > len(self.data):
            more = self.read(len(self.data), max(n, len(self.data)))
            if not more:
                raise ValueError("the header ends early")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def _number(self, n: int) -> int:
        return int.from_bytes(self._bytes(n), "big")

    def _int(self) -> int:
        return self._number(4)

    def _count(self) -> int:
        return self._number(8 if self.wide else 4)

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._count()
        if found not in (0, tag):
            raise ValueError("the header has no list where one should be")
        return n

    def _padded(self, n: int) -> bytes:
        return self._bytes(-(-n // 4) * 4)[:n]

    def _name(self) -> str:
        return self._padded(self._count()).decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(12)):
            name, kind, n = self._name(), NETCDF[self._int()], self._count()
            raw = self._padded(n * np.dtype(kind).itemsize)
            out[name] = raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, ">" + kind).tolist()
        return out

    def shape(self, name: str) -> list[tuple[str, int]]:
        return [(self.dims[d][0], self.dims[d][1] or self.records) for d in self.variables[name][0]]

    def values(self, name: str) -> np.ndarray:
        """A whole variable of one dimension, such as a coordinate."""
        dims, _, kind, place = self.variables[name]
        n, size = self.shape(name)[0][1], np.dtype(kind).itemsize
        if self.dims[dims[0]][1]:
            return np.frombuffer(self.read(place, n * size), kind)
        return np.concatenate([np.frombuffer(self.read(place + k * self.record, size), kind) for k in range(n)])


def _netcdf_blocks(read: Read, variable: str | None, masked: bool) -> tuple[dict, list[tuple[int, int, int, int]]]:
    """Blocks of the first plane of a variable; without a name of the first one that is no coordinate."""
    n = NetCdf(read)
    dims = {d for d, _ in n.dims}
    name = variable or next((v for v in n.variables if v not in dims and len(n.variables[v][0]) >= 2), None)
    if name not in n.variables:
        raise ValueError(f"no variable {name}; there are {', '.join(n.variables)}")
    held, kind, place = n.variables[name][1:]
    shape = n.shape(name)
    (a, rows), (b, cols) = shape[-2:]
    swap = (a, b) in (("lon", "lat"), ("longitude", "latitude"))
    latitude = next((c for c in ("lat", "latitude") if c in n.variables), None)
    lat = n.values(latitude) if latitude else np.zeros(0)
    turn, size = bool(len(lat) > 1 and lat[0] < lat[-1]), np.dtype(kind).itemsize
    fill = (held.get("_FillValue") or held.get("missing_value")) if masked else None
    # a plane of the file has `rows` runs of `cols` values; if it is (lon, lat), a run is a column of the grid
    step = n.record if len(shape) == 2 and n.dims[n.variables[name][0][0]][1] == 0 else cols * size
    band = max(1, BAND // cols) if step == cols * size else 1
    width, height = (rows, cols) if swap else (cols, rows)
    layout = {"width": width, "height": height, "w": band if swap else width, "h": height if swap else band, "kind": kind, "inner": 1, "pick": 0, "packing": 1, "predictor": 1,
              "nodata": float(fill[0]) if fill else None, "turn": turn, "swap": swap}
    return layout, [(place + k * step, min(band, rows - k) * cols * size, 0 if swap else k, k if swap else 0) for k in range(0, rows, band)]


def block_table(spark: SparkSession, found: DataFrame, part: int | str | None = 1, masked: bool = False) -> DataFrame:
    """found(path) -> (path, layout, block, place, size, row, col): part is a band of a GeoTIFF or the name of a NetCDF variable.
    masked: a NetCDF variable's fill values are missing; else they are numbers like others."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                read = opened(path)
                name = part if isinstance(part, str) else None
                magic = read(0, 4)
                if magic[:2] in (b"II", b"MM"):
                    made = [_tiff_blocks(read, int(part or 1))]
                else:
                    made = [_netcdf_blocks(read, name, masked)] if magic[:3] == b"CDF" else hdf5_blocks(read, name, masked, BAND)
                for layout, rows in made:
                    out = pd.DataFrame(rows, columns=["place", "size", "row", "col"])
                    across = -(-layout["width"] // layout["w"])
                    yield out.assign(path=path, layout=json.dumps(layout, sort_keys=True), block=out.row // layout["h"] * across + out.col // layout["w"])

    return found.select("path").repartition(partitions(spark), "path").mapInPandas(heads, "path string, layout string, block long, place long, size long, row int, col int")


def wanted_blocks(blocks: DataFrame, wanted: DataFrame, offset: int = 0) -> DataFrame:
    """The blocks that hold a cell of wanted(grid_id)."""
    layouts = [r[0] for r in blocks.select("layout").distinct().limit(LAYOUTS + 1).collect()]  # headers only
    if len(layouts) > LAYOUTS:
        raise ValueError(f"more than {LAYOUTS} layouts of blocks")
    out = None
    for text in layouts:
        g = json.loads(text)
        at = F.col("grid_id").cast("long") - offset
        row, col = F.floor(at / g["width"]), at % g["width"]
        if g["turn"]:
            row = g["height"] - 1 - row
        block = F.floor(row / g["h"]) * (-(-g["width"] // g["w"])) + F.floor(col / g["w"])
        mine = wanted.filter((at >= 0) & (at < g["width"] * g["height"])).select(F.lit(text).alias("layout"), block.alias("block")).distinct()
        out = mine if out is None else out.unionByName(mine)
    return blocks if out is None else blocks.join(out, ["layout", "block"], "left_semi")


def block_cells(spark: SparkSession, blocks: DataFrame, offset: int = 0) -> DataFrame:
    """(path, grid_id, value) of the cells of these blocks that have data."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, read, text, g = None, None, None, {}
        for batch in batches:
            for p, layout, place, size, row, col in batch[["path", "layout", "place", "size", "row", "col"]].itertuples(index=False):
                if p != path:
                    path, read = p, opened(p)
                if layout != text:
                    text, g = layout, json.loads(layout)
                kind = np.dtype(g["kind"])
                raw = unpacked(read(int(place), int(size)), g["packing"], kind.itemsize)
                if isinstance(g["packing"], list):
                    raw = raw[: g["w"] * g["h"] * kind.itemsize]  # of planes in one chunk the first
                if g["swap"]:
                    v = samples(raw, kind, g["h"], 1, 1)[..., 0].T
                else:
                    v = samples(raw, kind, g["w"], g["inner"], g["predictor"])[..., g["pick"]]
                v = v[: g["height"] - row, : g["width"] - col].astype(np.float64)
                if g["nodata"] is not None:
                    v[np.isclose(v, g["nodata"])] = np.nan
                i, j = np.nonzero(~np.isnan(v))
                at = g["height"] - 1 - (row + i) if g["turn"] else row + i
                yield pd.DataFrame({"path": p, "grid_id": at.astype(np.int64) * g["width"] + col + j + offset, "value": v[i, j]})

    dealt = blocks.repartition(partitions(spark), "path", "block").sortWithinPartitions("path", "place")
    return dealt.mapInPandas(decode, "path string, grid_id long, value double").select("path", "grid_id", no_data(F.col("value")).alias("value"))


def grid_cells(spark: SparkSession, found: DataFrame, part: int | str | None = 1, wanted: DataFrame | None = None, offset: int = 0, keep: tuple[str, ...] = (), name: str = "value", masked: bool = False) -> DataFrame:
    """found(path, *keep) -> (*keep, grid_id, name): cells with data, row by row from the north-west corner, from `offset`.
    wanted(grid_id): only these; blocks without any are not read."""
    cells = None if wanted is None else wanted.select("grid_id").distinct()
    blocks = block_table(spark, found, part, masked)
    out = block_cells(spark, blocks if cells is None else wanted_blocks(blocks, cells, offset), offset).withColumnRenamed("value", name)
    out = out if cells is None else out.join(cells, "grid_id", "left_semi")
    return (out.join(F.broadcast(found.select("path", *keep)), "path") if keep else out).select(*keep, "grid_id", name)  # one row for each file
