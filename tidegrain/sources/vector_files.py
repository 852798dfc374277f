"""Shapefiles and GeoPackages as partitioned tables: (properties map<string, string>, rings, lines), as read_geojson() gives them.

A shapefile's records are dealt by number: the index has eight bytes for each, and the attribute table has records of one width, so a
task reads the bytes of its own records in all three files and nothing else.  A GeoPackage is dealt by row ids, which its table is sorted
by.  The driver reads headers only.  Zipped shapefiles, as the census publishes them, are one task each.  Paths may be local, or of any
store that pyarrow reaches; a GeoPackage in a store is fetched whole by each task that reads from it, a local one is not.

Null shapes, deleted records and empty geometries give no row; third coordinates and measures are dropped; file geodatabases are not read."""

from __future__ import annotations

import codecs
import io
import json
import sqlite3
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.projections import Projection, of_wkt
from .vectors import _SHAPE, _parts, cleaned

#: Records of one task, and of one batch of it.
RECORDS, BATCH = 200_000, 5_000
#: Code pages by the byte in an attribute table's header, for tables without a .cpg file.  Fixed values.
CODE_PAGES = {0x01: "cp437", 0x02: "cp850", 0x03: "cp1252", 0x4D: "cp936", 0x4E: "cp949", 0x4F: "cp950", 0x57: "cp1252", 0x64: "cp852", 0x65: "cp866", 0xC8: "cp1250", 0xC9: "cp1251"}
_POINTS = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
_ARROW = pa.schema([("properties", pa.map_(pa.string(), pa.string())), ("rings", _POINTS), ("lines", _POINTS)])


class _Files:
    """Byte ranges of the files of one shapefile, beside one another or in one zip."""

    def __init__(self, path: str):
        self.store, self.path = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        self.zip = zipfile.ZipFile(io.BytesIO(self.store.open_input_file(self.path).read())) if path.lower().endswith(".zip") else None
        if self.zip:
            (self.stem,) = {n[:-4] for n in self.zip.namelist() if n.lower().endswith(".shp") and not n.startswith("__MACOSX")}
        else:
            self.stem = self.path[:-4]

    def _name(self, suffix: str) -> str | None:
        for name in (self.stem + suffix, self.stem + suffix.upper()):
            if self.zip and name in self.zip.namelist() or not self.zip and self.store.get_file_info(name).type == fs.FileType.File:
                return name
        return None

    def size(self, suffix: str) -> int | None:
        name = self._name(suffix)
        return None if name is None else self.zip.getinfo(name).file_size if self.zip else self.store.get_file_info(name).size

    def read(self, suffix: str, at: int = 0, n: int | None = None) -> bytes:
        name = self._name(suffix)
        if name is None:
            raise FileNotFoundError(f"{self.path}: no {suffix} file")
        with self.zip.open(name) if self.zip else self.store.open_input_file(name) as f:
            f.seek(at)
            return f.read(n) if n is not None else f.read()

    def __len__(self) -> int:
        size = self.size(".shx")
        if size is None:
            raise FileNotFoundError(f"{self.path}: no .shx file")
        return max(0, (size - 100) // 8)


class Attributes:
    """The layout of an attribute table, and the texts of its records."""

    def __init__(self, files: _Files):
        self.fields: list[tuple[str, str, int, int]] = []
        self.known = files.size(".dbf") is not None
        if not self.known:
            return
        head = files.read(".dbf", 0, 32)
        self.rows, self.start, self.width = struct.unpack_from("<IHH", head, 4)
        page = files.read(".cpg").decode("ascii", "ignore").strip() if files.size(".cpg") is not None else ""
        try:
            self.page = codecs.lookup(f"cp{page}" if page.isdigit() else page).name
        except LookupError:
            self.page = CODE_PAGES.get(head[29], "latin-1")
        at, place = files.read(".dbf", 32, self.start - 32), 1
        for k in range(0, len(at) - 31, 32):
            if at[k] == 0x0D:
                break
            kind, wide = chr(at[k + 11]), at[k + 16] + (at[k + 17] << 8 if at[k + 11] == ord("C") else 0)
            self.fields.append((at[k : k + 11].split(b"\0")[0].decode(self.page, "replace"), kind, place, wide))
            place += wide

    def texts(self, data: bytes, k: int) -> list[tuple[str, str | None]] | None:
        """(name, text) of each field of the k-th record in data; None if it is marked as deleted."""
        row = data[k * self.width : (k + 1) * self.width]
        if row[:1] == b"*":
            return None
        out = []
        for name, kind, place, wide in self.fields:
            text: str | None = row[place : place + wide].decode(self.page, "replace").rstrip(" \0")
            if kind in "NFDL":
                text = text.strip().strip("*")
            if kind == "L":
                text = {"T": "true", "Y": "true", "F": "false", "N": "false"}.get(text.upper(), "")
            if kind == "D" and len(text) == 8:
                text = f"{text[:4]}-{text[4:6]}-{text[6:]}" if text.strip("0") else ""
            out.append((name, text or None))
        return out


def shape(data: bytes, at: int = 0) -> tuple[list, list]:
    """(rings, lines) of the content of one record."""
    (kind,) = struct.unpack_from("<i", data, at)
    place = lambda v: [{"x": float(x), "y": float(y)} for x, y in v]
    if kind == 0:
        return [], []
    if kind % 10 == 1 and kind in (1, 11, 21):
        return [], [place([struct.unpack_from("<2d", data, at + 4)])]
    if kind in (8, 18, 28):
        (n,) = struct.unpack_from("<i", data, at + 36)
        return [], [place([p]) for p in np.frombuffer(data, "<f8", 2 * n, at + 40).reshape(-1, 2)]
    if kind not in (3, 5, 13, 15, 23, 25):
        raise ValueError(f"shapes of kind {kind} are not read")
    parts, n = struct.unpack_from("<2i", data, at + 36)
    starts = [*struct.unpack_from(f"<{parts}i", data, at + 44), n]
    v = np.frombuffer(data, "<f8", 2 * n, at + 44 + 4 * parts).reshape(-1, 2)
    pieces = [place(v[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    return (pieces, []) if kind % 10 == 5 else ([], pieces)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


def shapefile_rows(path: str, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """The records first .. last - 1, in batches."""
    files = _Files(path)
    table = Attributes(files)
    for a in range(first, last, BATCH):
        b = min(a + BATCH, last)
        index = np.frombuffer(files.read(".shx", 100 + 8 * a, 8 * (b - a)), ">i4").astype(np.int64).reshape(-1, 2) * 2
        low, high = int(index[:, 0].min()), int((index[:, 0] + index[:, 1]).max()) + 8
        data = files.read(".shp", low, high - low)
        texts = files.read(".dbf", table.start + table.width * a, table.width * (b - a)) if table.known else b""
        rows = []
        for k, (at, _) in enumerate(index.tolist()):
            said = table.texts(texts, k) if table.known else []
            if said is not None:
                rows.append((said, *shape(data, at - low + 8)))
        yield _batch(rows)


def projection_of(path: str) -> Projection:
    """The projection that a shapefile's .prj file tells; without one, degrees."""
    files = _Files(path)
    return of_wkt(files.read(".prj").decode("utf-8", "replace")) if files.size(".prj") is not None else Projection("degrees")


def _package(path: str) -> sqlite3.Connection:
    if "://" not in path:
        return sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    store, at = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return sqlite3.connect(f"file:{at}?mode=ro&immutable=1", uri=True)
    con = sqlite3.connect(":memory:")
    con.deserialize(store.open_input_file(at).read())
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layer_of(con: sqlite3.Connection, layer: str | None) -> tuple[str, str]:
    """(table, geometry column) of a layer; without a name the only one."""
    found = con.execute("select c.table_name, g.column_name from gpkg_contents c join gpkg_geometry_columns g on c.table_name = g.table_name where c.data_type = 'features'").fetchall()
    found = [r for r in found if layer in (None, r[0])]
    if len(found) != 1:
        raise ValueError(f"layers of this name: {len(found)}; name one of them")
    return found[0]


def package_geometry(blob: bytes | None) -> tuple[list, list]:
    """(rings, lines) of a geometry with a package's header."""
    if not blob or blob[:2] != b"GP" or blob[3] & 0x10:
        return [], []
    return _parts(blob, 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7])[:2]


def package_rows(path: str, layer: str | None, first: int, last: int) -> Iterator[pa.RecordBatch]:
    con = _package(path)
    table, column = layer_of(con, layer)
    rows = con.execute(f"select * from {_quoted(table)} where rowid between ? and ? order by rowid", (first, last))
    names = [d[0] for d in rows.description]
    at = names.index(column)
    text = lambda v: v if v is None or isinstance(v, str) else v.hex() if isinstance(v, bytes) else str(v)
    while part := rows.fetchmany(BATCH):
        yield _batch([([(n, text(v)) for n, v in zip(names, r, strict=True) if n != column], *package_geometry(r[at])) for r in part])


class _Split(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths, self.layer = json.loads(options["paths"]), options.get("layer")
        self.records = int(options.get("records", RECORDS))

    def partitions(self) -> list[_Split]:
        out = []
        for path in self.paths:
            if path.lower().endswith(".gpkg"):
                con = _package(path)
                table, _ = layer_of(con, self.layer)
                low, high = con.execute(f"select min(rowid), max(rowid) from {_quoted(table)}").fetchone()
                out += [_Split(path, a, min(a + self.records - 1, high)) for a in range(low, high + 1, self.records)] if low is not None else []
            else:
                n = len(_Files(path))
                step = n if path.lower().endswith(".zip") else self.records
                out += [_Split(path, a, min(a + step, n)) for a in range(0, n, max(1, step))]
        return out or [_Split("", 0, 0)]

    def read(self, part: _Split) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return iter(())
        return package_rows(part.path, self.layer, part.first, part.last) if part.path.lower().endswith(".gpkg") else shapefile_rows(part.path, part.first, part.last)


class VectorFiles(DataSource):
    """format("tidegrain_vectors"), options: paths (a JSON list), layer, records (of one task)."""

    @classmethod
    def name(cls) -> str:
        return "tidegrain_vectors"

    def schema(self) -> str:
        return f"properties map<string, string>, {_SHAPE}"

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def _listed(path: str) -> list[str]:
    """The files of a folder, or the path itself."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if store.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    head = path.split("://")[0] + "://" if "://" in path and not isinstance(store, fs.LocalFileSystem) else ""
    return sorted(head + f.path for f in store.get_file_info(fs.FileSelector(at)) if f.path.lower().endswith((".shp", ".gpkg", ".zip")))


def read_vector_files(spark: SparkSession, *paths: str, layer: str | None = None, records: int = RECORDS) -> DataFrame:
    """(properties, rings, lines) of shapefiles (.shp, .zip) and GeoPackages, or folders of them."""
    spark.dataSource.register(VectorFiles)
    options = {"paths": json.dumps([f for p in paths for f in _listed(p)]), "records": str(records)} | ({"layer": layer} if layer else {})
    return cleaned(spark.read.format("tidegrain_vectors").options(**options).load())
