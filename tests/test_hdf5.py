"""HDF5 files written here byte by byte in both forms of headers, read as grids by chunk."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrain.sources import grid_blocks, readers
from tidegrain.sources.hdf5 import Hdf5

NONE = b"\xff" * 8
KINDS = {"f": (1, 0x20), "i": (0, 8), "u": (0, 0)}


class File:
    """Bytes of a file; structures are appended and known by their place."""

    def __init__(self, new, user=0):
        self.new, self.user = new, user
        self.out = bytearray(b"\0" * (96 if not new else 48))

    def put(self, data):
        at = len(self.out)
        self.out += data + b"\0" * (-len(data) % 8)
        return at

    def header(self, messages):
        """An object header in two pieces, the second one by a continuation."""
        if self.new:
            pack = lambda k, d: struct.pack("<BHB", k, len(d), 0) + d
            rest = b"OCHK" + b"".join(pack(*m) for m in messages[1:]) + b"sum!"
            far = self.put(rest)
            body = pack(*messages[0]) + pack(0x10, struct.pack("<QQ", far, len(rest)))
            return self.put(b"OHDR" + bytes([2, 0x21]) + b"time" * 4 + struct.pack("<H", len(body)) + body + b"sum!")
        pack = lambda k, d: struct.pack("<HHB3x", k, len(d) + -len(d) % 8, 0) + d + b"\0" * (-len(d) % 8)
        rest = b"".join(pack(*m) for m in messages[1:])
        far = self.put(rest)
        body = pack(*messages[0]) + pack(0x10, struct.pack("<QQ", far, len(rest)))
        return self.put(struct.pack("<BxHII4x", 1, len(messages) + 1, 1, len(body)) + body)

    def tree(self, kind, leaves, key, fan):
        """A b-tree of version 1 over (key, child) with at most `fan` entries in a node."""
        level = 0
        while True:
            nodes = []
            for k in range(0, len(leaves), fan):
                part = leaves[k : k + fan]
                body = b"".join(a + struct.pack("<Q", c) for a, c in part) + b"\0" * key
                nodes.append((part[0][0], self.put(b"TREE" + struct.pack("<BBH", kind, level, len(part)) + NONE + NONE + body)))
            if len(nodes) == 1:
                return nodes[0][1]
            leaves, level = nodes, level + 1

    def variable(self, a, chunk=None, filters=(), fill=None, keep=lambda at: True, raw=()):
        """raw: chunks (by number) whose deflate was left out; keep: which chunks are in the file."""
        size, (group, bits) = a.dtype.itemsize, KINDS[a.dtype.kind]
        order = a.dtype.str[0] == ">"
        space = struct.pack("<BBB5x", 1, a.ndim, 0) if not self.new else struct.pack("<BBBB", 2, a.ndim, 0, 1)
        space += struct.pack(f"<{a.ndim}Q", *a.shape)
        kind = struct.pack("<BBBBI", 0x10 | group, bits | order, 0, 0, size) + b"\0" * (12 if group else 4)
        messages = [(0x01, space), (0x03, kind)]
        if fill is not None:
            value = np.array(fill, a.dtype).tobytes()
            messages.append((0x05, struct.pack("<BB", 3, 0x20 | 9) + struct.pack("<I", size) + value if self.new else struct.pack("<BBBBI", 2, 3, 2, 1, size) + value))
        if chunk is None:
            messages.append((0x08, struct.pack("<BBQQ", 3, 1, self.put(a.tobytes()), a.nbytes)))
            return self.header(messages)
        leaves = []
        for n, at in enumerate(np.ndindex(*(-(-s // c) for s, c in zip(a.shape, chunk, strict=True)))):
            first = [i * c for i, c in zip(at, chunk, strict=True)]
            if not keep(first):
                continue
            block = np.full(chunk, 7, a.dtype)
            part = a[tuple(slice(f, f + c) for f, c in zip(first, chunk, strict=True))]
            block[tuple(slice(0, s) for s in part.shape)] = part
            data, mask = block.tobytes(), 0
            for i, f in enumerate(filters):
                if f == 2:
                    data = np.frombuffer(data, np.uint8).reshape(-1, size).T.tobytes()
                elif f == 1 and n in raw:
                    mask |= 1 << i
                elif f == 1:
                    data = zlib.compress(data)
                else:
                    data += b"csum"
            leaves.append((struct.pack(f"<II{a.ndim + 1}Q", len(data), mask, *first, 0), self.put(data)))
        tree = self.tree(1, leaves, 8 + 8 * (a.ndim + 1), 3) if leaves else None
        messages.append((0x08, struct.pack("<BBB", 3, 2, a.ndim + 1) + (NONE if tree is None else struct.pack("<Q", tree)) + struct.pack(f"<{a.ndim + 1}I", *chunk, size)))
        if filters:
            pipe = b""
            for f in filters:
                values = [size] if f == 2 else [5] if f == 1 else []
                name = b"" if self.new else b"deflate\0"
                pipe += struct.pack("<H", f) + (struct.pack("<H", len(name)) if not self.new or f > 255 else b"") + struct.pack("<HH", 1, len(values)) + name + struct.pack(f"<{len(values)}I", *values)
                pipe += b"\0" * (4 if len(values) % 2 and not self.new else 0)
            messages.append((0x0B, (bytes([2, len(filters)]) if self.new else bytes([1, len(filters)]) + b"\0" * 6) + pipe))
        return self.header(messages)

    def group(self, members):
        if self.new:
            links = [(0x02, struct.pack("<BB", 0, 1) + b"\0" * 8 + NONE + NONE)]
            for k, (name, at) in enumerate(members.items()):
                links.append((0x06, struct.pack("<BBQBB", 1, 0x14, k, 1, len(name)) + name.encode() + struct.pack("<Q", at)))
            return self.header(links)
        names, places = b"\0" * 8, {}
        for name in sorted(members):
            places[name] = len(names)
            names += name.encode() + b"\0" * (8 - len(name) % 8)
        heap = self.put(b"HEAP\0\0\0\0" + struct.pack("<QQQ", len(names), 1, self.put(names)))
        ordered, leaves = sorted(members), []
        for k in range(0, len(ordered), 2):
            part = ordered[k : k + 2]
            node = b"SNOD\1\0" + struct.pack("<H", len(part)) + b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in part)
            leaves.append((struct.pack("<Q", places[part[0]]), self.put(node)))
        return self.header([(0x11, struct.pack("<QQ", self.tree(0, leaves, 8, 2), heap)), (0, b"")])

    def bytes(self, root):
        mark = b"\x89HDF\r\n\x1a\n"
        if self.new:
            head = mark + bytes([2, 8, 8, 0]) + struct.pack("<QQQQ", self.user, 2**64 - 1, len(self.out), root) + b"sum!"
        else:
            head = mark + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", 4, 16, 0) + struct.pack("<Q", self.user) + NONE + struct.pack("<Q", len(self.out)) + NONE + struct.pack("<QQII16x", 0, root, 1, 0)
        self.out[: len(head)] = head
        return b"\1" * self.user + bytes(self.out)


def north(kind="f4"):
    return np.random.default_rng(3).integers(1, 90, (21, 30)).astype(kind)


def saved(tmp_path, name, data):
    (tmp_path / name).write_bytes(data)
    return str(tmp_path / name)


def cells(spark, path, part=None, **more):
    return {r.grid_id: r.value for r in grid_blocks.grid_cells(spark, spark.createDataFrame([(path,)], "path string"), part, **more).collect()}


@pytest.mark.parametrize("new", [False, True])
@pytest.mark.parametrize("form", ["plain", "chunks", "planes", "lon first"])
def test_grids_of_both_forms(spark, tmp_path, new, form, monkeypatch):
    monkeypatch.setattr(grid_blocks, "BAND", 60)
    f, a = File(new, 512 if form == "chunks" else 0), north()
    a[3, 4] = -999
    south = a[::-1].copy()
    made = {"lat": f.variable(np.linspace(20, 30, 21)), "lon": f.variable(np.arange(30.0), (7,), (1,))}
    if form == "plain":
        made["PM25"] = f.variable(south, fill=-999)
    elif form == "chunks":
        made["PM25"] = f.variable(south, (8, 7), (2, 1, 3), -999, raw=(0, 5))
    elif form == "planes":
        made["PM25"] = f.variable(np.stack([south, south + 1, south + 2]), (2, 8, 30), (2, 1), -999)
    else:
        made["PM25"] = f.variable(south.T.astype(">f4"), (9, 8), (1,), -999)
    made["deep"] = f.group({"u": f.variable(north("i2"), (21, 30))})
    path = saved(tmp_path, "a.nc", f.bytes(f.group(made)))
    want = {k: float(v) for k, v in enumerate(a.ravel())}
    assert cells(spark, path) == want and cells(spark, path, "PM25") == want
    assert cells(spark, path, masked=True) == {k: v for k, v in want.items() if v != -999}
    assert cells(spark, path, "deep/u") == {k: float(v) for k, v in enumerate(north("i2").ravel())}
    wanted = spark.createDataFrame([(0,), (94,), (629,), (700,)], "grid_id long")
    assert cells(spark, path, wanted=wanted) == {k: want[k] for k in (0, 94, 629)}


@pytest.mark.parametrize("kind", ["u1", "<i2", ">i4", "<u8", ">f8", "f2"])
def test_types(spark, tmp_path, kind):
    f = File(True)
    path = saved(tmp_path, "a.h5", f.bytes(f.group({"v": f.variable(north(kind), (10, 10), (2, 1))})))
    assert cells(spark, path) == {k: float(v) for k, v in enumerate(north(kind).ravel())}


def test_missing_chunks_have_no_cells_and_unread_ones_cost_nothing(spark, tmp_path):
    f, a = File(False), np.arange(64 * 64, dtype="f4").reshape(64, 64)
    path = saved(tmp_path, "a.nc", f.bytes(f.group({"v": f.variable(a, (16, 16), (1,), keep=lambda at: at[0] != 32)})))
    assert cells(spark, path) == {k: float(k) for k in range(64 * 64) if not 32 <= k // 64 < 48}
    blocks = grid_blocks.block_table(spark, spark.createDataFrame([(path,)], "path string"), "v")
    wanted = spark.createDataFrame([(0,), (1,), (64 * 17,), (64 * 40,), (64 * 64 - 1,)], "grid_id long")
    kept = grid_blocks.wanted_blocks(blocks, wanted)
    assert blocks.count() == 12 and sorted((r.row, r.col) for r in kept.collect()) == [(0, 0), (16, 0), (48, 48)]
    size = lambda df: df.agg(F.sum("size")).first()[0]
    assert size(kept) < 0.4 * size(blocks)


def test_two_week_files(spark, tmp_path):
    for name in ("V5.2019001-2019014.nc", "V5.2012001-2012014.nc", "V5.nodate.nc"):
        f = File(True)
        made = {"lat": f.variable(np.linspace(20, 30, 21)), "GWRPM25": f.variable(north()[::-1].copy(), (8, 8), (2, 1), 0.0)}
        saved(tmp_path, name, f.bytes(f.group(made)))
    got = {r.grid_id: (r.pm25, str(r.start_date), str(r.end_date)) for r in readers.acag_netcdf(spark, str(tmp_path), "pm25").collect()}
    assert got == {k + 1: (float(v), "2019-01-01", "2019-01-14") for k, v in enumerate(north().ravel())}


def test_what_is_refused():
    def opened(data):
        return Hdf5(lambda at, n: data[at : at + n])

    with pytest.raises(ValueError, match="not an HDF5 file"):
        opened(b"CDF\1" + b"\0" * 3000)
    f = File(True)
    odd = f.variable(np.arange(4.0), (2,), (32001,))
    file = opened(f.bytes(f.group({"odd": odd, "even": f.variable(np.arange(4.0))})))
    assert file.variables()["even"].values().tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError, match="32001"):
        file.variables()["odd"].readable()
    heap = f.header([(0x02, bytes([0, 0]) + struct.pack("<QQ", 64, 64)), (0, b"")])
    with pytest.raises(ValueError, match="fractal heap"):
        opened(f.bytes(heap)).variables()
