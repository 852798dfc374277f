"""Headers of HDF5 files, which NetCDF-4 files are: where each chunk of a variable lies and how it was packed.

Read are superblocks 0 to 3, object headers 1 and 2 with their continuations, groups by symbol tables or by compact links, whole
variables and variables in chunks under the b-tree of version 1, with shuffle, deflate and checksums, each chunk with the filters
that it has passed.  Groups with links in a fractal heap, other chunk indices (files written for the latest library only), other
filters and types that are no numbers are refused by name."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
#: Kinds of header messages.  Fixed values.
SPACE, LINK_INFO, TYPE, OLD_FILL, FILL, LINK, LAYOUT, FILTERS, CONTINUED, SYMBOLS = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x08, 0x0B, 0x10, 0x11
#: Filters.  Fixed values.
DEFLATE, SHUFFLE, CHECKSUM = 1, 2, 3

Read = Callable[[int, int], bytes]


class Cursor:
    """Little-endian numbers of some bytes, one after the other."""

    def __init__(self, data: bytes, far: int = 8, wide: int = 8):
        self.data, self.at, self.far, self.wide = data, 0, far, wide

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("an HDF5 structure ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int | None:
        """A place in the file; None if undefined."""
        n = self.number(self.far)
        return None if n == (1 << 8 * self.far) - 1 else n

    def length(self) -> int:
        return self.number(self.wide)

    @property
    def left(self) -> int:
        return len(self.data) - self.at


class Hdf5:
    """A file's groups and variables; places are those of the file, the superblock's base added."""

    def __init__(self, read: Read):
        start = next((k for k in (0, *(512 << i for i in range(12))) if read(k, 8) == SIGNATURE), None)
        if start is None:
            raise ValueError("not an HDF5 file")
        head = read(start, 128)
        version = head[8]
        if version > 3:
            raise ValueError(f"no decoder for an HDF5 superblock of version {version}")
        self.far, self.wide = (head[9], head[10]) if version > 1 else (head[13], head[14])
        c = self._cursor(head[{0: 24, 1: 28}.get(version, 12) :])
        base = c.address() or 0
        self.read = lambda place, n: read(base + place, n)
        self.base = base
        c.take((2 if version > 1 else 3) * self.far)
        if version < 2:
            c.take(self.far)  # the name of the root
        self.root = c.address()

    def _cursor(self, data: bytes) -> Cursor:
        return Cursor(data, self.far, self.wide)

    def messages(self, place: int) -> list[tuple[int, bytes]]:
        """(kind, body) of the messages of an object."""
        head = self.read(place, 64)
        if head[:4] == b"OHDR":
            flags, at = head[5], 6 + 16 * bool(head[5] & 0x20) + 4 * bool(head[5] & 0x10)
            many = 1 << (flags & 3)
            todo = [(place + at + many, int.from_bytes(head[at : at + many], "little"))]
            lead, trail, ordered = 4, 4, bool(flags & 4)
        elif head[0] == 1:
            todo, lead, trail, ordered = [(place + 16, struct.unpack_from("<I", head, 8)[0])], 0, 0, None
        else:
            raise ValueError("no HDF5 object header where one should be")
        out, first = [], True
        while todo:
            at, n = todo.pop(0)
            body = self.read(at, n)
            if lead and not first:
                if body[:4] != b"OCHK":
                    raise ValueError("no continuation of an HDF5 header where one should be")
                body = body[lead : n - trail]
            first = False
            c = self._cursor(body)
            while c.left >= (8 if ordered is None else 6 if ordered else 4):
                kind, size = (c.number(2), c.number(2)) if ordered is None else (c.number(1), c.number(2))
                flag = c.number(1)
                c.take(3 if ordered is None else 2 if ordered else 0)
                data = c.take(size)
                if kind == CONTINUED:
                    more = self._cursor(data)
                    todo.append((more.address(), more.length()))
                elif kind in (SPACE, TYPE, FILL, FILTERS) and flag & 2:
                    raise ValueError("no decoder for shared HDF5 messages")
                else:
                    out.append((kind, data))
        return out

    def _table(self, tree: int, heap: int) -> Iterator[tuple[str, int]]:
        """(name, place) of the members of a group by a symbol table."""
        c = self._cursor(self.read(heap, 8 + 2 * self.wide + self.far))
        if c.take(4) != b"HEAP":
            raise ValueError("no HDF5 heap where one should be")
        c.take(4)
        size = c.length()
        c.length()
        names = self.read(c.address(), size)
        todo = [tree]
        while todo:
            place = todo.pop(0)
            kind = self.read(place, 4)
            if kind == b"TREE":
                todo = [child for _, child in self._node(place, self.wide)[1]] + todo
                continue
            if kind != b"SNOD":
                raise ValueError("no HDF5 group node where one should be")
            n = struct.unpack("<H", self.read(place + 6, 2))[0]
            e = self._cursor(self.read(place + 8, n * (2 * self.far + 24)))
            for _ in range(n):
                at, member = e.number(self.far), e.address()
                e.take(24)
                yield names[at : names.index(b"\0", at)].decode(), member

    def _node(self, place: int, key: int) -> tuple[int, list[tuple[bytes, int]]]:
        """(level, (key, child) of each entry) of a node of a b-tree of version 1."""
        head = self.read(place, 8)
        if head[:4] != b"TREE":
            raise ValueError("no HDF5 b-tree where one should be")
        n = struct.unpack_from("<H", head, 6)[0]
        c = self._cursor(self.read(place + 8 + 2 * self.far, n * (key + self.far)))
        return head[5], [(c.take(key), c.address()) for _ in range(n)]

    def members(self, place: int) -> dict[str, int]:
        """Members of a group, in the order in which the file has them."""
        out: dict[str, int] = {}
        for kind, body in self.messages(place):
            c = self._cursor(body)
            if kind == SYMBOLS:
                out.update(self._table(c.address(), c.address()))
            elif kind == LINK_INFO:
                flags = c.number(2) >> 8
                c.take(8 if flags & 1 else 0)
                if c.address() is not None:
                    raise ValueError("no decoder for HDF5 groups with links in a fractal heap")
            elif kind == LINK:
                c.take(1)
                flags = c.number(1)
                hard = not (flags & 8) or c.number(1) == 0
                c.take(8 * bool(flags & 4) + bool(flags & 16))
                name = c.take(c.number(1 << (flags & 3))).decode()
                if hard:
                    out[name] = c.address()
        return out

    def variables(self, group: str = "") -> dict[str, Variable]:
        """Numeric variables of a group by name."""
        at = self.root
        for step in filter(None, group.split("/")):
            at = self.members(at)[step]
        found = {name: Variable.of(self, place) for name, place in self.members(at).items()}
        return {name: v for name, v in found.items() if v is not None}


class Variable:
    """Shape, type, fill value, chunks and filters of a variable."""

    def __init__(self, file: Hdf5, shape: list[int], kind: str):
        self.file, self.shape, self.kind = file, shape, kind
        self.fill: float | None = None
        self.filters: list[int] = []
        self.chunk: list[int] | None = None
        self.place: int | None = None
        self.data: bytes | None = None
        #: Why its values cannot be read; other variables of the file can.
        self.refused: str | None = None

    @classmethod
    def of(cls, file: Hdf5, place: int) -> Variable | None:
        """The variable at this place; None if there is a group or a variable of other values than numbers."""
        parts = dict(file.messages(place))
        if not {SPACE, TYPE, LAYOUT} <= set(parts) or (kind := _kind(parts[TYPE])) is None:
            return None
        version, rank = parts[SPACE][0], parts[SPACE][1]
        c = file._cursor(parts[SPACE][8 if version == 1 else 4 :])
        v = cls(file, [c.length() for _ in range(rank)], kind)
        v._fill(parts)
        v._layout(parts[LAYOUT])
        if FILTERS in parts:
            v._filters(parts[FILTERS])
        return v

    def _fill(self, parts: dict[int, bytes]) -> None:
        body, raw = parts.get(FILL), b""
        if body is not None and body[0] == 3 and body[1] & 0x20:
            raw = body[6:]
        elif body is not None and body[0] in (1, 2) and body[3]:
            raw = body[8:]
        elif body is None and OLD_FILL in parts:
            raw = parts[OLD_FILL][4:]
        if len(raw) >= np.dtype(self.kind).itemsize:
            self.fill = float(np.frombuffer(raw, self.kind, 1)[0])

    def _layout(self, body: bytes) -> None:
        if body[0] not in (3, 4):
            self.refused = f"no decoder for an HDF5 layout of version {body[0]}"
            return
        c = self.file._cursor(body[2:])
        if body[1] == 0:
            self.data = c.take(c.number(2))
        elif body[1] == 1:
            self.place = c.address()
        elif body[1] == 2 and body[0] == 3:
            n = c.number(1)
            self.place = c.address()
            self.chunk = [c.number(4) for _ in range(n)][:-1]
        else:
            self.refused = "no decoder for this chunk index of HDF5"

    def _filters(self, body: bytes) -> None:
        c = self.file._cursor(body[8 if body[0] == 1 else 2 :])
        for _ in range(body[1]):
            number = c.number(2)
            named = c.number(2) if body[0] == 1 or number >= 256 else 0
            c.take(2)
            values = c.number(2)
            c.take(-(-named // 8) * 8 if body[0] == 1 else named)
            c.take(4 * values + (4 if body[0] == 1 and values % 2 else 0))
            self.filters.append(number)
        if other := set(self.filters) - {DEFLATE, SHUFFLE, CHECKSUM}:
            self.refused = f"no decoder for HDF5 filter {min(other)}"

    def readable(self) -> Variable:
        if self.refused:
            raise ValueError(self.refused)
        return self

    def chunks(self) -> Iterator[tuple[list[int], int, int, list[int]]]:
        """(first cell, place, bytes, filters passed) of each chunk that is in the file."""
        key = 8 + 8 * (len(self.shape) + 1)
        todo = [] if self.place is None else [self.place]
        while todo:
            level, entries = self.file._node(todo.pop(), key)
            if level:
                todo += [child for _, child in entries]
                continue
            for k, child in entries:
                size, skipped = struct.unpack_from("<II", k)
                at = struct.unpack_from(f"<{len(self.shape)}Q", k, 8)
                yield list(at), self.file.base + child, size, [f for i, f in enumerate(self.filters) if not skipped >> i & 1]

    def values(self) -> np.ndarray:
        """A whole variable, such as a coordinate."""
        size, n = np.dtype(self.kind).itemsize, int(np.prod(self.shape))
        if self.chunk is None:
            raw = self.data if self.data is not None else b"" if self.place is None else self.file.read(self.place, n * size)
            return np.frombuffer(raw, self.kind, n if raw else 0).reshape(self.shape if raw else -1)
        out = np.full(self.shape, self.fill or 0, self.kind)
        for at, place, stored, filters in self.chunks():
            block = np.frombuffer(unfiltered(self.file.read(place - self.file.base, stored), filters, size), self.kind).reshape(self.chunk)
            to = tuple(slice(a, min(a + c, s)) for a, c, s in zip(at, self.chunk, self.shape, strict=True))
            out[to] = block[tuple(slice(0, t.stop - t.start) for t in to)]
        return out


def _kind(body: bytes) -> str | None:
    """The numpy type of a datatype message; None if it is no number."""
    group, flags, size = body[0] & 15, body[1], struct.unpack_from("<I", body, 4)[0]
    order = ">" if flags & 1 else "<"
    if group == 0 and size in (1, 2, 4, 8):
        return f"{order}{'i' if flags & 8 else 'u'}{size}"
    return f"{order}f{size}" if group == 1 and size in (2, 4, 8) and not flags & 0x40 else None


def unfiltered(raw: bytes, filters: list[int], size: int) -> bytes:
    """The bytes of a chunk, its filters undone from the last to the first."""
    for f in reversed(filters):
        if f == CHECKSUM:
            raw = raw[:-4]
        elif f == DEFLATE:
            raw = zlib.decompress(raw)
        else:
            whole = len(raw) // size * size
            raw = np.frombuffer(raw, np.uint8, whole).reshape(size, -1).T.tobytes() + raw[whole:]
    return raw


def hdf5_blocks(read: Read, variable: str | None, masked: bool, cells: int) -> list[tuple[dict, list[tuple[int, int, int, int]]]]:
    """(layout, (place, bytes, row, column) of each block) of the first plane of a variable, a layout for each set of filters passed;
    without a name of the first variable that is no coordinate.  A whole variable is cut into blocks of about `cells` cells.

    The grid is (lat, lon) unless only (lon, lat) fits the lengths of the coordinates.  Chunks that are not in the file have no cells."""
    group, _, name = (variable or "").rpartition("/")
    held = Hdf5(read).variables(group)
    name = name or next((n for n, v in held.items() if len(v.shape) >= 2), None)
    if name not in held or len(held[name].shape) < 2:
        raise ValueError(f"no variable {name} of two dimensions; there are {', '.join(held)}")
    v = held[name].readable()
    size, (rows, cols) = np.dtype(v.kind).itemsize, v.shape[-2:]
    lat, lon = (next((held[c] for c in names if c in held and len(held[c].shape) == 1), None) for names in (("lat", "latitude"), ("lon", "longitude")))
    swap = bool(lat and lon and (lat.shape[0], lon.shape[0]) == (cols, rows) and rows != cols)
    y = lat.readable().values() if lat else np.zeros(0)
    layout = {"width": rows if swap else cols, "height": cols if swap else rows, "kind": v.kind, "inner": 1, "pick": 0, "predictor": 1,
              "nodata": v.fill if masked else None, "turn": bool(len(y) > 1 and y[0] < y[-1]), "swap": swap}
    if v.data is not None:
        raise ValueError("no decoder for a grid inside an HDF5 header")
    if v.chunk is None:
        band = max(1, cells // cols)
        found = [(v.file.base + v.place + k * cols * size, min(band, rows - k) * cols * size, k, 0) for k in range(0, rows, band)] if v.place is not None else []
        made = {(): found}
        down, across = band, cols
    else:
        made, (down, across) = {}, v.chunk[-2:]
        for at, place, stored, filters in v.chunks():
            if not any(at[:-2]):
                made.setdefault(tuple(filters), []).append((place, stored, at[-2], at[-1]))
    turned = lambda b: (*b[:2], b[3], b[2]) if swap else b
    sides = {"w": down, "h": across} if swap else {"w": across, "h": down}
    return [(layout | sides | {"packing": [*filters]}, [turned(b) for b in blocks]) for filters, blocks in made.items()]
