"""Files of R written here item by item."""

import bz2
import datetime
import gzip
import lzma
import struct

import pandas as pd
import pytest

from tidegrain.sources import r_tables, tables

NA = -(1 << 31)
i4 = lambda *v: struct.pack(f">{len(v)}i", *v)


class Writer:
    def __init__(self):
        self.symbols = []

    def symbol(self, name):
        if name in self.symbols:
            return i4(255 | (self.symbols.index(name) + 1) << 8)
        self.symbols.append(name)
        return i4(1) + self.chars(name)

    def chars(self, s, latin=False):
        raw = None if s is None else s.encode("latin-1" if latin else "utf-8")
        return i4(9 | ((4 if latin else 8) << 12 if raw is not None else 0), -1 if raw is None else len(raw)) + (raw or b"")

    def pairs(self, items):
        return b"".join(i4(2 | 1024) + self.symbol(k) + v() for k, v in items) + i4(254)

    def vector(self, kind, body, n, attributes=()):
        out = i4(kind | (512 if attributes else 0), n) + (body() if callable(body) else body)
        return out + (self.pairs(attributes) if attributes else b"")

    def text(self, *v, latin=False):
        return self.vector(16, b"".join(self.chars(s, latin) for s in v), len(v))

    def ints(self, v, attributes=(), kind=13):
        return self.vector(kind, i4(*v), len(v), attributes)

    def reals(self, v, attributes=()):
        return self.vector(14, struct.pack(f">{len(v)}d", *v), len(v), attributes)

    def altrep(self, name, state):
        return i4(238) + i4(2) + self.symbol(name) + i4(2) + self.symbol("base") + i4(2) + self.ints([13]) + i4(254) + state() + i4(254)

    def frame(self, columns, rows):
        attributes = [("names", lambda: self.text(*columns)), ("class", lambda: self.text("data.frame")), ("row.names", lambda: self.ints([NA, -rows]))]
        return self.vector(19, lambda: b"".join(c() for c in columns.values()), len(columns), attributes)


def table(w):
    factor = [("levels", lambda: w.text("low", "high")), ("class", lambda: w.text("factor"))]
    return w.frame({
        "GEOID": lambda: w.text("01001", None, "01005"), "n": lambda: w.ints([7, NA, -3]), "v": lambda: w.reals([1.5, float("nan"), 1e300]), "ok": lambda: w.ints([1, 0, NA], kind=10),
        "class_": lambda: w.ints([2, NA, 1], factor), "day": lambda: w.reals([0.0, 18262.0, float("nan")], [("class", lambda: w.text("Date"))]),
        "seq": lambda: w.altrep("compact_intseq", lambda: w.reals([3.0, 5.0, 1.0])), "wrapped": lambda: w.altrep("wrap_real", lambda: w.vector(19, w.reals([1.0, 2.0, 3.0]) + w.ints([0, 0]), 2)),
        "place": lambda: w.text("Zürich", "Bern", "", latin=True),
    }, 3)


ROWS = [("01001", 7, 1.5, True, "high", datetime.date(1970, 1, 1), 5, 1.0, "Zürich"), (None, None, None, False, None, datetime.date(2020, 1, 1), 6, 2.0, "Bern"), ("01005", -3, 1e300, None, "low", None, 7, 3.0, "")]


def stream(body, version=3):
    return b"X\n" + i4(version, 0x40200, 0x20300) + (i4(5) + b"UTF-8" if version == 3 else b"") + body


@pytest.mark.parametrize("version,packed", [(2, gzip.compress), (3, bz2.compress), (3, lzma.compress), (3, bytes)])
def test_rds(spark, tmp_path, version, packed):
    for k in range(2):
        (tmp_path / f"t{k}.rds").write_bytes(packed(stream(table(Writer()), version)))
    df = tables.read_table(spark, str(tmp_path / "t*.rds"))
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=str) == sorted(ROWS * 2, key=str) and dict(df.dtypes)["day"] == "date" and dict(df.dtypes)["v"] == "double"


def test_rda_by_name(spark, tmp_path):
    w = Writer()
    more = lambda: w.frame({"k": lambda: w.ints([1, 2])}, 2)
    (tmp_path / "a.rda").write_bytes(gzip.compress(b"RDX3\n" + stream(w.pairs([("first", lambda: table(w)), ("note", lambda: w.text("hello")), ("second", more)]))))
    path = str(tmp_path / "a.rda")
    assert [r.k for r in tables.read_table(spark, path, "second").orderBy("k").collect()] == [1, 2] and tables.read_table(spark, path, "first").count() == 3
    with pytest.raises(Exception, match="name one of first, second"):
        tables.read_table(spark, path)
    with pytest.raises(Exception, match="no table 'third'"):
        tables.read_table(spark, path, "third")
    (tmp_path / "b.RData").write_bytes(b"RDX2\n" + stream(Writer().pairs([("only", lambda: Writer().frame({"k": lambda: Writer().ints([3])}, 1))]), 2))
    assert tables.read_table(spark, str(tmp_path / "b.RData")).first().k == 3


def test_what_is_not_read():
    with pytest.raises(ValueError, match="binary"):
        r_tables.frames(b"A\n2\n")
    with pytest.raises(ValueError, match="version 9"):
        r_tables.frames(stream(b"", 9))
    with pytest.raises(ValueError, match="kind 3"):
        r_tables.frames(stream(i4(3)))
    with pytest.raises(ValueError, match="ends early"):
        r_tables.frames(stream(i4(14, 5) + b"\0" * 8))
    assert isinstance(r_tables.frame(stream(table(Writer()))), pd.DataFrame)
