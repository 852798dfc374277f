"""Operator 6: best-fit packing of documents into sequences, with certified bounds.

A document's ids and its end id are cut into pieces of at most `capacity` ids; only longer documents are cut, and the
rest that does not fill a piece comes first.  Pieces are dealt at random over partitions of some `part_rows` rows, and each
packs its own by best-fit decreasing.  Dual feasible functions of the lengths bound a partition's number of bins
from below; a partition that meets its bound is certified and stays.  Partitions with a gap give up the bins that have room:
their pieces are dealt anew over fewer partitions and packed again, as long as that saves any bin.

Defined results: null text is empty and gives one piece, its end id; rows equal in doc_id and text are packed one by one; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Scratch, id_columns, ids, written
from .tokens import Encoder

CAPACITY = 1024
END_ID = 2
PART_ROWS = 8192

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECE}, sequence_id long, offset long, fill long, gap long"


def pieces(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; texts are encoded here and go no further."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out = []
            for row, text in enumerate(batch.text):
                found = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                first = len(found) % capacity or capacity
                edges = [0, *range(first, len(found) + 1, capacity)]
                out += [(row, k, a, b - a, zlib.crc32(found[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            made = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32"])
            yield made.assign(doc_id=ids(batch)[made.pop("row").to_numpy()])

    return docs.select(*id_columns(docs), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, _PIECE)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best of two families of dual feasible functions: no packing of these lengths has fewer bins."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    rows, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    # f_t: lengths over capacity - t count as a whole bin, under t as nothing, the rest as themselves
    t = np.arange(0, capacity // 2 + 1)
    whole = rows[-1] - rows[capacity - t]
    middle = total[capacity - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = int((whole + -(-middle // capacity)).max())
    # u_k: x stays if (k + 1) x / capacity is whole, else it becomes floor((k + 1) x / capacity) / k
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        up = (k + 1) * x
        scaled = np.where(up % capacity == 0, k * x, up // capacity * capacity)  # times k * capacity
        best = max(best, int(-(-int((count * scaled).sum()) // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, fill of each bin).  The fullest open bin that has room takes the next item:
    bit r of `rooms` tells whether some bin has room r, so the search is one shift."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fills = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        fit = rooms >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += length
        left = room - length
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def _packed(rows: DataFrame, turn: int, part_rows: int, capacity: int, scratch: Scratch) -> DataFrame:
    """Deals rows at random over partitions and packs each."""
    parts = max(1, -(-rows.count() // part_rows))
    doc_id = [F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id")]
    dealt = rows.select(*doc_id, "piece", "start", "length", "ids_crc32", F.floor(F.rand(turn) * parts).alias("part"))

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "no_id", "doc_id", "piece", "ids_crc32"], ignore_index=True)
        lengths = group.length.to_numpy()
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        gap = len(fills) - lower_bound(lengths, capacity)
        made = group.assign(doc_id=ids(group), sequence_id=(turn << 56) + (int(key[0]) << 24) + bins, offset=offsets, fill=fills[bins], gap=gap)
        return made[[c.split()[0] for c in _PLACED.split(", ")]]

    return scratch.written(dealt.groupBy("part").applyInPandas(pack, _PLACED), f"packed-{turn}")


#: Turns that sequence ids have room for, beside the first.
TURNS = 127


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """pieces() -> the same with sequence_id, offset, fill (ids in the sequence) and gap (bins over the bound of the
    partition that packed it; 0: certified)."""
    n_bins = lambda df: df.filter("offset = 0").count()  # noqa: E731  each bin has one piece at its start
    scratch = Scratch(rows.sparkSession, "packing")
    last = _packed(scratch.written(rows, "pieces"), 0, part_rows, capacity, scratch)
    done: DataFrame | None = None
    for turn in range(1, TURNS + 1):
        loose = (F.col("gap") > 0) & (F.col("fill") < capacity)
        pool = last.filter(loose)
        before = n_bins(pool)
        if before < 2:
            break
        again = _packed(pool, turn, part_rows, capacity, scratch)
        after = n_bins(again)
        if after >= before:
            break
        stay = last.filter(~loose)
        done = stay if done is None else done.unionByName(stay)
        last = again
    out = written(last if done is None else done.unionByName(last), "packed")
    scratch.drop()
    return out


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end_id: int = END_ID, part_rows: int = PART_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill, gap."""
    return pack(pieces(docs, tokenizer, capacity, end_id), capacity, part_rows)
