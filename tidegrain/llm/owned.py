"""Occurrences of 64-bit hashes packed for their owners: a task's finds go to each owner as one row of arrays, so that the
shuffle moves some 7 bytes an occurrence.  The owner is told by the lower 24 bits of a hash and the seed by the upper 40; two
hashes of one owner that agree in the seed count as one, which only adds candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd

SCHEMA = "owner int, seeds binary, steps binary, nodes binary, sizes binary, counts binary"
#: Occurrences packed at once.
PACK = 250_000
LOW = np.uint64((1 << 24) - 1)


def planes(a: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of each number, byte by byte: planes of small numbers compress to nothing."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1)[:, :width].T).tobytes()


def unplanes(data: bytes, width: int, kind: type) -> np.ndarray:
    out = np.zeros((len(data) // width, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, -1).T
    return out.view(kind)[:, 0]


class Packer:
    """Takes the hashes of one node after the other; flush() gives the rows for the owners."""

    def __init__(self, owners: int, sized: bool = True):
        """sized: whether the owners are told the sizes of the nodes."""
        self.owners, self.sized = owners, sized
        self.clear()

    def clear(self) -> None:
        self.nodes: list[int] = []
        self.sizes: list[int] = []
        self.seeds: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.waiting = 0

    def add(self, node: int, size: int, hashes: np.ndarray, spread: np.ndarray | None = None) -> None:
        """Hashes of a node in their order; those marked in `spread` go to further owners by node, not by hash."""
        own = ((hashes & LOW) % np.uint64(self.owners)).astype(np.int32)
        if spread is not None:
            own[spread] = self.owners + node % self.owners
        self.nodes.append(node)
        self.sizes.append(size)
        self.seeds.append(hashes >> np.uint64(24))
        self.own.append(own)
        self.waiting += len(hashes)

    @property
    def full(self) -> bool:
        return self.waiting >= PACK or len(self.nodes) == 65535

    def flush(self) -> pd.DataFrame:
        lengths = [len(s) for s in self.seeds]
        seed, own = np.concatenate(self.seeds), np.concatenate(self.own)
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths)
        at = np.concatenate([np.arange(n, dtype=np.uint32) for n in lengths])
        narrow = own.astype(np.uint16) if 2 * self.owners <= 65536 else own  # which numpy sorts by radix
        order = np.argsort(narrow, kind="stable")  # inside an owner by node and place
        own, seed, doc, at = own[order], seed[order], doc[order], at[order]
        edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        nodes, sizes = np.array(self.nodes, np.int64), np.array(self.sizes, np.int32)
        # the nodes of each owner: where they begin, and their numbers of occurrences
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]))
        counts = np.diff(np.append(first, len(own))).astype(np.uint32)
        steps = np.diff(at, prepend=np.uint32(0))
        steps[first] = at[first]
        used, within = doc[first], np.searchsorted(first, edges).tolist()
        edges, out = edges.tolist(), []
        for a, b, c, d in zip(edges[:-1], edges[1:], within[:-1], within[1:], strict=True):
            told = sizes[used[c:d]].tobytes() if self.sized else b""
            out.append((int(own[a]), planes(seed[a:b], 5), planes(steps[a:b], 4), nodes[used[c:d]].tobytes(), told, planes(counts[c:d], 4)))
        self.clear()
        return pd.DataFrame(out, columns=["owner", "seeds", "steps", "nodes", "sizes", "counts"])


def unpacked(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, node, size, place) of all rows of one owner; size 0 where it was not told."""
    seed, node, size, place = [], [], [], []
    for seeds, steps, nodes, sizes, counts in part[["seeds", "steps", "nodes", "sizes", "counts"]].itertuples(index=False):
        counts = unplanes(counts, 4, np.uint32)
        at = np.cumsum(unplanes(steps, 4, np.uint32), dtype=np.int64)
        first = np.cumsum(counts, dtype=np.int64) - counts
        before = np.where(first > 0, at[first - 1], 0)  # the sums start anew with each node
        seed.append(unplanes(seeds, 5, np.int64))
        node.append(np.repeat(np.frombuffer(nodes, np.int64), counts))
        size.append(np.repeat(np.frombuffer(sizes, np.int32), counts) if len(sizes) else np.zeros(len(at), np.int32))
        place.append(at - np.repeat(before, counts))
    return tuple(map(np.concatenate, (seed, node, size, place)))


def repeated(seed: np.ndarray, node: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Places in the arrays of the seeds that occur more than once, sorted by (seed, node, place); equal occurrences, which
    tasks give that met copies of a text, once."""
    order = np.argsort(seed, kind="stable")
    s = seed[order]
    same = np.concatenate([[False], s[1:] == s[:-1], [False]])
    order = order[same[:-1] | same[1:]]  # most seeds occur once
    order = order[np.lexsort((place[order], node[order], seed[order]))]
    s, n, p = seed[order], node[order], place[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (n[1:] != n[:-1]) | (p[1:] != p[:-1])
    return order[fresh]
