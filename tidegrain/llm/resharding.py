"""Operator 1: minimum-cost-flow resharding.

Old shard sizes and new capacities form a transport problem: a unit of flow is a byte, staying costs nothing, moving from
shard i to j costs cost(i, j).  Its solution by successive shortest paths (on the driver, over as many nodes as there are
shards, whatever the data) says how many bytes each old shard gives to each new one.  Every old shard is then cut, in the
order of doc_id, into one block for each flow it sends; running sums of bytes over range partitions place the cuts, so a shard
with a third of all rows is cut by many tasks.  A document that straddles a cut (at most one for each flow) goes where most
room is left.  The cuts are a table of a few rows, so write_affected() finds the new shard of each document beside its text
and moves the texts of the shards that gain or lose a document once, by ranges of (shard, place).

Defined results: null text weighs 1 byte; null doc_ids come first; rows equal in doc_id and text stay together, in places of
their own; groups of equal texts with other doc_ids are not kept together, as one may exceed a shard; an empty table gives an
empty result; other columns are carried by write_affected only.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .staging import partitions, running_sums, small_side, unused, written


def moving_cost(old: int, new: int) -> int:
    return int(old != new)


def min_cost_flow(supply: list[int], capacity: list[int], cost: Callable[[int, int], int] = moving_cost) -> dict[tuple[int, int], int]:
    """{(old, new): bytes} with every supply sent, no capacity exceeded and the least total cost.

    Successive shortest paths with potentials.  sum(capacity) must be at least sum(supply)."""
    if sum(capacity) < sum(supply):
        raise ValueError("the new shards cannot hold all bytes")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    heads: list[list[int]] = [[] for _ in range(n + m + 2)]
    edges: list[list[int]] = []  # to, room, cost; the reverse of edge e is e ^ 1

    def edge(a: int, b: int, room: int, price: int) -> None:
        heads[a].append(len(edges))
        edges.append([b, room, price])
        heads[b].append(len(edges))
        edges.append([a, 0, -price])

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
        for j in range(m):
            edge(i, n + j, s, cost(i, j))
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    potential = [0] * (n + m + 2)  # costs are not negative
    left = sum(supply)
    while left:
        far: list[float] = [float("inf")] * len(heads)
        by = [-1] * len(heads)
        far[source] = 0
        queue = [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for e in heads[a]:
                b, room, price = edges[e]
                if room and d + price + potential[a] - potential[b] < far[b]:
                    far[b] = d + price + potential[a] - potential[b]
                    by[b] = e
                    heapq.heappush(queue, (far[b], b))
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, far, strict=True)]
        push, a = left, sink
        while a != source:
            push, a = min(push, edges[by[a]][1]), edges[by[a] ^ 1][0]
        a = sink
        while a != source:
            edges[by[a]][1] -= push
            edges[by[a] ^ 1][1] += push
            a = edges[by[a] ^ 1][0]
        left -= push
    return {(i, edges[e][0] - n): edges[e ^ 1][1] for i in range(n) for e in heads[i] if e % 2 == 0 and edges[e ^ 1][1]}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (k < total % shards) for k in range(shards)]


#: What orders the documents of an old shard.
KEY = ("known", "id", "size", "crc")
_KEY = "struct<known: boolean, id: bigint, size: bigint, crc: bigint>"


@dataclass(frozen=True)
class Plan:
    """rows: old_shard, KEY, n (equal rows), shard, slot (of the first of them).  runs: (old_shard, first key, last key, shard) of
    the pieces that old shards are cut into.  flow: {(old, new): bytes} of the solution."""

    rows: DataFrame
    runs: list[tuple[int, Row, Row, int]]
    flow: dict[tuple[int, int], int]

    @property
    def touched(self) -> set[int]:
        """Shards that gain or lose a document."""
        return {k for old, _, _, new in self.runs if old != new for k in (old, new)}


def _keyed(old_shard: Column) -> list[Column]:
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    return [old_shard.cast("int").alias("old"), doc_id.isNotNull().alias("known"), F.coalesce(doc_id, F.lit(0)).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")]


def solve(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, capacities: list[int] | None = None, cost: Callable[[int, int], int] = moving_cost) -> Plan:
    """Where every document goes.  old_shard gives 0 .. old_shards - 1."""
    spark = docs.sparkSession
    rows = docs.select(*_keyed(old_shard)).groupBy("old", *KEY).agg(F.count("*").alias("n"))
    rows = written(running_sums(rows, [F.col(c) for c in ("old", *KEY)], {"byte_at": F.col("size") * F.col("n"), "row_at": F.col("n")}, "old", "shards"), "placed")
    supply = [0] * old_shards
    for r in rows.groupBy("old").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")).collect():  # one row for each shard
        supply[r.old] = r.bytes
    capacities = capacities or equal_capacities(sum(supply), new_shards)
    flow = min_cost_flow(supply, capacities, cost)
    blocks, at = [], [0] * old_shards
    for (i, j), n in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):  # what stays comes first
        blocks.append((len(blocks), i, j, at[i], at[i] + n))
        at[i] += n
    table = F.broadcast(spark.createDataFrame(blocks, "block int, __old int, __shard int, lo long, hi long"))  # at most old + new - 1 rows
    inside = (F.col("old") == F.col("__old")) & (F.col("byte_at") >= F.col("lo")) & (F.col("byte_at") < F.col("hi"))
    # a run: the documents wholly in a block, or one that straddles its end
    placed = rows.join(table, inside).withColumn("odd", F.col("byte_at") + F.col("size") * F.col("n") > F.col("hi"))
    key = F.struct(*KEY)
    runs = placed.groupBy("block", "old", "__shard", "odd").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.sum("n").alias("n"), F.sum(F.col("size") * F.col("n")).alias("bytes"), F.min("row_at").alias("row_at")).collect()
    room, to = list(capacities), {}
    for r in runs:
        if not r.odd:
            to[r.block, False] = r["__shard"]
            room[r["__shard"]] -= r.bytes
    for r in sorted((r for r in runs if r.odd), key=lambda r: (-r.bytes, r.block)):
        j = to[r.block, True] = max(range(new_shards), key=lambda k: (room[k], -k))
        room[j] -= r.bytes
    bases, filled = [], [0] * new_shards
    for r in sorted(runs, key=lambda r: (r.old, r.row_at)):  # the slots of a shard follow (old shard, key)
        j = to[r.block, r.odd]
        bases.append((r.block, r.odd, j, filled[j] - r.row_at))
        filled[j] += r.n
    base = F.broadcast(spark.createDataFrame(bases, "block int, odd boolean, shard int, base long"))
    out = placed.join(base, ["block", "odd"]).select("old", *KEY, "n", "shard", (F.col("base") + F.col("row_at")).alias("slot"))
    return Plan(written(out, "plan"), [(r.old, r.first, r.last, to[r.block, r.odd]) for r in runs], flow)


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, capacities: list[int] | None = None, cost: Callable[[int, int], int] = moving_cost) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, old_shard, shard, slot."""
    return _listed(solve(docs, old_shard, old_shards, new_shards, capacities, cost).rows)


def _listed(rows: DataFrame) -> DataFrame:
    each = rows.withColumn("nth", F.explode(F.expr("sequence(0L, n - 1)")))
    return each.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.col("old").alias("old_shard"), "shard", (F.col("slot") + F.col("nth")).alias("slot"))


def write_affected(docs: DataFrame, old_shard: Column, plan: Plan, path: str, places: tuple[str, str, str] | None = None) -> set[int]:
    """Writes the shards that gain or lose a document under path/shard=k, in the order of their slots, and returns them; the
    files of the others stay as they are.

    places, if given, names columns of the files for the old shard, the writing task and the place there, which rises with the slot."""
    names = unused(docs, "old", *KEY, "new", "from", "first", "last")
    old, key, new, start, first, last = names[0], names[1:5], *names[5:]
    runs = [(i, a, b, j) for i, a, b, j in plan.runs if i in plan.touched or j in plan.touched]
    table = F.broadcast(docs.sparkSession.createDataFrame(runs, f"`{start}` int, `{first}` {_KEY}, `{last}` {_KEY}, `{new}` int"))  # two rows at most for each flow
    rows = docs.select("*", *[c.alias(n) for c, n in zip(_keyed(old_shard), [old, *key], strict=True)])
    whole = F.struct(*[F.col(n).alias(k) for n, k in zip(key, KEY, strict=True)])
    out = rows.join(table, (F.col(old) == F.col(start)) & (whole >= F.col(first)) & (whole <= F.col(last)))
    out = out.repartitionByRange(partitions(docs.sparkSession), new, old, *key).sortWithinPartitions(new, old, *key)
    if places:
        out = out.withColumns({places[0]: F.col(old), places[1]: F.spark_partition_id(), places[2]: F.monotonically_increasing_id()})
    out = out.withColumn("shard", F.col(new)).drop(old, *key, new, start, first, last)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
    return plan.touched


def resharded(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int, path: str) -> DataFrame:
    """Writes the affected shards under path, and returns the rows of reshard() as the files of all shards have them: the
    rewritten ones are read back, the others are still where docs has them."""
    spark = docs.sparkSession
    plan = solve(docs, old_shard, old_shards, new_shards)
    old, task, place = unused(docs, "kept_old", "kept_task", "kept_place")
    touched = write_affected(docs, old_shard, plan, path, (old, task, place))
    kept = _listed(plan.rows.filter(~F.col("shard").isin(sorted(touched))))
    if not touched:
        return kept
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name.lower() in ("doc_id", "text")]
    files = spark.read.schema(", ".join([*fields, f"{old} int", f"{task} int", f"{place} long", "shard int"])).parquet(path)
    # each task wrote one range, so the documents of a shard in one task have adjacent places
    held = files.groupBy("shard", task).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = written(held.select("shard", task, (ahead - F.col("first")).alias("base")), "bases")
    text = F.coalesce(F.col("text"), F.lit(""))
    moved = files.join(small_side(held), ["shard", task]).select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col(old).alias("old_shard"), "shard", (F.col("base") + F.col(place)).alias("slot"))
    return moved.unionByName(kept.select(*moved.columns))
