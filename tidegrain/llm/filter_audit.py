"""Operator 13: how filters overlap, in every order in which they can be applied.

Repeated texts are found by partition refinement: rows are split by length in code points, then by the hash of one block of the
text after the other, and rows that are alone in their class drop out after each split.  Only the texts of rows that still have
company are compared, whole; of equal texts all but those with the smallest doc_id are marked.  Then each row is five bits, so all
that the 120 orders ask for are sums over the distinct bit sets of a part: what a filter removes depends only on the set of
filters before it, of which there are 16, not on their order.

Defined results: null text counts as empty; a null source is the part ''; a null doc_id is larger than any other and has no labels;
rows equal in doc_id and text are rows of their own and none marks the other; several labels of one doc_id count if any of them says
so; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Scratch, small_side, written

FILTERS = "ABCDE"
#: Code points at which the successive blocks of a text end; the rest is the last one.
BLOCKS = (64, 1024, 16384)
#: White space between words, for trim().
_SPACE = " \t\n\x0b\x0c\r"


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _own_failures(docs: DataFrame) -> DataFrame:
    """docs(doc_id, part, text), with `bits` of the filters that look at the text alone."""
    bare = F.trim("text", F.lit(_SPACE))
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    # explode() of one element: the words are made once, not again in each condition
    out = docs.select("*", F.explode(F.array(F.struct(words.alias("w")))).alias("__s")).select(*docs.columns, F.col("__s.w").alias("__w"))
    n, capitals = F.size("__w"), F.length("text") - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    failed = (n < 50, 100 * F.size(F.array_distinct("__w")) < 65 * n, 100 * capitals > 5 * F.length("text"), F.col("text").rlike("[#$%&*|]"))
    bits = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))
    return out.withColumn("bits", bits).drop("__w")


def _splits(hashed: Callable[..., Column]) -> list[Column]:
    """What rows are split by, in turn: the length, then the hash of each block."""
    edges = (0, *BLOCKS)
    blocks = [F.substring("text", a + 1, b - a) for a, b in zip(edges, BLOCKS)]
    rest = F.when(F.length("text") > BLOCKS[-1], F.expr(f"substring(text, {BLOCKS[-1] + 1})")).otherwise(F.lit(""))
    return [F.length("text").cast("long"), *[hashed(b).cast("long") for b in (*blocks, rest)]]


def _classes(docs: DataFrame, hashed: Callable[..., Column]) -> DataFrame:
    """docs and `class`, equal for equal texts; texts of one class may yet differ, as hashes can clash."""
    return docs.withColumn("class", F.xxhash64(*_splits(hashed)))


def mark_repeats(docs: DataFrame, hashed: Callable[..., Column] = F.xxhash64, scratch: Scratch | None = None, facts: Callable[[DataFrame], DataFrame] = lambda d: d, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, repeated): whether a row's text is that of a smaller doc_id.  docs(doc_id, text, ...) without nulls in text.

    facts: adds the columns of `keep` that are made from the text, in the same pass over it.  hashed: of a block.
    Beside one narrow row for each document only texts that have company after all splits are shuffled, and each task sends a text once."""
    scratch = scratch or Scratch(docs.sparkSession, "repeats")
    names = [f"__{k}" for k in range(len(BLOCKS) + 2)]
    narrow = facts(docs).select(*keep, *[c.alias(n) for n, c in zip(names, _splits(hashed))], F.xxhash64(*_splits(hashed)).alias("class"))
    rows = scratch.written(narrow, "rows")
    alive = rows.select("class", *names)
    for k in range(1, len(names) + 1):
        company = scratch.written(alive.groupBy(*names[:k]).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), "company")
        # who has company now had it before, so this one join stands for all earlier ones
        alive = rows.select("class", *names).join(small_side(company), names[:k], "left_semi")
    left = scratch.written(alive.select("class").distinct(), "left")
    texts = _classes(docs.select("doc_id", "text"), hashed).join(small_side(left), "class", "left_semi").groupBy("class", "text").agg(F.min("doc_id").alias("least"))
    kinds = scratch.written(texts.groupBy("class").agg(F.count("*").alias("kinds"), F.min("least").alias("least")), "kinds")
    later = F.coalesce(F.col("doc_id") > F.col("least"), F.col("doc_id").isNull() & F.col("least").isNotNull(), F.lit(False))
    out = rows.join(small_side(kinds), "class", "left")
    one = out.filter("kinds is null or kinds = 1").select(*keep, later.alias("repeated"))
    several = kinds.filter("kinds > 1").select("class")
    if several.isEmpty():
        return one
    # texts that differ met in one class: their rows are marked by the text itself
    mixed = _classes(facts(docs), hashed).join(small_side(several), "class", "left_semi")
    least = mixed.groupBy("text").agg(F.min("doc_id").alias("least"))
    return one.unionByName(mixed.join(least, "text").select(*keep, later.alias("repeated")))


def _labelled(labels: DataFrame) -> DataFrame:
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))


def failure_cells(docs: DataFrame, labels: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each part by the set of filters that they fail, and how many are labelled so."""
    scratch = Scratch(docs.sparkSession, "audit")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), _text().alias("text"))
    rows = mark_repeats(base, hashed, scratch, _own_failures, ("doc_id", "part", "bits"))
    rows = rows.select("doc_id", "part", (F.col("bits") + F.when(F.col("repeated"), F.lit(16)).otherwise(F.lit(0))).alias("bits"))
    said = rows.join(_labelled(labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")), "doc_id", "left")
    one = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0)).alias(c)
    cells = written(said.groupBy("part", "bits").agg(F.count("*").alias("n"), one("good"), one("toxic")), "cells")
    scratch.drop()
    return cells


def audit(docs: DataFrame, labels: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step."""
    cells, spark = failure_cells(docs, labels, hashed), docs.sparkSession
    places = range(len(FILTERS))
    # each filter with each set of filters before it, and in how many orders they stand before it
    pairs = [{"own": 1 << f, "before": s, "orders": factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count())} for f in places for s in range(1 << len(FILTERS)) if not s >> f & 1]
    steps = [("".join(FILTERS[f] for f in p), k + 1, 1 << p[k], sum(1 << f for f in p[:k])) for p in permutations(places) for k in places]
    pairs = F.explode(F.from_json(F.lit(json.dumps(pairs)), "array<struct<own: int, before: int, orders: bigint>>")).alias("p")
    steps = spark.createDataFrame(steps, "filter_order string, step int, own int, before int")  # 600 rows
    mine, earlier = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda when, c, name: F.sum(F.when(when, F.col(c)).otherwise(F.lit(0))).alias(name)
    sums = cells.select("*", pairs).select("*", "p.*").groupBy("part", "own", "before", "orders").agg(
        total(~mine & ~earlier, "n", "kept"), total(mine & ~earlier, "n", "removed"), total(mine & earlier, "n", "redundant"), total(F.col("bits") == F.col("own"), "n", "unique_fails"),
        total(mine & ~earlier, "good", "good_lost"), total(mine & ~earlier, "toxic", "toxic_lost"))
    sums = written(sums, "sums")
    value = sums.groupBy("part", "own").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    out = sums.join(value, ["part", "own"]).join(F.broadcast(steps), ["own", "before"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
w as (select doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
f as (select doc_id, part, cast(len(words) < 50 as integer) + 2 * cast(100 * len(list_distinct(words)) < 65 * len(words) as integer)
 + 4 * cast(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) as integer) + 8 * cast(regexp_matches(t, '[#$%&*|]') as integer)
 + 16 * cast(coalesce(min(doc_id) over (partition by t) < doc_id, doc_id is null and min(doc_id) over (partition by t) is not null) as integer) as bits from w),
l as (select doc_id, max(cast(coalesce(quality = 1, false) as integer)) as good, max(cast(coalesce(toxic = 1, false) as integer)) as toxic from labels where doc_id is not null group by 1),
c as (select part, bits, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l on f.doc_id = l.doc_id group by 1, 2),
x as (select unnest(range(5)) as i),
o as (select [a.i, b.i, g.i, h.i, k.i] as p from x a, x b, x g, x h, x k where len(list_distinct([a.i, b.i, g.i, h.i, k.i])) = 5),
s as (select p, unnest(range(5)) as j from o),
r as (select array_to_string(list_transform(p, lambda q: substr('ABCDE', cast(q + 1 as integer), 1)), '') as filter_order, cast(j + 1 as integer) as step, cast(pow(2, p[j + 1]) as integer) as own,
 cast(coalesce(list_sum(list_transform(p[1:j], lambda q: pow(2, q))), 0) as integer) as before from s),
m as (select part, filter_order, step, own, cast(sum(n) filter (bits & (own | before) = 0) as bigint) as kept, cast(sum(n) filter (bits & own <> 0 and bits & before = 0) as bigint) as removed,
 cast(sum(n) filter (bits & own <> 0 and bits & before <> 0) as bigint) as redundant, cast(sum(n) filter (bits = own) as bigint) as unique_fails,
 cast(sum(good) filter (bits & own <> 0 and bits & before = 0) as bigint) as good_lost, cast(sum(toxic) filter (bits & own <> 0 and bits & before = 0) as bigint) as toxic_lost from c, r group by 1, 2, 3, 4)
select part, filter_order, step, coalesce(kept, 0) as kept, coalesce(removed, 0) as removed, coalesce(redundant, 0) as redundant, coalesce(unique_fails, 0) as unique_fails, coalesce(good_lost, 0) as good_lost,
 coalesce(toxic_lost, 0) as toxic_lost, cast(coalesce(sum(removed) over (partition by part, own), 0) as bigint) as shapley from m
"""
