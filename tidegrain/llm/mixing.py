"""Operator 9: mixing sources to target weights along a time-varying curriculum (DataFrame functions only).

Targets: the sources share a budget of words (all sizes times `share`) by weight; a target stops at `max_epochs` times its
source's size, and the excess is shared again by weight until none is above.  Takes: a source's documents stand in the
order of a digest of doc_id; it takes its whole run as often as the target holds, then words from the start of
the run until the target is met, so only one document in a source gives a part of its words.  Positions: each source has a
weight schedule, linear from `start` to `end` over the training time 0..1.  Its integral is the share of the target that is
due by a time; the inverse of that integral at the words taken before a document gives the document's position.

Word counts stand in running sums over (source, digest) in range partitions, so a source with a third of all rows is
spread over as many tasks as it needs.  Null text has size 0; a null source comes last in the order of sources; equal
doc_ids stand side by side, by the hash of their texts, each with takes of its own; an empty table gives an empty result; plan()
ignores other columns, mix() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import Scratch, partitions, running_sums, small_side, unused, written

#: Bytes that separate words.
SPACES = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    bare = F.trim(text, F.lit(SPACES))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(bare, "[ \\t-\\r]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """From (source, source_size), one row for each source: + weight, target.

    Sources in the order of cap / weight meet their caps first; the level, target by weight, of those that do not is
    closed form: (budget - caps so far) / weights not yet capped."""
    everything = Window.partitionBy()
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    out = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
    out = out.withColumns({"cap": F.col("source_size") * F.lit(float(max_epochs)), "budget": F.sum("source_size").over(everything) * F.lit(float(share))})
    fill = Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(from_here))
    # the first source whose cap is not met sets the level of all after it
    out = out.withColumn("open", F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("open.level") * F.col("weight"), F.col("cap")))
    return out.select("source", "source_size", "weight", target.alias("target"))


def plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0, start: tuple[float, ...] = (1, 1, 1), end: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, positions (one for each pass that takes words
    from it), sorted by the range of the first position.  start and end, cycled like weights, set the schedules."""
    return _plan(docs, weights, max_epochs, share, start, end).drop("mark")


def _mark(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _plan(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0, start: tuple[float, ...] = (1, 1, 1), end: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """plan() with the mark of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), _mark(F.col("text")).alias("mark"))
    rows = rows.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    rows = running_sums(rows, [F.col("source").asc_nulls_last(), F.col("digest"), F.col("doc_id"), F.col("size"), F.col("mark")], {"before": F.col("size")}, "source", "words")
    sizes = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    by_name = Window.partitionBy().orderBy(F.col("source").asc_nulls_last())
    slope = lambda ends: F.get(F.array(*[F.lit(float(w)) for w in ends]), (F.row_number().over(by_name) - 1) % len(ends))
    wanted = targets(sizes, weights, max_epochs, share).withColumns({"w0": slope(start), "w1": slope(end)}).withColumnRenamed("source", "__source")
    out = rows.join(small_side(written(wanted, "targets")), F.col("source").eqNullSafe(F.col("__source")))
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    rest = goal - passes * F.col("source_size") - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    out = out.withColumns({"passes": passes, "part": part}).withColumn("taken", F.col("passes") * F.col("size") + F.col("part"))
    # words of the source that come before each take, as a share of all that it gives
    times = F.when(F.col("taken") > 0, F.expr("sequence(0L, passes + if(part > 0, 1L, 0L) - 1)")).otherwise(F.array().cast("array<bigint>"))
    due = lambda k: (k * F.col("source_size") + F.col("before")) / goal
    out = out.withColumn("positions", F.transform(times, lambda k: _inverse(due(k), F.col("w0"), F.col("w1"))))
    first = F.get("positions", F.lit(0))
    out = out.repartitionByRange(partitions(docs.sparkSession), first, "doc_id").sortWithinPartitions(first, "doc_id")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "positions", "mark")


def _inverse(due: Column, w0: Column, w1: Column) -> Column:
    """The time t at which (w0 t + (w1 - w0) t^2 / 2) / ((w0 + w1) / 2) = due."""
    bend = (w1 - w0) / 2
    whole = (w0 + w1) / 2
    return F.when(F.abs(bend) < 1e-12, due).otherwise((F.sqrt(w0 * w0 + 4 * bend * whole * due) - w0) / (2 * bend))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The training stream: each document once for every pass that takes words from it, all columns kept, in the order of
    positions.  A document that gives only a part of its words in its last pass is given whole there.

    The plan meets the rows by (doc_id, source, text); of rows equal in these each has its own takes."""
    name, source, mark, places, place, nth, order = unused(docs, "id", "source", "mark", "places", "place", "nth", "order")
    scratch = Scratch(docs.sparkSession, "mixing")
    key = [name, source, mark]
    chosen = scratch.written(_plan(docs, **settings).select(F.col("doc_id").alias(name), F.col("source").alias(source), F.col("mark").alias(mark), F.col("positions").alias(places)), "plan")
    chosen = chosen.groupBy(*key).agg(F.array_sort(F.collect_list(places)).alias(places))
    chosen = written(chosen.filter(F.size(F.flatten(places)) > 0), "takes")
    scratch.drop()
    at = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & F.col("source").eqNullSafe(F.col(source)) & (_mark(F.col("text")) == F.col(mark))
    out = docs.join(chosen, at)
    if chosen.filter(F.size(places) > 1).isEmpty():
        out = out.withColumn(nth, F.lit(0))
    else:  # rows equal in the key are dealt by their number among their equals
        out = out.withColumn(nth, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) - 1)
    out = out.withColumn(place, F.explode(F.get(places, F.col(nth)))).withColumn(order, F.col("doc_id"))
    out = out.repartitionByRange(partitions(docs.sparkSession), place, order).sortWithinPartitions(place, order, mark)
    return out.select(*[F.col(c) for c in docs.columns])


ORACLE = """
with t as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as digest
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight
  from t group by source),
c as (select *, source_size * 3.0::double as cap, cast(sum(source_size) over () as double) as budget from s),
f as (
  select *, (budget - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level,
         row_number() over (order by cap / weight, source nulls last) as place
  from c),
o as (select arg_min(level, place) as level from f where cap >= level * weight),
g as (select f.source, f.source_size, f.weight, least(f.cap, coalesce(o.level * f.weight, f.cap)) as target from f, o),
r as (
  select t.doc_id, t.size, g.source_size, g.target, g.weight as w1, cast(round(g.target) as bigint) as goal,
         cast(coalesce(sum(t.size) over (partition by t.source order by t.digest, t.doc_id, t.size rows between unbounded preceding and 1 preceding), 0) as bigint) as before
  from t join g on t.source is not distinct from g.source)
select doc_id, size, source_size, target,
       cast(case when source_size = 0 then 0
            else (goal // source_size) * size + greatest(0, least(size, goal % source_size - before)) end as bigint) as taken,
       case when source_size > 0 and (goal >= source_size and size > 0 or least(size, goal % source_size - before) > 0)
            then round(case when w1 = 1 then before / goal
                            else (sqrt(1 + 4 * ((w1 - 1) / 2) * ((1 + w1) / 2) * (before / goal)) - 1) / (2 * ((w1 - 1) / 2)) end, 9) end as position
from r
"""
