"""Operator 12: ranked lexical search over a two-level quantised index.

build_index() puts documents into blocks of bounded size and writes one row for each term of a block: the documents that hold it,
and for each of them, level one, its impact in one byte, rounded upward in steps of that list, and, level two, the exact term count.
An impact is what an occurrence list gives to a score before the term's weight, so the index holds for any weights.

search() has two passes.  The first reads level one alone: a byte is at least the impact, and one step less is below it, so sums of
bytes bound every document's score from both sides.  The kth largest lower bound of an item, over all blocks, is a score that the kth
best document reaches.  The second pass goes to the blocks in which the upper bound of an item reaches that, reads the exact counts,
and scores every document whose upper bound reaches it in 64-bit integers.  Each block gives its best k, the items' best are theirs.

Items are dealt to groups of ITEMS, so a task holds one block of documents and the lists of one group of items, whatever the numbers
of documents and items are; nothing of either passes through the driver but two totals of the corpus.

Defined results: null text has no terms and is found by nothing; items without terms, or whose terms no document has, give no rows;
rows of documents equal in doc_id, and rows of items equal in item_id, are ranked each for itself; a null doc_id comes last among
equal scores; other columns are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import Scratch, id_columns, small_side, written

#: Documents, and entries of lists, after which a block is closed.
BLOCK_DOCS, BLOCK_ENTRIES = 8192, 1_000_000
#: Items that one task looks for at once.
ITEMS = 512
#: Largest impact: 1e9 * tf div (1000 * tf + 8 * m) is under 1e6.
_BYTE = 255
#: Every byte that is in no term becomes a space, and A-Z become a-z.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: bytes | None) -> list[bytes]:
    """ASCII letters and digits and all characters beyond ASCII make terms; A-Z are lower-cased."""
    return bytes(text).translate(_FOLD).split() if text else []


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def corpus_totals(docs: DataFrame) -> tuple[int, int]:
    """(N, L): documents with a term, and terms of all documents."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [len(terms_of(t)) for t in batch.text]
            yield pd.DataFrame({"docs": [sum(x > 0 for x in n)], "terms": [sum(n)]})

    row = docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return (row[0] or 0), (row[1] or 0)


class _Block:
    """The documents of one block, and its lists."""

    def __init__(self, number: int):
        self.number, self.ids, self.no_id, self.sizes = number, [], [], []
        self.terms: dict[bytes, int] = {}
        self.entries: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, doc_id: int, no_id: bool, terms: list[bytes]) -> None:
        counts = Counter(terms)
        known = self.terms
        at = np.fromiter((known.setdefault(t, len(known)) for t in counts), np.int64, len(counts))
        self.entries.append((at, np.fromiter(counts.values(), np.int64, len(counts))))
        self.ids.append(doc_id)
        self.no_id.append(no_id)
        self.sizes.append(len(terms))
        self.waiting += len(counts)

    @property
    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.waiting >= BLOCK_ENTRIES

    def rows(self, n_docs: int, n_terms: int) -> pd.DataFrame:
        """One row for each term, and one without a term that has the documents."""
        m = 10 + 90 * np.array(self.sizes, np.int64) * n_docs // n_terms
        at = np.concatenate([e[0] for e in self.entries])
        tf = np.concatenate([e[1] for e in self.entries])
        doc = np.repeat(np.arange(len(self.ids)), [len(e[0]) for e in self.entries])
        order = np.argsort(at, kind="stable")
        at, tf, doc = at[order], tf[order], doc[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        exact = impacts(tf, m[doc])
        steps = np.maximum(1, -(-np.maximum.reduceat(exact, first) // _BYTE))
        held = np.diff(np.append(first, len(at)))
        levels = -(-exact // np.repeat(steps, held))
        parts = [doc.astype("<u2"), levels.astype("u1"), tf.astype("<u4")]
        cut = [[p[a:b].tobytes() for p in parts] for a, b in zip(first, np.append(first[1:], len(at)))]
        rows = [(self.number, t.decode("utf-8", "replace"), int(s), int(n), *c) for t, s, n, c in zip(self.terms, steps, held, cut)]
        rows.append((self.number, None, 0, len(self.ids), np.array(self.ids, "<i8").tobytes(), np.array(self.no_id, "u1").tobytes(), m.astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=["block", "term", "step", "held", "docs", "levels", "counts"])


def build_index(docs: DataFrame, path: str) -> tuple[int, int]:
    """Writes the index of docs(doc_id, text) and returns corpus_totals().  A block is made inside one task, which writes it whole:
    (block, term, step, held, docs, levels, counts); the row whose term is null has doc_ids, their absence and length factors."""
    n_docs, n_terms = corpus_totals(docs)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        block = _Block(number)
        for batch in batches:
            for doc_id, no_id, text in zip(batch.doc_id, batch.no_id, batch.text):
                terms = terms_of(text)
                if terms:
                    block.add(doc_id, no_id, terms)
                if block.full:
                    yield block.rows(n_docs, n_terms)
                    number += 1
                    block = _Block(number)
        if block.ids:
            yield block.rows(n_docs, n_terms)

    made = docs.select(*id_columns(docs), F.col("text").cast("binary").alias("text")).mapInPandas(blocks, "block long, term string, step long, held long, docs binary, levels binary, counts binary")
    made.write.parquet(path)
    return n_docs, n_terms


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term) for items(item_id, text), each term once; `item` numbers the rows.  A written table."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, t.decode("utf-8", "replace")) for k, text in enumerate(batch.text) for t in dict.fromkeys(terms_of(text))]
            at = [k for k, _ in rows]
            yield pd.DataFrame({c: batch[c].to_numpy()[at] for c in ("item", "doc_id", "no_id")} | {"term": [t for _, t in rows]}, columns=["item", "doc_id", "no_id", "term"])

    numbered = items.select(F.col("item_id").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("item"))
    out = numbered.select("item", *id_columns(numbered), "text").mapInPandas(split, "item long, doc_id long, no_id boolean, term string")
    return written(out.select("item", F.when(~F.col("no_id"), F.col("doc_id")).alias("item_id"), "term"), "items")


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by doc_id.  index: what build_index() wrote."""
    scratch = Scratch(index.sparkSession, "search")
    asked = item_terms(items)
    terms = scratch.written(asked.select("term").distinct(), "terms")
    df = index.filter("term is not null").select("term", "held").join(small_side(terms), "term", "left_semi").groupBy("term").agg(F.sum("held").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    groups = max(1, -(-asked.select("item").distinct().count() // ITEMS))
    weights = asked.join(df.select("term", weight.alias("w")), "term").filter("w > 0")
    wanted = scratch.written(weights.select("term", "item", "w", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int").alias("group")), "wanted")
    by_term = scratch.written(wanted.groupBy("group", "term").agg(F.collect_list("item").alias("items"), F.first("w").alias("w")), "by-term")  # at most the items of a group
    lists = index.filter("term is not null").join(small_side_of_lists(by_term), "term")

    bounds = lists.select("block", "group", "step", "items", "w", "docs", "levels").groupBy("block", "group").applyInPandas(lambda g: _bounds(g, k), "block long, group int, item long, most long, least array<long>")
    bounds = scratch.written(bounds, "bounds")
    ranked = bounds.select("item", F.explode("least").alias("low")).withColumn("r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("low")))).filter(F.col("r") <= k)
    # a document that any term with weight gives something has a lower bound over 0
    floor = ranked.groupBy("item").agg(F.when(F.count("*") == k, F.min("low")).otherwise(F.lit(1)).cast("long").alias("floor"))
    open_ = scratch.written(bounds.join(floor, "item").filter("most >= floor").select("block", "group", "item", "floor"), "open")
    # one row for each block and group with its items, none of which a task did not have in the first pass
    asks = open_.groupBy("block", "group").agg(F.collect_list(F.struct("item", "floor")).alias("open"))
    again = lists.select("block", "group", "step", "items", "w", "docs", "levels", "counts")
    heads = index.filter("term is null").select("block", F.lit(0).cast("long").alias("step"), F.lit(0).cast("long").alias("w"), "docs", "levels", "counts")
    asked_heads = asks.join(heads, "block").select("block", "group", "step", F.col("open.item").alias("items"), "w", "docs", "levels", "counts", F.col("open.floor").alias("floors"))
    rows = again.join(asks.select("block", "group"), ["block", "group"], "left_semi").withColumn("floors", F.lit(None).cast("array<long>")).unionByName(asked_heads)
    best = rows.groupBy("block", "group").applyInPandas(lambda g: _scored(g, k), "item long, doc_id long, no_id boolean, score long")
    best = best.select("item", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    top = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    out = written(top.join(asked.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score"), "found")
    scratch.drop()
    return out


def small_side_of_lists(by_term: DataFrame) -> DataFrame:
    """by_term with a broadcast hint if the rows that it stands for fit; its arrays are of longs."""
    return F.broadcast(by_term) if small_enough(by_term) else by_term


def small_enough(by_term: DataFrame, limit: int = 8 << 20) -> bool:
    size = by_term.agg(F.sum(8 * F.size("items") + F.octet_length("term") + 64)).first()[0]
    return (size or 0) <= limit


def _lists(group: pd.DataFrame, *columns: str) -> dict[int, list[tuple]]:
    """The lists of each item: (w, step, documents, levels[, counts])."""
    out: dict[int, list[tuple]] = {}
    kinds = {"docs": "<u2", "levels": "u1", "counts": "<u4"}
    for items, w, step, *parts in group[["items", "w", "step", *columns]].itertuples(index=False):
        entry = (w, step, *[np.frombuffer(p, kinds[c]) for c, p in zip(columns, parts)])
        for item in items:
            out.setdefault(int(item), []).append(entry)
    return out


def _sums(lists: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) bound of each document of the block."""
    upper, less = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for w, step, docs, levels, *_ in lists:
        gain = levels.astype(np.int64) * (w * step)
        upper[docs] += gain
        less[docs] += np.where(levels > 0, w * (step - 1), 0)  # level n is over n - 1 steps
    return upper, upper - less


def _bounds(group: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = []
    for item, lists in _lists(group, "docs", "levels").items():
        upper, lower = _sums(lists, 1 + max(int(e[2].max()) for e in lists))
        if upper.max() > 0:
            low = np.partition(lower, -k)[-k:] if len(lower) > k else lower
            rows.append((group.block.iat[0], group.group.iat[0], item, int(upper.max()), low[low > 0]))
    return pd.DataFrame(rows, columns=["block", "group", "item", "most", "least"])


def _scored(group: pd.DataFrame, k: int) -> pd.DataFrame:
    head = group[group.floors.notna()].iloc[0]
    ids, no_id, m = np.frombuffer(head.docs, "<i8"), np.frombuffer(head.levels, "u1") > 0, np.frombuffer(head.counts, "<i8")
    floors = dict(zip(map(int, head["items"]), map(int, head.floors)))
    out = []
    for item, lists in _lists(group[group.floors.isna()], "docs", "levels", "counts").items():
        if item not in floors:
            continue
        upper, _ = _sums(lists, len(ids))
        asked = upper >= floors[item]
        score = np.zeros(len(ids), np.int64)
        for w, _, docs, _, counts in lists:
            mine = asked[docs]
            d = docs[mine]
            score[d] += w * impacts(counts[mine].astype(np.int64), m[d])
        found = np.flatnonzero(score > 0)
        best = found[np.lexsort((ids[found], no_id[found], -score[found]))][:k]
        out += [(item, ids[d], no_id[d], score[d]) for d in best]
    return pd.DataFrame(out, columns=["item", "doc_id", "no_id", "score"]).astype({"item": "int64", "doc_id": "int64", "no_id": bool, "score": "int64"})


def ranked(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """build_index() and search() over an index of this call's own in the shared folder, which goes when the result is written."""
    scratch = Scratch(spark, "index")
    path = f"{scratch.path}/index"
    n_docs, _ = build_index(docs, path)
    found = search(spark.read.parquet(path), n_docs, items, k)
    scratch.drop()
    return found


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
s as (select r, doc_id, len(terms) as n, terms from d where len(terms) > 0),
g as (select count(*) as big_n, cast(sum(n) as bigint) as big_l from s),
p as (select r, term, count(*) as tf from (select r, unnest(terms) as term from s) group by 1, 2),
i as (select row_number() over () as q, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
w as (select term, cast(floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, g group by term, big_n),
m as (select r, doc_id, 10 + (90 * n * big_n) // big_l as m from s, g),
c as (select q, any_value(item_id) as item_id, m.r, any_value(doc_id) as doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
 from i join w on i.term = w.term join p on i.term = p.term join m on p.r = m.r group by q, m.r)
select item_id, cast(k as integer) as rank, doc_id, score from (select *, row_number() over (partition by q order by score desc, doc_id nulls last) as k from c where score > 0) where k <= 10
"""
