"""Operator 8: exact dedup over an extendible-hash index on shared files (DataFrame functions only).

Every row enters an index of (hash, digest, rows) by its 64-bit hash.  A directory addresses buckets by the leading bits
of the hash; a bucket with more than `bucket_rows` rows is split by one more bit, doubling the directory there, until it
fits or holds a single hash: equal hashes chain and cannot be split.  The directory gives each owner task a range of buckets
of about as many rows, and a bucket of one hash with more rows than that as many owners as it needs; the index is written by owners.
Rows whose hash occurs more than once in its bucket go with their texts to the bucket's owner, whose task compares the bytes; the
texts of a bucket that collide in the hash form its chain.  A bucket with several owners, one hot hash, is combined in each of
their shares first, so that its copies reach the first owner as one row for each share.  Every row finds its place by its owner,
its bucket, its hash and the link of the chain that has its text.

Defined results: null text counts as empty; rows equal in doc_id and text count one each in group_size and exactly one of
them is kept; a null doc_id is smaller than any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import partitions, small_side, unused, written

#: Rows of a bucket at most, and so of the texts that an owner compares at a time; a bucket of one hash may have more.  A bucket
#: has no more than an owner's share of all rows either, unless that is less than LEAST_ROWS.
BUCKET_ROWS, LEAST_ROWS = 1 << 14, 1 << 10


def _prefix(bits: Column) -> Column:
    """The leading `bits` of the hash, as an unsigned number."""
    return F.when(bits == 0, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", F.col("hash"), (64 - bits).cast("int")))


def directory(keys: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(depth, bucket, rows, chained) of every bucket: `bucket` is the leading `depth` bits of the hashes it owns."""
    counts = written(keys.groupBy("hash").count(), "hash-counts")
    n = counts.count()
    depth = max(0, math.ceil(math.log2(n / bucket_rows))) if n else 0
    open_ = counts
    done = None
    while True:
        sizes = open_.groupBy(_prefix(F.lit(depth)).alias("bucket")).agg(F.sum("count").alias("rows"), F.min("hash").alias("lo"), F.max("hash").alias("hi"))
        sizes = written(sizes.withColumn("chained", F.col("lo") == F.col("hi")), "buckets")
        full = (F.col("rows") > bucket_rows) & ~F.col("chained") & F.lit(depth < 63)
        part = sizes.filter(~full).select(F.lit(depth).alias("depth"), F.col("bucket").cast("long").alias("bucket"), "rows", "chained")
        done = part if done is None else done.unionByName(part)
        split = sizes.filter(full).select("bucket")
        if split.isEmpty():
            return done
        open_ = open_.withColumn("bucket", _prefix(F.lit(depth))).join(small_side(split), "bucket", "left_semi").drop("bucket")
        depth += 1


def _owners(buckets: DataFrame, owners: int) -> DataFrame:
    """(depth, bucket, owner, shares): the first owner of each bucket and how many it has.  The directory has one row for
    each bucket, so one task can number it."""
    rows = buckets.agg(F.sum("rows").alias("rows")).first().rows or 0
    each = max(1, -(-rows // owners))
    first = F.call_function("shiftleft", F.col("bucket"), (64 - F.col("depth")).cast("int"))  # the least hash, unsigned, of the bucket
    start = F.when(F.col("depth") == 0, F.lit(0)).otherwise(first).bitwiseXOR(F.lit(-(1 << 63)))
    before = Window.partitionBy().orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    owner = F.floor(F.coalesce(F.sum("rows").over(before), F.lit(0)) / each)
    return buckets.select("depth", "bucket", owner.alias("owner"), F.when(F.col("chained"), F.ceil(F.col("rows") / each)).otherwise(F.lit(1)).alias("shares"))


def index(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The written index, by owners and in the order of the hashes: doc_id, hash, text_sha256, rows (equal rows), depth, bucket, owner."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), F.sha2(text, 256).alias("text_sha256"))
    keys = written(keys.groupBy("doc_id", "hash", "text_sha256").agg(F.count("*").alias("rows")), "keys")
    owners = partitions(docs.sparkSession)
    bucket_rows = min(bucket_rows, max(LEAST_ROWS, -(-keys.count() // owners)))
    buckets = written(directory(keys.select("hash"), bucket_rows), "directory")
    depths = [r.depth for r in buckets.select("depth").distinct().orderBy("depth").collect()]  # at most 64
    own = F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(F.lit(d)).cast("long").alias("bucket")) for d in depths or [0]])
    placed = keys.withColumn("at", F.explode(own)).select("doc_id", "hash", "text_sha256", "rows", "at.depth", "at.bucket")
    placed = placed.join(small_side(written(_owners(buckets, owners), "owners")), ["depth", "bucket"])
    placed = placed.withColumn("owner", F.col("owner") + F.pmod(F.xxhash64("doc_id"), F.col("shares"))).drop("shares")
    unsigned = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    return written(placed.repartition(owners, "owner").sortWithinPartitions("owner", unsigned, "doc_id"), "hash-index")


def _resolved(docs: DataFrame, bucket_rows: int) -> DataFrame:
    """Index rows (one for equal rows of doc_id and text) with the document that stays and the size of the group."""
    idx = index(docs, bucket_rows)
    owners = partitions(docs.sparkSession)
    bucket = ["depth", "bucket", "hash"]
    twice = idx.groupBy(*bucket).agg(F.sum("rows").alias("n"), F.min("owner").alias("first"), F.max("owner").alias("last"))
    twice = written(twice.filter("n > 1").drop("n"), "chains")
    hot, cold = twice.filter("first < last"), twice.filter("first = last")  # hot ones are fewer than owners
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))
    one = F.lit(1).cast("long")
    if hot.isEmpty():
        met = rows.join(small_side(cold), "hash").select(*bucket, "first", "last", "text", F.col("doc_id").alias("keep_id"), one.alias("group_size"))
    else:
        met = rows.join(small_side(hot.select("hash")), "hash", "left_anti").join(small_side(cold), "hash")
        met = met.select(*bucket, "first", "last", "text", F.col("doc_id").alias("keep_id"), one.alias("group_size"))
        share = F.pmod(F.xxhash64("doc_id"), F.col("last") - F.col("first") + 1)
        parts = rows.join(small_side(hot), "hash").groupBy(*bucket, "first", "last", share.alias("share"), "text")
        met = met.unionByName(parts.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).drop("share"))
    # the owner of a bucket compares bytes: the text itself is a grouping key within the owner's task
    met = met.repartition(owners, "first")
    chains = met.groupBy("first", "last", *bucket, "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    link = F.row_number().over(Window.partitionBy("first", "last", *bucket).orderBy("text_sha256"))
    groups = chains.select("first", "last", *bucket, F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size").withColumn("link", link)
    # every owner of a bucket gets its chains
    groups = written(groups, "groups").withColumn("owner", F.explode(F.sequence("first", "last"))).drop("first", "last")
    out = idx.join(groups, ["owner", *bucket, "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    out = out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", "rows").alias("group_size"), "text_sha256", "rows", "depth", "bucket", "owner", F.coalesce("link", F.lit(1)).alias("link"))
    return out.withColumn("stays", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and its place in the index: depth, bucket, owner, link."""
    out = _resolved(docs, bucket_rows).withColumn("copy", F.explode(F.expr("sequence(1L, rows)")))
    return out.select("doc_id", "keep_id", "group_size", (F.col("stays") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "depth", "bucket", "owner", "link")


def drop_copies(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The documents that stay, with all their columns; rows equal in doc_id and text stay once.

    Only the keys of what goes are joined to the texts, and only rows that occur twice are shuffled whole."""
    found = written(_resolved(docs, bucket_rows), "resolved")
    name, digest = unused(docs, "id", "sha")
    key = [F.col("doc_id").alias(name), F.col("text_sha256").alias(digest)]
    gone, twice = found.filter("not stays").select(*key), found.filter("stays and rows > 1").select(*key)
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (sha == F.col(digest))
    out = docs.join(small_side(gone), same, "left_anti")
    if twice.isEmpty():
        return out
    hold = docs.join(small_side(twice), same, "left_semi").withColumn(digest, sha).dropDuplicates(["doc_id", digest]).drop(digest)
    return out.join(small_side(twice), same, "left_anti").unionByName(hold)


ORACLE = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
from t join g on t.text = g.text
"""
