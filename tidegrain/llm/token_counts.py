"""Operator 2: exact token counts of whole texts, huge documents by overlapping chunks.

A text up to `chunk` bytes is encoded in one piece.  A longer one is cut into overlapping chunks that are dealt out as
rows, so one huge document is the work of many tasks.  Each chunk is encoded with the offsets of its ids; the counts of
neighbours are spliced at an offset inside their overlap where both have an id boundary and which is proven stable: ASCII
white space after a visible ASCII character.  The vocabulary's splitting pattern has no look-behind and no pre-token
holds white space after something else, so a pre-token of the whole text starts there, and what follows does not depend
on what came before.  A left chunk's end cannot reach back to such an offset, as the pre-token and any special token in
front of it are complete.  Where an overlap has no such offset the document is chunked again with eight times the overlap
and twice the chunk, at last as a whole.

Defined results: null counts as empty (0 bytes, 0 tokens); rows equal in doc_id and text each get their row, and
a huge text is encoded once for all its copies; null doc_ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Scratch, id_columns, ids, partitions, small_side, written
from .tokens import Encoder

#: Bytes of a text that is encoded in one piece, and of a chunk; bytes that neighbours share.
CHUNK = 1 << 15
OVERLAP = 512


def _stable(data: bytes) -> np.ndarray:
    """Offsets of ASCII white space after a visible ASCII character."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 2:
        return np.zeros(0, np.int64)
    space = (b[1:] == 32) | ((b[1:] >= 9) & (b[1:] <= 13))
    seen = (b[:-1] > 32) & (b[:-1] < 127)
    return np.flatnonzero(space & seen) + 1


def _chunks(data: bytes, chunk: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the chunks, moved to the starts of characters."""

    def char(at: int) -> int:
        while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
            at -= 1
        return min(at, len(data))

    start = 0
    while True:
        end = char(start + chunk)
        if len(data) - end <= overlap:
            end = len(data)
        yield start, end
        if end == len(data):
            return
        start = char(end - overlap)


def chunk_rows(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(sha, part, parts, start, ahead, behind, text): ahead and behind are the bytes shared with the neighbours."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sha, text in zip(batch.sha, batch.text, strict=True):
                data = text.encode()
                spans = list(_chunks(data, chunk, overlap))
                out = [(sha, k, len(spans), a, spans[k - 1][1] - a if k else 0, b - spans[k + 1][0] if k + 1 < len(spans) else 0, data[a:b].decode()) for k, (a, b) in enumerate(spans)]
                for k in range(0, len(out), 256):
                    yield pd.DataFrame(out[k : k + 256], columns=["sha", "part", "parts", "start", "ahead", "behind", "text"])

    return rows.mapInPandas(cut, "sha string, part long, parts long, start long, ahead long, behind long, text string")


def _encode_chunks(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """Chunks -> ids, and the stable id boundaries of both overlaps as offsets in the text with the ids before them."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            out = []
            for sha, part, parts, start, ahead, behind, text in batch.itertuples(index=False):
                data = text.encode()
                found = encoder.ids(text)
                starts = encoder.starts(found)
                where = np.intersect1d(_stable(data), starts)
                before = np.searchsorted(starts, where)
                head, tail = where < ahead, where >= len(data) - behind
                out.append((sha, part, parts, len(found), where[head] + start, before[head], where[tail] + start, before[tail]))
            yield pd.DataFrame(out, columns=["sha", "part", "parts", "n", "head", "head_n", "tail", "tail_n"])

    ints = ", ".join(f"{c} array<long>" for c in ("head", "head_n", "tail", "tail_n"))
    return chunks.mapInPandas(encode, f"sha string, part long, parts long, n long, {ints}")


def _splice(encoded: DataFrame) -> DataFrame:
    """(sha, n_tokens, failed) of the chunked texts; each pair of neighbours meets by an equi-join."""
    left = encoded.filter("part + 1 < parts").select("sha", (F.col("part") + 1).alias("part"), F.col("tail").alias("left_tail"), F.col("tail_n").alias("left_tail_n"), F.col("n").alias("left_n"))
    met = encoded.drop("tail", "tail_n").join(left, ["sha", "part"], "left")
    shared = F.array_min(F.array_intersect("head", "left_tail"))
    at = lambda where, count: F.get(F.col(count), (F.array_position(where, shared) - 1).cast("int"))
    lost = (F.col("left_n") - at("left_tail", "left_tail_n")) + at("head", "head_n")
    met = met.withColumns({"lost": F.when(F.col("part") > 0, lost).otherwise(0), "miss": (F.col("part") > 0) & shared.isNull()})
    return met.groupBy("sha").agg(F.sum(F.col("n") - F.coalesce("lost", F.lit(0))).alias("n_tokens"), F.max("miss").alias("failed"))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*id_columns(docs), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"doc_id": ids(batch), "n_bytes": batch.n_bytes, "n_tokens": [len(encoder.ids(t)) for t in batch.text]})

    short = rows.filter(F.col("n_bytes") <= chunk).mapInPandas(count, "doc_id long, n_bytes long, n_tokens long")
    huge = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).filter(F.octet_length("text") > chunk).withColumn("sha", F.sha2("text", 256))
    names = written(huge.select("doc_id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "huge")
    if names.isEmpty():
        return short
    scratch = Scratch(spark, "token-counts")
    texts, found = huge.select("sha", "text").dropDuplicates(["sha"]), None  # a text once, whatever its copies
    while True:
        dealt = chunk_rows(texts, chunk, overlap).repartition(partitions(spark), "sha", "part")
        done = scratch.written(_splice(scratch.written(_encode_chunks(dealt, tokenizer), "chunks")), "spliced")
        good = done.filter("not failed").select("sha", "n_tokens")
        found = good if found is None else found.unionByName(good)
        failed = done.filter("failed").select("sha")
        if failed.isEmpty():
            break
        texts = huge.join(small_side(failed), "sha", "left_semi").select("sha", "text").dropDuplicates(["sha"])
        chunk, overlap = 2 * chunk + 8 * overlap, 8 * overlap
    found = written(found, "counts")
    scratch.drop()
    return short.unionByName(names.join(found, "sha").select("doc_id", "n_bytes", "n_tokens"))
