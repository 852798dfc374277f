"""Operator 10: token ids of whole texts in Simple-8b files, in ascending doc_id order, and back.

Documents are dealt by ranges of doc_id and sorted there; a task encodes its texts and emits segments of some
`segment_ids` ids.  A segment is one binary value: MAGIC, version, counts, the ids of each document, the word offsets of
the blocks and the Simple-8b words (simple8b.py).  Segments are the rows of a Parquet table, so any store that Spark
writes to can hold them and a lost task leaves nothing half written; `part` and `segment` give the order.

Defined results: null counts as empty (the end id alone); null doc_ids come first; rows equal in doc_id stand in the order of
a digest of their texts, so a rerun gives the same file; an empty table gives an empty file and result; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from .staging import id_columns, partitions, small_side, written
from .tokens import Encoder

MAGIC, VERSION = b"TGS8", 1
END_ID = 2
SEGMENT_IDS = 1 << 18


def pack(docs: list[np.ndarray]) -> bytes:
    """One segment: header, ids of each document, block offsets, words; all little-endian."""
    lens = np.array([len(d) for d in docs], "<i8")
    words, offsets = simple8b.encode(np.concatenate(docs) if docs else np.zeros(0, np.uint64))
    head = struct.pack("<4sIQQQ", MAGIC, VERSION, len(lens), len(offsets), len(words))
    return head + lens.tobytes() + offsets.astype("<i8").tobytes() + words.astype("<u8").tobytes()


def unpack(data: bytes) -> list[np.ndarray]:
    magic, version, docs, blocks, words = struct.unpack_from("<4sIQQQ", data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a segment of this format")
    at = struct.calcsize("<4sIQQQ")
    lens = np.frombuffer(data, "<i8", docs, at)
    offsets = np.frombuffer(data, "<i8", blocks, at + 8 * docs)
    ids = simple8b.decode(np.frombuffer(data, "<u8", words, at + 8 * (docs + blocks)), offsets, int(lens.sum()))
    return np.split(ids, np.cumsum(lens)[:-1]) if docs else []


def write_ids(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, segment_ids: int = SEGMENT_IDS) -> None:
    """Writes the file; its rows are (part, segment, doc_ids, no_ids, n_ids, payload); no_ids tells null doc_ids."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer)
        names: list[int] = []
        none: list[bool] = []
        held: list[np.ndarray] = []
        size = segment = part = 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "segment": [segment], "doc_ids": [names], "no_ids": [none], "n_ids": [size], "payload": [pack(held)]})

        for batch in batches:
            for part, doc_id, no_id, text in zip(batch.part, batch.doc_id, batch.no_id, batch.text, strict=True):  # noqa: B007
                names.append(int(doc_id))
                none.append(bool(no_id))
                held.append(np.append(encoder.ids(text), np.uint32(end_id)))
                size += len(held[-1])
                if size >= segment_ids:
                    yield flush()
                    names, none, held, size, segment = [], [], [], 0, segment + 1
        if names:
            yield flush()

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest")]
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    dealt = dealt.select(*id_columns(dealt), "text")
    dealt = dealt.withColumn("part", F.spark_partition_id().cast("long"))
    dealt.mapInPandas(encode, "part long, segment long, doc_ids array<long>, no_ids array<boolean>, n_ids long, payload binary").write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file: doc_id, start, n_tokens, ids_crc32, in no order.  The ids never leave their task."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for before, names, none, payload in zip(batch.before, batch.doc_ids, batch.no_ids, batch.payload, strict=True):
                docs = unpack(payload)
                lens = np.array([len(d) for d in docs], np.int64)
                crc = [zlib.crc32(d.astype("<u4").tobytes()) for d in docs]
                known = pd.arrays.IntegerArray(np.array(names, np.int64), np.array(none, bool))
                yield pd.DataFrame({"doc_id": known, "start": before + np.cumsum(lens) - lens, "n_tokens": lens, "ids_crc32": crc})

    stored = spark.read.parquet(path)
    # sums of whole parts first (one row for each), then the few segments inside a part
    parts = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    ahead = parts.select("part", F.coalesce(F.sum("n").over(Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inner = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored.select("part", "segment", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("within"))
    starts = written(starts.join(ahead, "part").select("part", "segment", (F.col("within") + F.col("ahead")).alias("before")), "segment-starts")
    rows = stored.select("part", "segment", "doc_ids", "no_ids", "payload").join(small_side(starts), ["part", "segment"])
    return rows.select("before", "doc_ids", "no_ids", "payload").mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
