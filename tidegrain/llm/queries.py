"""The opN_ queries: each operator over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, filter_audit, jaccard_join, lexical_search, mixing, packing, passages, quality_rules, resharding, secrets, token_counts, token_files, url_templates
from .staging import shared_dir, written

#: Shards that the documents of op1 come from; they are filed by source there, so the hot source makes one shard large.
OLD_SHARDS, NEW_SHARDS = 12, 16
TOKEN_LIMIT = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(OLD_SHARDS))
    out = resharding.resharded(documents(spark, sf_dir), old, OLD_SHARDS, NEW_SHARDS, f"{shared_dir(spark)}/resharded-{uuid.uuid4().hex}")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(documents(spark, sf_dir))
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = written(quality_rules.ledger(documents(spark, sf_dir)), "ledger")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"), quality_rules.passes(quality_rules.PRODUCTION).alias("kept"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy rejects, alone rejects, and would leave if it were dropped: from the ledger."""
    book = written(quality_rules.ledger(documents(spark, sf_dir)), "ledger")
    return quality_rules.ablations(book, quality_rules.PRODUCTION)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fill: ids in the sequence; gap: sequences over the bound of the partition that packed it, 0 if certified."""
    return packing.pack_documents(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(documents(spark, sf_dir), words=4, percent=85)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """position: of the first take in the curriculum, the schedules going from even weights to the targets' weights."""
    out = mixing.plan(documents(spark, sf_dir), weights=(1, 2, 3), start=(1, 1, 1), end=(1, 2, 3))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.round(F.get("positions", F.lit(0)), 9).alias("position"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    token_files.write_ids(documents(spark, sf_dir), path)
    return token_files.read_ids(spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_templates.with_document_labels(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return url_templates.judge(pages, "bad").withColumn("purity", F.round("purity", 9))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(spark, documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_reshard, op2_token_counts, op3_secrets, op4_passages, op5_quality_rules, op6_packing, op7_jaccard_join, op8_exact_dedup, op9_mixing, op10_token_files, op11_url_filters, op12_lexical_search, op13_filter_audit, rule_ablations)
}
ORACLES = {"op5_quality_rules": quality_rules.ORACLE, "rule_ablations": quality_rules.ABLATIONS, "op8_exact_dedup": exact_dedup.ORACLE, "op9_mixing": mixing.ORACLE, "op11_url_filters": url_templates.ORACLE, "op12_lexical_search": lexical_search.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
