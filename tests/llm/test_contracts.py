"""The registered queries and the stages against brute force, and ids, ties and repeated rows that a task could mix up."""

import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, awkward, words

import corpus_pipeline
from tidegrain.llm import exact_dedup, jaccard_join, mixing, packing, passages, quality_rules, queries, resharding, secrets, token_counts, token_files
from tidegrain.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"
BIG = 9007199254740993


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Encoder(use_ranks=False)


def test_op1_all_documents(spark, docs):
    got = queries.op1_reshard(spark, DATA).toPandas()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in zip(docs.doc_id, docs.text))
    assert Counter(zip(got.doc_id, got["size"], got.text_crc32)) == want
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard")) and set(got.law) == {"bytes"}
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * got["size"].max()


def test_op1_moves_what_the_flow_says(odd):
    old = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    plan = resharding.solve(odd, old, 3, 4)
    rows = plan.rows.toPandas()
    moved = (rows["size"] * rows.n)[rows.old != rows.shard].sum()
    planned = sum(n for (i, j), n in plan.flow.items() if i != j)
    assert abs(moved - planned) <= (len(plan.flow) + 1) * (rows["size"] * rows.n).max()


def test_op2_and_op10_ids(spark, docs, library):
    ids = {d: np.append(library.ids(t), 2).astype("<u4") for d, t in zip(docs.doc_id, docs.text)}
    got = queries.op2_token_counts(spark, DATA).toPandas()
    assert dict(zip(got.doc_id, got.n_tokens)) == {d: len(v) - 1 for d, v in ids.items()} and (got.over_limit == (got.n_tokens > 1024)).all()
    got = queries.op10_token_files(spark, DATA).toPandas().sort_values("doc_id")
    lens = [len(ids[d]) for d in got.doc_id]
    assert got.start.tolist() == (np.cumsum(lens) - lens).tolist() and got.ids_crc32.tolist() == [zlib.crc32(ids[d].tobytes()) for d in got.doc_id]


def test_op3_base_of_all_rows(spark, docs):
    kinds = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12), "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}
    import hashlib

    got = {r.doc_id: r for r in queries.op3_secrets(spark, DATA).collect()}
    for d, t in zip(docs.doc_id, docs.text):
        spans = sorted((m.start(), k, m.end()) for k, (p, g, least) in enumerate(kinds.values()) for m in p.finditer(t or "") if len(m[g]) >= least)
        listed = [f"{list(kinds)[k]}:{a}:{b}" for a, k, b in spans]
        assert got[d].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(got[d].spans.split(",")) | ({""} if not listed else set())
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]


def _long_passages(docs, least=50, identity=0.8):
    """Pairs of documents that share a passage, by aligning every two whole texts that have seeds in common."""
    held = defaultdict(set)
    split = {d: (t or "").encode().lower().split() for d, t in zip(docs.doc_id, docs.text)}
    for d, w in split.items():
        for k in range(len(w) - 3):
            held[tuple(w[k : k + 4])].add(d)
    common = Counter((a, b) for s in held.values() for a in s for b in s if a < b)
    return {(a, b) for (a, b), n in common.items() if n >= passages.SEEDS and len(split[a]) * len(split[b]) < 4e6 and passages.passage(passages.common_places(split[a], split[b]), least, identity)}


def test_op4_recall(spark, docs):
    """Every document that shares a passage with another one by brute force, and how many of them the query finds."""
    want = {d for pair in _long_passages(docs) for d in pair}
    got = queries.op4_passages(spark, DATA).toPandas()
    found = set(got.doc_id) | set(got.partner_id)
    assert len(want) > 10 and len(want & found) >= 0.9 * len(want)
    assert ((got.end_word - got.start_word) >= 50).all() and (got.identity >= 0.8).all()


def test_op4_exact_runs_are_never_lost(spark):
    rng, rows = np.random.default_rng(12), []
    fresh = lambda n: [f"q{x}" for x in rng.integers(1 << 40, size=n)]
    for k in range(12):
        run = fresh(50)
        rows += [(100 * k + j, " ".join(fresh(int(rng.integers(0, 40))) + run + fresh(int(rng.integers(0, 40))))) for j in range(2 + k * 3)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert set(got.doc_id) | set(got.partner_id) == {d for d, _ in rows}


def test_op4_repeated_and_missing_ids(spark):
    w, v = words(70, 31), words(70, 32)
    rows = [(1, w), (1, v), (2, "a b " + w + " c"), (3, "d " + v + " e f"), (None, "g " + w), (4, words(70, 33))]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    both = {tuple(sorted((-1 if pd.isna(a) else int(a), -1 if pd.isna(b) else int(b)))) for a, b in zip(got.doc_id, got.partner_id)}
    assert (1, 2) in both and (1, 3) in both and any(-1 in p for p in both) and not any(4 in p for p in both)


def test_op6_pieces(spark, docs, library):
    got = queries.op6_packing(spark, DATA).toPandas()
    by_doc = {d: g.sort_values("piece") for d, g in got.groupby("doc_id")}
    for d, t in zip(docs.doc_id, docs.text):
        ids, g = np.append(library.ids(t), 2).astype("<u4"), by_doc[d]
        assert g.piece.tolist() == list(range(len(g))) and g.start.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() == len(ids)
        assert g.ids_crc32.tolist() == [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(g.start, g.length)] and (len(ids) > 1024 or len(g) == 1) and (g.length[g.piece > 0] == 1024).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024 and g.offset.tolist() == (g.length.cumsum() - g.length).tolist()


def test_op7_query(spark, docs):
    got = {r.doc_id: r for r in queries.op7_jaccard_join(spark, DATA).collect()}
    sets = {}
    for d, t in zip(docs.doc_id, docs.text):
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {d: d for d in sets}
    find = lambda d: d if root[d] == d else find(root[d])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(s), find(d)) for d, s in sets.items()}


def test_large_ids_beside_nulls(spark, library):
    rows = [(BIG, "token = abcdefghijkl0123456789"), (None, "x"), (BIG + 2, words(400, 3)), (None, None), (5, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    want = Counter(d for d, _ in rows)
    ids = lambda out: Counter(r.doc_id for r in out.collect())
    assert ids(secrets.find_secrets(df)) == ids(token_counts.count_tokens(df)) == ids(token_counts.count_tokens(df, chunk=300, overlap=20)) == ids(jaccard_join.similar_components(df)) == want
    assert ids(packing.pieces(df).filter("piece = 0")) == ids(packing.pack_documents(df).filter("piece = 0")) == want
    path = queries.shared_dir(spark) + "/big-ids"
    token_files.write_ids(df, path)
    assert ids(token_files.read_ids(spark, path)) == want



def test_token_file_ties_have_an_order(spark, tmp_path):
    rows = [(7, f"text {k}") for k in range(40)] + [(None, f"none {k}") for k in range(40)]
    made = []
    for k, df in enumerate((spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(rows[::-1], "doc_id long, text string"))):
        token_files.write_ids(df, str(tmp_path / f"t{k}"))
        made.append(sorted((r.start, r.ids_crc32) for r in token_files.read_ids(spark, str(tmp_path / f"t{k}")).collect()))
    assert made[0] == made[1]


def test_drop_similar_keeps_what_resembles_nothing(spark):
    w, v = words(80, 21), words(80, 22)
    rows = [(1, w), (7, w + " x"), (7, v), (None, w), (9, None), (10, ""), (1, w), (11, v + " y z"), (None, words(80, 23))]
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, __id int")
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.drop_similar(df).collect())
    assert kept == Counter([(1, w), (7, v), (9, None), (10, ""), (None, words(80, 23))])


def test_mix_gives_what_the_plan_takes(spark):
    rows = [(1, "a b c d", "s"), (1, "e f g h", "s"), (1, "a b c d", "s"), (2, "i j k l m", None), (None, "n o p q", "t"), (None, "r s t u", "t"), (3, None, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan(df).toPandas()
    out = mixing.mix(df).toPandas()
    assert len(out) == sum(map(len, plan.positions))
    times = lambda d, n: sorted(len(p) for p in plan[(plan.doc_id.fillna(-1) == d) & (plan["size"] == n)].positions)
    assert sum(times(1, 4)) == (out.doc_id == 1).sum() and out.columns.tolist() == df.columns


def test_index_places_every_row(odd):
    got = exact_dedup.exact_groups(odd, bucket_rows=2).toPandas()
    places = exact_dedup.index(odd, bucket_rows=2).toPandas()
    assert got.depth.max() > 0 and (got.link == 1).all() and len(places) == len({(r[0], r[1] or "") for r in awkward()})
    top = [(h & (2**64 - 1)) >> (64 - d) if d else 0 for h, d in zip(places.hash, places.depth)]
    assert places.bucket.tolist() == top  # the bucket is the leading bits of the hash
    assert places.groupby(["depth", "bucket"]).hash.nunique().le(2).all()


def test_hot_copies_are_combined_by_share(spark):
    texts = ["hot"] * 60 + [None] * 9 + [""] * 20 + [f"t{k % 25}" for k in range(50)] + ["hot"] * 30
    df = spark.createDataFrame([(k if k != 70 else None, t) for k, t in enumerate(texts)] + [(3, "hot")], "doc_id long, text string").repartition(5)
    places = exact_dedup.index(df, bucket_rows=8)
    assert places.groupBy("depth", "bucket", "hash").agg(F.countDistinct("owner").alias("n")).agg(F.max("n")).first()[0] > 1
    got = exact_dedup.exact_groups(df, bucket_rows=8).toPandas()
    want = pd.DataFrame([(k if k != 70 else -1, t or "") for k, t in enumerate(texts)] + [(3, "hot")], columns=["doc_id", "text"])
    best, size = want.groupby("text").doc_id.transform("max"), want.groupby("text").doc_id.transform("count")
    assert sorted(zip(got.doc_id.fillna(-1).astype(int), got.keep_id.astype(int), got.group_size)) == sorted(zip(want.doc_id, best, size))
    assert got.kept.sum() == want.text.nunique() == exact_dedup.drop_copies(df, 8).count()


def test_ablations_equal_recounts(spark, docs):
    book = quality_rules.ledger(spark.createDataFrame(docs[["doc_id", "text"]])).toPandas()
    for r in queries.rule_ablations(spark, DATA).collect():
        bit, mask = 1 << list(quality_rules.RULES).index(r["rule"]), quality_rules.PRODUCTION.mask
        bits = book.fail_bits & mask
        assert (r.rejected, r.only_this, r.kept_without) == ((bits & bit > 0).sum(), (bits == bit).sum(), (bits & ~bit == 0).sum())


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_awkward_tables(spark, odd, empty):
    """Nulls, empty and long texts, ties, repeated rows and clashing names go through every stage; an empty table stays empty."""
    docs = spark.createDataFrame([], SCHEMA) if empty else odd.withColumn("text", F.when(F.length("text") < 60, F.concat(F.col("text"), F.lit(" " + words(30, 77)))).otherwise(F.col("text")))
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA)
        if name != "packing":
            assert docs.columns == before.columns
        docs = docs.cache()
        assert docs.count() == 0 if empty else docs.count() > 0
        if name in ("quality_rules", "exact_dedup", "jaccard_join"):
            assert not Counter(docs.select("doc_id", "text").collect()) - Counter(before.select("doc_id", "text").collect())
