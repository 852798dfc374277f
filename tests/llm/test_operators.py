"""The ten operators over the awkward table, an empty one and the smallest documents, against brute force."""

import hashlib
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, awkward, words

from tidegrain.llm import exact_dedup, jaccard_join, mixing, packing, passages, quality_rules, queries, resharding, secrets, simple8b, token_counts, token_files
from tidegrain.llm.components import components
from tidegrain.llm.tokens import Encoder

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return Encoder(use_ranks=False)


TABLE = [(r[0], r[1]) for r in awkward()]


def test_ranks_equal_the_library(library):
    fast = Encoder()
    docs = pd.read_parquet(f"{DATA}/documents.parquet").text.tolist() + [t for _, t in TABLE] + ["a\n b", "I'll  don't 'r e", "\x1c \x1c a", "it's 1234x"]
    assert all(fast.ids(t).tolist() == library.ids(t).tolist() for t in docs)


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**40, 2**64 - 1])
@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 3000])
def test_simple8b_round_trip(n, high):
    v = np.random.default_rng(n).integers(0, high, n, dtype=np.uint64, endpoint=True)
    v[::9] = 0
    w, o = simple8b.encode(v)
    assert (simple8b.decode(w, o, n) == v).all()


def test_token_files_round_trip(spark, odd, none, library, tmp_path):
    token_files.write_ids(odd, str(tmp_path / "ids"), segment_ids=500)
    got = token_files.read_ids(spark, str(tmp_path / "ids")).toPandas().sort_values("start")
    assert got.doc_id.fillna(-1).is_monotonic_increasing and got.start.tolist() == (got.n_tokens.cumsum() - got.n_tokens).tolist()
    want = Counter((d, zlib.crc32(np.append(library.ids(t), 2).astype("<u4").tobytes())) for d, t in TABLE)
    assert Counter((None if pd.isna(d) else int(d), c) for d, c in zip(got.doc_id, got.ids_crc32)) == want
    token_files.write_ids(none, str(tmp_path / "none"))
    assert token_files.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_token_counts_splice_exactly(odd, none, library):
    for chunk, overlap in ((1 << 15, 512), (300, 20)):
        got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, chunk=chunk, overlap=overlap).collect())
        assert got == Counter((d, len((t or "").encode()), len(library.ids(t))) for d, t in TABLE)
    assert token_counts.count_tokens(none).count() == 0


def test_packing(odd, none, library):
    a = packing.pack_documents(odd, part_rows=5).toPandas()
    assert sorted(a.length) == sorted(x for _, t in TABLE for n in [len(library.ids(t)) + 1] for x in [n % 1024] * (n % 1024 > 0) + [1024] * (n // 1024))
    for _, g in a.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024 and g.offset.tolist() == (g.length.cumsum() - g.length).tolist()
    assert packing.pack_documents(none).count() == 0


def test_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(1, 1025, rng.integers(1, 60))
        bins, offsets, fills = packing.best_fit_decreasing(lengths)
        assert fills.max() <= 1024 and packing.lower_bound(lengths) <= len(fills) and np.bincount(bins, weights=lengths).tolist() == fills.tolist()
    assert packing.lower_bound(np.array([600, 600, 600])) == 3


def test_min_cost_flow_moves_the_least():
    supply, capacity = [50, 10, 0, 40], [25, 25, 25, 25]
    flow = resharding.min_cost_flow(supply, capacity)
    assert sum(n for (i, j), n in flow.items() if i != j) == sum(max(0, s - c) for s, c in zip(supply, capacity)) == 40
    costly = resharding.min_cost_flow([3, 3], [3, 3], lambda i, j: [[5, 1], [1, 9]][i][j])
    assert costly == {(0, 1): 3, (1, 0): 3}


def test_resharding(spark, odd, none, tmp_path):
    old = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    plan = resharding.reshard(odd, old, 3, 4)
    a = plan.toPandas()
    assert len(a) == len(TABLE) and all(sorted(g.slot) == list(range(len(g))) for _, g in a.groupby("shard"))
    assert a["size"].sum() == sum(len((t or "").encode()) + 1 for _, t in TABLE)
    made = resharding.solve(odd, old, 3, 4)
    touched = resharding.write_affected(odd, old, made, str(tmp_path / "shards"))
    assert touched == made.touched and spark.read.parquet(str(tmp_path / "shards")).count() == a.shard.isin(touched).sum()
    assert resharding.reshard(none, old, 3, 4).count() == 0


def test_resharding_query_moves_the_texts(spark, odd, none, tmp_path):
    got = queries.op1_reshard(spark, DATA).toPandas()
    made = [p for p in Path(queries.shared_dir(spark).removeprefix("file:")).resolve().glob("resharded-*")]
    files = pd.concat([spark.read.parquet(f"file://{p}").select("doc_id", "text", "shard").toPandas() for p in made])
    held = {r.doc_id: (zlib.crc32((r.text or "").encode()), r.shard) for r in files.itertuples()}
    moved = got[got.shard != got.old_shard]
    assert len(moved) and all(held[r.doc_id] == (r.text_crc32, r.shard) for r in moved.itertuples())
    docs = pd.read_parquet(f"{DATA}/documents.parquet")
    assert Counter(zip(got.doc_id, got.text_crc32)) == Counter((d, zlib.crc32((t or "").encode())) for d, t in zip(docs.doc_id, docs.text))
    old = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))
    whole = lambda df: Counter((r["size"], r.text_crc32, r.shard, r.slot) for r in df.collect())
    assert whole(resharding.resharded(odd, old, 3, 4, str(tmp_path / "odd"))) == whole(resharding.reshard(odd, old, 3, 4))
    assert resharding.resharded(none, old, 3, 4, str(tmp_path / "none")).count() == 0


def test_secrets(odd, none):
    rows = {r.doc_id: r for r in secrets.find_secrets(odd).collect()}
    text = dict(TABLE)[12]
    m = [(x.start(), k, x.end()) for k, p in enumerate((secrets.BASE[0][1], re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"))) for x in p.finditer(text) if x.end(2 if k == 0 else 0) - x.start(2 if k == 0 else 0) >= (12, 18, 16)[k]]
    base = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(m))
    assert rows[12].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (rows[12].n_assign, rows[12].n_access, rows[12].n_hex) == (1, 1, 1)
    assert rows[13].n_owned == rows[14].n_owned == 1 and rows[13].spans == "owned:4:24"
    spread = odd.withColumn("source", F.col("doc_id").cast("string"))
    assert {r.n_owned for r in secrets.find_secrets(spread).collect()} == {0}  # several owners: an example
    assert secrets.find_secrets(none).count() == 0
    assert secrets.base_spans('password="secret":"abcdefghijklmnop"') == []


def test_secrets_count_every_occurrence_of_a_value(spark):
    copied, keyed, spread, live = (f"zX9q8Kp4Lm2Rt7Yv1Bn6{c}" for c in "abcd")
    docs = [
        (1, f"see {copied} here", "en", "s1"), (2, f"token = {copied}", "en", "s2"),  # bare here, a base match there
        (3, f"see {keyed} here", "en", "s3"), (4, f"see MY_KEY={keyed} here", "en", "s4"),
        (5, f"see {spread} here", "en", "s5"), (6, f"see {spread} here", "fr", "s5"),  # two repositories of one owner
        (7, f"see {live} here", "en", "s6"), (8, f"token = {live}", "en", "s6"), (9, f"MY_KEY={live}", "en", "s6"),
    ]
    got = {r.doc_id: r.n_owned for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0, 7: 1, 8: 0, 9: 1}


def test_chains_and_alignment():
    assert passages.common_words(list("abcbdab"), list("bdcaba")) == 4
    best = passages.chains([0, 5, 10, 12], [100, 105, 40, 112], [8] * 4)[0]
    assert best[:4] == (0, 20, 100, 120)


def test_passages(spark, none):
    shared, rng = words(70, 9), np.random.default_rng(4)
    edited = shared.split()
    edited[35] = "changed"
    docs = [(1, words(80, 11) + " " + shared), (2, shared + " " + words(90, 12)), (3, words(30, 13) + " " + " ".join(edited) + " tail"), (4, words(200, 14)), (5, None), (6, words(200, 14)), (7, words(40, 9)), (8, words(90, 15))]
    rng.shuffle(docs)
    got = passages.repeated_passages(spark.createDataFrame([(int(i), t) for i, t in docs], "doc_id long, text string")).toPandas()
    assert set(got.doc_id) | set(got.partner_id) == {1, 2, 3, 4, 6}
    assert ((got.end_word - got.start_word) >= 50).all() and passages.repeated_passages(none).count() == 0


def _edited(shared, every, kind, rng):
    out = []
    for i, w in enumerate(shared):
        hit = i % every == every // 2
        out += [w] if not hit else [f"s{rng.integers(1 << 40)}"] if kind == 0 else [] if kind == 1 else [w, f"i{rng.integers(1 << 40)}"]
    return out


def test_passages_find_edited_ones(spark):
    """60 and 100 words at identities from 0.8 up; the whole-table oracle is that each pair reaches them by its own LCS."""
    rng, docs, want = np.random.default_rng(3), [], set()
    fresh = lambda n: [f"r{x}" for x in rng.integers(1 << 40, size=n)]
    for n in (60, 100):
        for every in (5, 6, 8, 10, 12, 20):
            for kind in range(3):
                for _ in range(3):
                    a, i = fresh(n), len(docs)
                    b = _edited(a, every, kind, rng)
                    assert min(len(a), len(b)) >= 50 or kind == 1
                    if min(len(a), len(b)) >= 50 and 2 * passages.common_words(a, b) / (len(a) + len(b)) >= 0.8:
                        want.add((i, i + 1))
                    docs += [(i, " ".join(fresh(40) + a + fresh(30))), (i + 1, " ".join(fresh(25) + b + fresh(60)))]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert ((got.end_word - got.start_word >= 50) & (got.partner_end - got.partner_start >= 50) & (got.identity >= 0.8)).all()
    pairs = {(min(p), max(p)) for p in zip(got.doc_id, got.partner_id)}
    assert len(want) > 90 and pairs == want


def test_passages_beside_holders_of_their_phrases(spark):
    """Two documents share a passage; four others hold each of its phrases, and most have smaller nodes."""
    rng = np.random.default_rng(7)
    fresh = lambda n: [f"r{x}" for x in rng.integers(1 << 40, size=n)]
    docs = []
    for k in range(20):
        a = fresh(55)
        docs += [(100 * k, " ".join(fresh(30) + a + fresh(20))), (100 * k + 1, " ".join(fresh(20) + a + fresh(30)))]
        docs += [(100 * k + 2 + 4 * i + j, " ".join(fresh(20) + a[11 * i : 11 * i + 14] + fresh(20))) for i in range(5) for j in range(4)]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).toPandas()
    assert {(min(p), max(p)) for p in zip(got.doc_id, got.partner_id)} == {(100 * k, 100 * k + 1) for k in range(20)}


def _shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("apart", [32, 2])
def test_jaccard_components(spark, none, monkeypatch, apart):
    monkeypatch.setattr(jaccard_join, "SMALL", apart)
    rng = np.random.default_rng(8)
    docs = [(i, words(120, i % 3)) for i in range(4)] + [(4, None), (5, ""), (6, "A b"), (7, "a B"), (7, "a b"), (None, words(120, 1))]
    for i in range(10, 60):
        w = words(150, 20).split()
        for at in rng.integers(0, 150, rng.integers(0, 5)):
            w[at] = f"edit{i}{at}"
        docs.append((i, " ".join(w)))
    for i in range(60, 160):  # a group in groups: blocks left out or put in, and edits on top
        w = words(150, 30 + i % 3 // 2).split()
        at = int(rng.integers(0, 120))
        w[at : at + int(rng.integers(0, 3)) * 6] = words(int(rng.integers(0, 3)) * 5, 40 + i % 4).split()
        for at in rng.integers(0, 100, rng.integers(0, 3)):
            w[at] = f"edit{i % 40}{at}"
        docs.append((i, " ".join(w)))
    got = jaccard_join.similar_components(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).toPandas()
    sets = [_shingles(t, 4) for _, t in docs]
    root = list(range(len(docs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    want = Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs))
    whole = lambda x: None if pd.isna(x) else int(x)
    assert Counter((whole(r.doc_id), r.n_shingles, whole(r.component_id)) for r in got.itertuples()) == want
    assert jaccard_join.similar_components(none).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 90), (90, 95)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 90, 90: 90, 95: 90}


def test_exact_dedup(odd, none):
    got = exact_dedup.exact_groups(odd, bucket_rows=2).collect()
    groups = defaultdict(list)
    for d, t in TABLE:
        groups[t or ""].append(d)
    want = Counter((d, max(groups[t or ""], key=lambda x: -1 if x is None else x), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in TABLE)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) == exact_dedup.drop_copies(odd, 2).count()
    assert exact_dedup.drop_copies(odd, 2).columns == odd.columns and exact_dedup.exact_groups(none).count() == 0


def test_mixing(odd, none):
    a = mixing.plan(odd).toPandas()
    assert len(a) == len(TABLE) and (a.taken <= 3 * a["size"]).all() and a["size"].sum() == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in TABLE)
    sums = a.fillna({"source": "~"}).groupby("source").agg(t=("target", "first"), k=("taken", "sum"))
    assert (abs(sums.t - sums.k) <= 1).all()
    assert mixing.plan(none).count() == 0 and mixing.mix(odd).columns == odd.columns
    again = mixing.plan(odd.repartition(7)).toPandas()
    key = lambda d: sorted(zip(d.doc_id.fillna(-1), d["size"], d.taken))
    assert key(a) == key(again)


def test_curriculum_positions(odd):
    flat = mixing.plan(odd, start=(1, 1, 1), end=(1, 1, 1)).toPandas()
    positions = [p for x in flat.positions for p in x]
    assert all(0 <= p <= 1 for p in positions)
    late = mixing.plan(odd, start=(0, 0, 0), end=(1, 1, 1)).toPandas()
    assert np.mean([p for x in late.positions for p in x]) > np.mean(positions)  # words come later under a rising schedule


def test_quality_rules(odd, none):
    book = quality_rules.ledger(odd)
    rows = Counter((r.doc_id, r.n_words) for r in book.collect())
    assert rows == Counter((d, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, t in TABLE)
    kept = quality_rules.filter_documents(odd)
    assert kept.columns == odd.columns and kept.count() == book.filter(quality_rules.passes(quality_rules.PRODUCTION)).count()
    ab = {r.rule: r for r in quality_rules.ablations(book).collect()}
    assert ab["few_words"].rejected == book.filter("n_words < 20").count()
    assert quality_rules.ledger(none).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        con.sql(f"create view {table} as select * from read_parquet('{DATA}/{table}.parquet')")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda df: df[cols].sort_values(cols, ignore_index=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


@pytest.mark.parametrize("holders", [2, 6, 10, 40])
def test_a_changed_passage_is_found_whatever_the_number_of_its_holders(spark, holders):
    stretch = [f"p{k}" for k in range(54)]
    texts = [(k, " ".join([f"a{k}x{i}" for i in range(30)] + stretch + [f"b{k}x{i}" for i in range(30)])) for k in range(holders)]
    changed = [f"z{k}" if k % 5 == 4 else w for k, w in enumerate(stretch)]
    rows = passages.repeated_passages(spark.createDataFrame([*texts, (1000, " ".join([f"c{i}" for i in range(30)] + changed + [f"d{i}" for i in range(30)]))], "doc_id long, text string")).collect()
    found = {r.doc_id for r in rows} | {r.partner_id for r in rows}
    assert found >= {1000, *range(holders)}
