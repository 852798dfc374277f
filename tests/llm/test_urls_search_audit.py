"""Operators 11 to 13: brute force on awkward tables, and what each method has to find.  Their SQL runs with that of the others."""

import math
import re
import sys
from collections import Counter
from itertools import permutations
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from helpers import SCHEMA, awkward, words

from tidegrain.llm import filter_audit, lexical_search, queries, url_templates

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "labels", "benchmark")
LABELS = "doc_id long, quality int, toxic int, text string"
URLS = "page_id long, url string, html string, host string, template string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(awkward(), SCHEMA)


def same(got, want):
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda df: df[cols].sort_values(cols, ignore_index=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, rtol=1e-12)


def in_sql(sql, **tables):
    con = duckdb.connect()
    for name in TABLES:
        con.register(name, tables[name]) if name in tables else con.sql(f"create view {name} as select * from read_parquet('{DATA}/{name}.parquet')")
    return con.sql(sql).df()


# op11


def _verdicts(spark, rows, rules=url_templates.RULES):
    return {r.page_id: r for r in url_templates.judge(spark.createDataFrame([(k, u, b) for k, (u, b) in enumerate(rows)], "page_id long, url string, bad int"), "bad", rules).collect()}


def test_urls_are_cut_and_ruled(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no url": ("", "", None), "a://": ("", "", None), "HTTP://Ä.Example.NET/en/x?y#z": ("Ä.example.net", "/en/x", "example.net/en/"),
        "x://a.net": ("a.net", "", None), "x://a.net?q=/": ("a.net", "", None), "x://a.net/": ("a.net", "/", "net/"), "x://net/q": ("net", "/q", "net/"), "x://planet/q": ("planet", "/q", None),
        "x://www.example.com/de/1#/fr/": ("www.example.com", "/de/1", "example.com/de/"), "x://myexample.com/de/1": ("myexample.com", "/de/1", None), "x://example.com/de": ("example.com", "/de", None),
        "x://b.org/fr/?//": ("b.org", "/fr/", "org/fr/"), "q?x://b.org/fr/1": ("b.org", "/fr/1", "org/fr/"), "x://h/\n/2": ("h", "/\n/2", None), "x://y://z": ("y:", "//z", None),
    }
    got = _verdicts(spark, [(u, None) for u in cases])
    assert [(got[k].host, got[k].path, got[k].rule) for k in range(len(cases))] == list(cases.values())
    verdict = {f"{h}{p}": v for v, h, p in url_templates.RULES}
    assert all(r.verdict == verdict.get(r.rule, "allow") for r in got.values())


def test_bad_branches_are_rejected_and_others_merge(spark):
    rows = [(f"http://shop.test/{a}/{k}.html", None) for a in ("de", "en", "fr") for k in range(60)]
    rows += [(f"http://shop.test/{a}/{k}", int(a == "win" or k % 20 == 0)) for a in ("news", "blog", "win") for k in range(100)]
    rows += [("http://shop.test/win/now", None), ("http://shop.test/rare/5", None), ("http://farm.test/" + "/".join("abcdefghijk"), None)]
    rows += [(f"http://farm.test/x{k}/y", 1) for k in range(40)]
    got = _verdicts(spark, rows, ())
    by = {u: got[k] for k, (u, _) in enumerate(rows)}
    assert by["http://shop.test/win/7"].template == "/win/*" and by["http://shop.test/win/7"].verdict == by["http://shop.test/win/now"].verdict == "block"
    assert by["http://shop.test/news/7"].template == by["http://shop.test/blog/8"].template and by["http://shop.test/en/5.html"].template == by["http://shop.test/fr/5.html"].template
    assert by["http://shop.test/rare/5"].template == "/*/*" and len({r.template for u, r in by.items() if "shop" in u}) == 4
    assert {r.verdict for u, r in by.items() if "shop" in u and "win" not in u} == {"allow"}
    assert by["http://farm.test/x3/y"].verdict == "block" and by["http://farm.test/" + "/".join("abcdefghijk")].template.count("/") == url_templates.DEPTH
    # the same in SQL, where labels come by documents: each page's number is that of a document of its own
    pages = pd.DataFrame({"page_id": range(len(rows)), "url": [re.sub(r"/(\d+)(\.html)?$", rf"/{k}\2", u) if re.search(r"/\d+(\.html)?$", u) else f"{u}/{k}" for k, (u, _) in enumerate(rows)]})
    labels = pd.DataFrame([(k, 1 - b, 0) for k, (_, b) in enumerate(rows) if b is not None], columns=["doc_id", "quality", "toxic"])
    known = url_templates.with_document_labels(spark.createDataFrame(pages), spark.createDataFrame(labels))
    same(url_templates.judge(known, "bad").withColumn("purity", F.round("purity", 9)).toPandas(), in_sql(url_templates.ORACLE, pages=pages, labels=labels))


def test_urls_of_awkward_tables(spark):
    rows = [(1, "http://a.test/1", "<p>", "clash", "clash"), (1, "http://a.test/1", "<p>", None, None), (None, "http://a.test/7.html", None, "", ""), (4, None, None, None, None), (5, "http://" + "b" * 5000 + "/" + "c/" * 3000, "", "", "")]
    pages, labels = spark.createDataFrame(rows, URLS), spark.createDataFrame([(7, 0, None, "x"), (7, None, None, None), (1, None, None, None), (None, 1, 1, None)], LABELS)
    known = url_templates.with_document_labels(pages, labels)
    assert Counter((r.page_id, r.bad) for r in known.collect()) == Counter([(1, None), (1, None), (None, 1), (4, None), (5, None)])
    assert Counter((r.page_id, r.verdict) for r in url_templates.judge(known, "bad").collect()) == Counter([(1, "allow"), (1, "allow"), (None, "allow"), (4, "allow"), (5, "allow")])
    empty = url_templates.with_document_labels(spark.createDataFrame([], URLS), labels)
    assert url_templates.judge(empty, "bad").count() == 0 == url_templates.judge(empty).count()


# op12

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def _terms(text):
    return TERM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def _ranked(docs, items, k=10):
    rows = [(d, _terms(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in rows), sum(len(t) for _, t in rows)
    df = Counter(t for _, terms in rows for t in set(terms))
    out = Counter()
    for item, text in items:
        found = []
        for at, (d, terms) in enumerate(rows):
            m, tf = 10 + 90 * len(terms) * n_docs // max(1, total), Counter(terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in dict.fromkeys(_terms(text)) if tf[t])
            if score > 0:
                found.append((-score, d is None, d or 0, at))
        out.update((item, r + 1, None if none else d, -s) for r, (s, none, d, _) in enumerate(sorted(found)[:k]))
    return out


def test_ranks_equal_brute_force(spark, odd, monkeypatch):
    items = [(1, "one TWO"), (1, "one TWO"), (None, words(40, 2)), (3, None), (4, "?!"), (5, "日本 語。漢字 NAÏVE ï"), (6, "a b c d zz9"), (7, "nowhere"), (8, "x" * 70000)]
    copies = [(20 + k % 3, "hot copy of one text", "en", "s", 1, 7, "", "") for k in range(30)]
    table = awkward() + copies
    docs, asked = spark.createDataFrame(table, SCHEMA), spark.createDataFrame([(i, t, "clash") for i, t in [*items, (9, "hot one")]], "item_id long, text string, score string")
    want = _ranked([r[:2] for r in table], [*items, (9, "hot one")])
    got = lambda: Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical_search.ranked(spark, docs, asked).collect())
    assert got() == want
    monkeypatch.setattr(lexical_search, "ITEMS", 2)
    assert got() == want


def test_blocks_are_closed_and_bounds_hold():
    block, texts = lexical_search._Block(5), [b"a b a", b"b " * 300 + b"a", b"c"]
    for k, t in enumerate(texts):
        block.add(k, False, lexical_search.terms_of(t))
    rows = block.rows(3, 305).set_index("term")
    import numpy as np

    for term in ("a", "b", "c"):
        r = rows.loc[term]
        docs, levels, tf = np.frombuffer(r.docs, "<u2"), np.frombuffer(r.levels, "u1").astype(int), np.frombuffer(r.counts, "<u4").astype(int)
        m = np.array([10 + 90 * len(texts[d].split()) * 3 // 305 for d in docs])
        exact = 10**9 * tf // (1000 * tf + 8 * m)
        assert (levels * r.step >= exact).all() and ((levels - 1) * r.step < exact).all() and levels.max() <= 255


def test_small_blocks_give_the_same(spark, odd, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 7)
    monkeypatch.setattr(lexical_search, "small_enough", lambda *_: False)
    same(lexical_search.ranked(spark, docs, items).toPandas(), in_sql(lexical_search.ORACLE))


def test_search_of_empty_tables(spark, odd):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert lexical_search.ranked(spark, none, items).count() == 0
    assert lexical_search.ranked(spark, odd, items.limit(0)).count() == 0


# op13


def _audited(docs, labels):
    said = {}
    for d, q, t in labels:
        if d is not None:
            a, b = said.get(d, (0, 0))
            said[d] = (a or int(q == 1), b or int(t == 1))
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    rows = []
    for d, t, s in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        repeated = t in least and (d is None or d > least[t])
        rows.append((s or "", dict(zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), repeated))), said.get(d, (0, 0)) if d is not None else (0, 0)))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == part]
        value = Counter()
        for p in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(p):
                gone, stay = [r for r in left if r[0][f]], [r for r in left if not r[0][f]]
                value[f] += len(gone)
                out[part, "".join(p), k + 1] = [len(stay), len(gone), sum(r[0][f] for r in mine) - len(gone), sum(r[0][f] and sum(r[0].values()) == 1 for r in mine), sum(r[1][0] for r in gone), sum(r[1][1] for r in gone), f]
                left = stay
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = value[out[key][-1]]
    return out


LOSSES = [(5, 1, 0, "t"), (6, 1, 0, "t"), (6, 0, 1, None), (9, None, None, None), (None, 1, 1, None), (14, 0, 1, "")]


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda *_: F.lit(0)], ids=["hashes", "hashes that clash"])
def test_audit_equals_brute_force(spark, hashed):
    table = awkward() + [(30, "A b", "en", None, 1, 7, "", ""), (31, "A c", "en", None, 1, 7, "", ""), (None, "A b", "en", None, 1, 7, "", ""), (28, "A b", "en", "", 1, 7, "", ""), (None, "lonely", "en", "z", 1, 7, "", ""), (None, "lonely", "en", "z", 1, 7, "", "")]
    long_ = words(9000, 3)
    table += [(40, long_ + " end", "en", "z", 1, 7, "", ""), (41, long_ + " eno", "en", "z", 1, 7, "", ""), (42, long_ + " end", "en", "z", 1, 7, "", "")]
    got = filter_audit.audit(spark.createDataFrame(table, SCHEMA), spark.createDataFrame(LOSSES, LABELS), hashed).collect()
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == _audited([(r[0], r[1], r[3]) for r in table], [r[:3] for r in LOSSES])
    assert len(got) == 600 * len({r[3] or "" for r in table})


def test_audit_of_an_empty_table(spark):
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), spark.createDataFrame(LOSSES, LABELS)).count() == 0
