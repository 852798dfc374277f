"""Operator 3: secret scan with corpus-wide ownership of candidates.

One pass finds the base matches of each text and, beside them, candidates: runs of 20 and more characters of keys and
tokens that mix letters and digits and have the entropy of random strings.  Values are known by a hash: those of all
candidates, a run `KEY=VALUE` by its value, and those of all base matches.  Over the whole corpus, each hash is counted by
distinct repositories and owners (here source and lang, source).  A value that several owners or repositories carry is a copied
example; a value of a single repository is taken for a live credential and its runs are added to the spans of the documents, as kind `owned`, unless a base match covers them.

Counting is two aggregations with map-side combining (hash, owner, repository), then (hash), so a value in a third of all rows
reaches each reducer as one row for each task.  Only documents with candidates take part in the joins.

Defined results: null text counts as empty; a null owner or repository is an owner or repository of its own; rows equal in doc_id
each get their row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import id_columns, ids, small_side, written

#: Base kinds in their order: pattern, group whose length counts, least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]{14,}"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),
)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Least bits of entropy a character in a candidate.
ENTROPY = 3.5
#: Least length of what follows `=` in a run to count as its value.
VALUE = 12


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the base matches, sorted.  A run of access or hex characters is a match as a whole or
    not at all, so their patterns ask for the least length at once; a short assignment still consumes its text."""
    return sorted((m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(BASE) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the runs that look live."""
    found = []
    for m in _RUN.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= ENTROPY:
            found.append(m.span())
    return found


def value_of(run: str) -> str:
    """The value in a run: without padding, and without a key before `=`."""
    run = run.rstrip("=.")
    value = run.rpartition("=")[2]
    return value if len(value) >= VALUE else run


def value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def base_value(text: str, kind: int, start: int, end: int) -> str:
    """The value of a base match."""
    _, pattern, group, _ = BASE[kind]
    return pattern.match(text, start, end)[group]


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per document: doc_id, owner, repository, n_assign, n_access, n_hex, base_sha256, base (kind:start:end
    each), extra (candidates that no base match covers: value_hash, start, end), seen (hashes of all values)."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch.pop("text"):
                base = base_spans(text)
                listed = [f"{BASE[k][0]}:{a}:{b}" for a, k, b in base]
                counts = [sum(k == i for _, k, _ in base) for i in range(len(BASE))]
                runs = [(value_hash(value_of(text[a:b])), a, b) for a, b in candidates(text)]
                extra = [{"value": v, "start": a, "end": b} for v, a, b in runs if not any(x <= a and b <= y for x, _, y in base)]
                seen = {v for v, _, _ in runs} | {value_hash(value_of(base_value(text, k, a, b))) for a, k, b in base}
                out.append((*counts, hashlib.sha256(",".join(listed).encode()).hexdigest(), listed, extra, list(seen)))
            made = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "base", "extra", "seen"], index=batch.index)
            yield pd.concat([batch.assign(doc_id=ids(batch)).drop(columns="no_id"), made], axis=1)

    rows = docs.select(*id_columns(docs), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(find, "doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, base array<string>, extra array<struct<value: long, start: long, end: long>>, seen array<long>")


def ownership(scanned: DataFrame) -> DataFrame:
    """For each value hash: documents, repositories, owners, verdict (`live`: one owner and one repository, else `example`)."""
    seen = scanned.select("owner", "repository", F.explode("seen").alias("value")).groupBy("value", "owner", "repository").agg(F.count("*").alias("documents"))
    owners = seen.groupBy("value", "owner").agg(F.count("*").alias("repositories"), F.sum("documents").alias("documents"))
    out = owners.groupBy("value").agg(F.sum("documents").alias("documents"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))
    return out.withColumn("verdict", F.when((F.col("owners") == 1) & (F.col("repositories") == 1), "live").otherwise("example"))


def find_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned."""
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    found = scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "scan")  # the row numbers are fixed here
    live = written(ownership(found).filter("verdict = 'live'").select("value"), "live")
    runs = found.filter(F.size("extra") > 0).select("row", F.explode("extra").alias("x")).select("row", F.col("x.value").alias("value"), F.struct(F.col("x.start").alias("start"), F.lit(len(BASE)).alias("k"), F.col("x.end").alias("end")).alias("at"))
    owned = runs.join(small_side(live), "value").groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("owned"))
    out = found.join(small_side(written(owned, "owned")), "row", "left")
    out = out.withColumn("owned", F.coalesce("owned", F.array().cast("array<struct<start: bigint, k: int, end: bigint>>")))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", _listed().alias("spans"), F.size("owned").cast("long").alias("n_owned"))


def _listed() -> Column:
    """All spans, comma-joined by start, then kind."""
    kinds = [name for name, *_ in BASE]
    base = F.transform("base", lambda s: F.struct(
        F.split(s, ":")[1].cast("long").alias("start"), (F.array_position(F.array(*map(F.lit, kinds)), F.split(s, ":")[0]) - 1).cast("int").alias("k"), s.alias("text")))
    extra = F.transform("owned", lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), F.concat_ws(":", F.lit("owned"), x["start"], x["end"]).alias("text")))
    return F.array_join(F.transform(F.array_sort(F.concat(base, extra)), lambda x: x["text"]), ",")
