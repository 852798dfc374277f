"""Operator 5: a ledger of quality rules (DataFrame functions only).

Every rule is evaluated once for each document: the ledger holds the measurements and one bit for each rule that fails.
A policy is a versioned set of rules; applying it is one bitwise `and`, and ablations (what a rule alone rejects, what would
be kept without it) are counts over the few distinct bit sets, made by one aggregation.  No text is read again.

Defined results: null text has no words, which fails `few_words`; an empty table gives an empty ledger; other columns
are carried only by filter_documents.  Repeated words are found exactly: windows are compared as strings.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Words in a window of the rule on repeated words.
WINDOW = 8

#: Name -> the condition under which it fails; its place is its bit.  Conditions read the measurements.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > 0.5 * n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "shouting": "2 * n_upper > word_chars and n_words >= 20",
}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject in it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
PRODUCTION = Policy("2", tuple(RULES))


def measured(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper (long).

    All within the row: a document never leaves its task, whatever its length."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.trim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(bare) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    # explode() of one element: what stands below is computed once, not again in each lambda and filter above
    once = lambda **parts: F.explode(F.array(F.struct(*[c.alias(k) for k, c in parts.items()])))
    out = docs.select(*keep, once(__text=text, __words=words, __lines=lines).alias("__d")).select(*keep, "__d.*")
    windows = F.expr(f"if(size(__words) < {WINDOW + 1}, cast(array() as array<bigint>), transform(sequence(1, size(__words) - {WINDOW - 1}), i -> xxhash64(slice(__words, i, {WINDOW}))))")
    out = out.withColumn("__h", once(__windows=windows)).select("*", "__h.*").drop("__h")
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    # only texts with a repeated window go on to the exact count
    ranked = F.expr(f"array_sort(transform(sequence(1, size(__words) - {WINDOW - 1}), i -> struct(array_join(slice(__words, i, {WINDOW}), ' ') as w, i as at)))")
    starts = F.transform(F.array(ranked), lambda a: F.array_sort(F.transform(F.filter(F.transform(F.sequence(F.lit(1), F.size(a)), lambda k: F.struct(
        ((F.get(a, k)["w"] == F.get(a, k - 1)["w"]) | (F.coalesce(F.get(a, k - 2)["w"], F.lit("")) == F.get(a, k - 1)["w"])).alias("again"), F.get(a, k - 1)["at"].alias("at"))),
        lambda x: x["again"]), lambda x: x["at"])))
    covered = F.aggregate(F.get(starts, F.lit(0)), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                          lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).cast("long").alias("n"), p.alias("last")), lambda acc: acc["n"])
    n = lambda c: c.cast("long")
    measures = F.struct(
        n(F.size("__words")).alias("n_words"),
        n(F.length(F.array_join("__words", ""))).alias("word_chars"),
        n(F.length("__text") - F.length(F.translate("__text", "#*$%&|<>", ""))).alias("n_symbols"),
        n(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        n(F.size("__lines")).alias("n_lines"),
        F.when(twice, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        n(F.length("__text") - F.length(F.regexp_replace("__text", "[A-Z]", ""))).alias("n_upper"),
    )
    return out.select(*keep, once(m=measures).alias("__m")).select(*keep, "__m.m.*")


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), rules: dict[str, str] = RULES) -> DataFrame:
    """measured() and fail_bits (long): bit k is set if the k-th rule fails."""
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(rules.values())]
    total: Column = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs, keep).withColumn("fail_bits", total)


def passes(policy: Policy) -> Column:
    """Over a ledger: no rule of the policy fails."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablations(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """For each rule of the policy: rejected (fails it), only_this (fails nothing else of the policy), kept_without
    (kept if the rule were dropped).  One aggregation to at most 2^rules rows, then arithmetic on those."""
    sets = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in policy.rules]))
    rows = sets.withColumn("r", rule)
    has = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.lit(policy.version).alias("policy"), F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def filter_documents(docs: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """The documents that the policy keeps, with all their columns.  Measured in one pass beside the columns."""
    held = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")  # clashing names stay inside the struct
    book = ledger(docs.select(held, F.col("text").alias("text")), ("__row",))
    return book.filter(passes(policy)).select("__row.*")


_BITS = """
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from t),
win as (select doc_id, i, array_to_string(words[i:i+7], ' ') as win
        from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) as n from win) where n > 1),
rep as (select doc_id, cast(sum(least(8, nxt - i)) as bigint) as n_repeat_words
        from (select doc_id, i, coalesce(lead(i) over (partition by doc_id order by i), i + 8) as nxt from again) group by doc_id),
m as (
  select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
         cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
         coalesce(n_repeat_words, 0) as n_repeat_words, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper
  from w left join rep on w.doc_id = rep.doc_id),
b as (select *, n_words < 20 as r0, 100 * n_repeat_words > 30 * n_words as r1, n_symbols > 0.5 * n_words as r2, 2 * n_dup_lines > n_lines as r3,
             word_chars < 2 * n_words or word_chars > 20 * n_words as r4, 2 * n_upper > word_chars and n_words >= 20 as r5 from m)
"""
ORACLE = f"""{_BITS}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       cast(r0 as bigint) + 2 * cast(r1 as bigint) + 4 * cast(r2 as bigint) + 8 * cast(r3 as bigint) + 16 * cast(r4 as bigint) + 32 * cast(r5 as bigint) as fail_bits,
       r0 or r1 as base_failed, not (r0 or r1 or r2 or r3 or r4 or r5) as kept
from b
"""
_WITHOUT = [" or ".join(f"r{j}" for j in range(len(RULES)) if j != k) for k in range(len(RULES))]
ABLATIONS = _BITS + " union all ".join(
    f"select '{PRODUCTION.version}' as policy, '{rule}' as rule, count(*) filter (r{k}) as rejected, count(*) filter (r{k} and not ({_WITHOUT[k]})) as only_this, count(*) filter (not ({_WITHOUT[k]})) as kept_without from b"
    for k, rule in enumerate(RULES)
)
