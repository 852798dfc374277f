"""Operator 11: url filters by a tree of path templates for each host (DataFrame functions only).

A url has a host and a path.  Rules of (host, path) come first, the longest one that fits.  Where none fits, the url's template decides.
The tree of a host grows level by level over its paths, one segment each:

- digits, and runs of letters and digits that look like identifiers, are variable in any segment and become `#`;
- the values that a segment takes below one node are branches.  A branch is compared with its siblings together: by the share of its
  pages that are labelled bad, by the share that is labelled at all, and by the share that ends at it.  Branches none of whose shares
  differs significantly from the rest merge into the wildcard `*`.  Of those that do differ, the ones with like shares, in bins of the
  arc sine of their root, which has the same spread for any share, merge into a wildcard named by its bins; one without a like stays;
- segments beyond DEPTH are one variable tail.

A template's purity is the share of bad pages among its labelled ones, smoothed towards that of its host, that one towards the share
over all hosts, and that one towards 0.  Templates whose purity reaches the limit are rejected.

All counts are sums over distinct paths with variable segments masked, added up inside the tasks before anything is shuffled, so a host
with a third of all pages weighs as much as it has masked paths.  A branch meets the sums of its siblings, never each of them.

Defined results: a null url, or one without `://`, has an empty host and an empty path, and no rule fits it; urls without a host are
judged like those of any other host; a page without a label, or with a null one, counts for shares but not for purity; repeated rows
count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Scratch, written

#: (verdict, host, path).  At most MOST_RULES, as they are part of the plan.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_RULES = 1000
#: Levels of the tree.
DEPTH = 6
#: Standard deviations by which a branch differs from its siblings, and pages that it and they have at least.
DIFFERS, BRANCH = 4.0, 20
#: Labelled pages that a host's, or all hosts', share weighs as many as; smoothed share of bad pages that rejects.
STRENGTH, REJECT = 10.0, 0.5
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: What is variable in a segment: hexadecimal digests, identifiers of letters and digits, then digits.
_VARIABLE = ((r"[0-9a-fA-F]{16,}", "#"), (r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]{11,}", "#"), (r"[0-9]+", "#"))


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct<size, rule, verdict> of the longest rule that fits, of equally long ones the last in code-point order; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size: int, rule: string, verdict: string>")


def masked(path: Column) -> Column:
    """The path's segments with what is variable in them replaced, those beyond DEPTH as one."""
    for pattern, mark in _VARIABLE:
        path = F.regexp_replace(path, pattern, mark)
    parts = F.split(path, "/")
    return F.when(F.size(parts) > DEPTH + 1, F.concat(F.slice(parts, 2, DEPTH - 1), F.array(F.lit("**")))).otherwise(F.slice(parts, 2, DEPTH + 1))


def _apart(branch: Column, of: Column, all_branch: Column, all_of: Column) -> Column:
    """Whether a branch's share branch / of differs from that of its siblings: (all_branch - branch) / (all_of - of)."""
    rest, rest_of, share = all_branch - branch, all_of - of, F.try_divide(all_branch, all_of)
    spread = share * (1 - share) * (F.try_divide(F.lit(1), of) + F.try_divide(F.lit(1), rest_of))
    gap = F.try_divide(branch, of) - F.try_divide(rest, rest_of)
    return (of >= BRANCH) & (rest_of >= BRANCH) & (gap * gap > DIFFERS * DIFFERS * spread)


def _bin(share: Column, of: Column) -> Column:
    """Two shares of one bin are within DIFFERS standard deviations of the smallest branch that is compared."""
    level = F.floor(F.asin(F.sqrt(F.try_divide(share, of))) / F.lit(DIFFERS / (2 * math.sqrt(BRANCH))))
    return F.when(of >= BRANCH, level.cast("string")).otherwise(F.lit("-"))


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, segments, template) for every host and masked path of pages(host, path, bad); bad: 1, 0 or null without a label."""
    sums = [F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad")]
    base = pages.select("host", masked(F.col("path")).alias("segments"), F.lit(1).cast("long").alias("n"), F.when(F.col("bad").isNotNull(), 1).otherwise(0).alias("known"), F.coalesce(F.col("bad"), F.lit(0)).alias("bad"))
    open_ = scratch.written(base.groupBy("host", "segments").agg(*sums).withColumn("template", F.lit("")), "paths")
    done = open_.filter(F.size("segments") == 0).drop("n", "known", "bad")
    for level in range(DEPTH):
        open_ = open_.filter(F.size("segments") > level)
        if open_.isEmpty():
            break
        open_ = open_.withColumn("branch", F.get("segments", F.lit(level)))
        ends = F.sum(F.when(F.size("segments") == level + 1, F.col("n")).otherwise(0)).alias("ends")
        branches = scratch.written(open_.groupBy("host", "template", "branch").agg(*sums, ends), "branches")
        whole = branches.groupBy("host", "template").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "known", "bad", "ends")])
        apart = [_apart(F.col(a), F.col(b), F.col(f"all_{a}"), F.col(f"all_{b}")) for a, b in (("bad", "known"), ("known", "n"), ("ends", "n"))]
        differ = branches.join(small_strings(whole), ["host", "template"]).filter(apart[0] | apart[1] | apart[2])
        bins = F.concat_ws(".", *[_bin(F.col(a), F.col(b)) for a, b in (("bad", "known"), ("known", "n"), ("ends", "n"))])
        differ = scratch.written(differ.select("host", "template", "branch", bins.alias("bins")), "differ")
        alike = differ.groupBy("host", "template", "bins").agg(F.when(F.count("*") == 1, F.min("branch")).otherwise(F.concat(F.lit("*"), F.col("bins"))).alias("name"))
        names = scratch.written(differ.join(small_strings(alike), ["host", "template", "bins"]).drop("bins"), "names")
        named = F.when(F.col("branch") == "", F.lit("")).otherwise(F.coalesce("name", F.lit("*")))
        open_ = open_.join(small_strings(names), ["host", "template", "branch"], "left").withColumn("template", F.concat("template", F.lit("/"), named)).drop("name", "branch")
        open_ = scratch.written(open_, "paths")
        done = done.unionByName(open_.filter(F.size("segments") == level + 1).drop("n", "known", "bad"))
    return done


def purity(pages: DataFrame) -> DataFrame:
    """(host, template, purity) from pages(host, template, bad)."""
    count = [F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")]
    by_template = pages.groupBy("host", "template").agg(*count)
    smooth = lambda bad, known, prior: (F.col(bad) + STRENGTH * prior) / (F.col(known) + STRENGTH)
    by_host = by_template.groupBy("host").agg(F.sum("known").alias("host_known"), F.sum("bad").alias("host_bad"))
    known, bad = by_host.agg(F.sum("host_known"), F.sum("host_bad")).first()  # two totals
    hosts = by_host.select("host", smooth("host_bad", "host_known", F.lit((bad or 0) / ((known or 0) + STRENGTH))).alias("host_purity"))
    return by_template.join(small_strings(hosts), "host").select("host", "template", smooth("bad", "known", F.col("host_purity")).alias("purity"))


def small_strings(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """df with a broadcast hint if its rows and the bytes of its strings were added up and fit; a table that is too large for the first
    of both counts is not added up at all."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if kind == "string" else F.lit(16) for c, kind in df.dtypes), F.lit(32))
    at_most = limit // 48
    size = df.limit(at_most + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(df) if size[0] <= at_most and (size[1] or 0) <= limit else df


def judge(pages: DataFrame, bad: str | None = None, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) for every row of pages(page_id, url); bad: the column with some pages' 1 or 0."""
    scratch = Scratch(pages.sparkSession, "urls")
    label = F.col(bad).cast("int") if bad else F.lit(None).cast("int")
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), label.alias("bad"))
    parsed = scratch.written(parsed, "parsed")
    tree = scratch.written(templates(parsed, scratch), "tree")
    flat = lambda segments: F.array_join(F.transform(segments, lambda s: F.concat(F.lit("/"), s)), "")  # noqa: E731  strings, to meet by
    places = small_strings(tree.select("host", flat("segments").alias("__at"), "template"))
    placed = parsed.withColumn("__at", flat(masked(F.col("path")))).join(places, ["host", "__at"], "left").drop("__at")
    placed = scratch.written(placed, "placed")
    pure = scratch.written(purity(placed), "purity")
    out = placed.join(small_strings(pure), ["host", "template"], "left").withColumn("__r", fitting_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    out = written(out.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), F.coalesce(F.col("__r.verdict"), method).alias("verdict"), "template", "purity"), "judged")
    scratch.drop()
    return out


def with_document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, url, bad) from labels(doc_id, quality, toxic): a page shows the document whose number ends its path; it is bad if that is
    toxic or of low quality.  Pages without such a number meet no label, each under a key of its own."""
    number = F.expr("try_cast(regexp_extract(__path, '/([0-9]+)[^/0-9]*/?$', 1) as bigint)")
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad")
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__doc"), F.lit(True).alias("__real")).agg(bad)
    shown = pages.select("page_id", "url", path(F.col("url")).alias("__path")).withColumn("__doc", number).withColumn("__real", F.col("__doc").isNotNull())
    return shown.withColumn("__doc", F.coalesce("__doc", F.xxhash64("url", "page_id"))).join(said, ["__doc", "__real"], "left").select("page_id", "url", "bad")


def _oracle() -> str:
    """The tree in SQL, one level after the other."""
    mask = "path"
    for pattern, mark in _VARIABLE:
        mask = f"regexp_replace({mask}, '{pattern}', '{mark}', 'g')"
    fits = "\n union all ".join(f"select k, '{v}' as v, '{h}{p}' as rule from u where (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for v, h, p in RULES)
    apart = lambda a, b: f"coalesce({b} >= {BRANCH} and all_{b} - {b} >= {BRANCH} and pow({a} / {b} - (all_{a} - {a}) / (all_{b} - {b}), 2) > {DIFFERS**2} * (all_{a} / all_{b} * (1 - all_{a} / all_{b}) * (1 / {b} + 1 / (all_{b} - {b}))), false)"
    bin_ = lambda a, b: f"case when {b} >= {BRANCH} then cast(cast(floor(asin(sqrt({a} / {b})) / {DIFFERS / (2 * math.sqrt(BRANCH))!r}) as bigint) as varchar) else '-' end"
    levels = []
    for d in range(DEPTH):
        levels.append(f"""
b{d} as (select host, template, seg[{d + 1}] as branch, cast(sum(n) as double) as n, cast(sum(known) as double) as known, cast(sum(bad) as double) as bad, cast(coalesce(sum(n) filter (len(seg) = {d + 1}), 0) as double) as ends from t{d} where len(seg) > {d} group by 1, 2, 3),
a{d} as (select *, sum(n) over w as all_n, sum(known) over w as all_known, sum(bad) over w as all_bad, sum(ends) over w as all_ends from b{d} window w as (partition by host, template)),
o{d} as (select host, template, branch, {bin_('bad', 'known')} || '.' || {bin_('known', 'n')} || '.' || {bin_('ends', 'n')} as bins from a{d} where {apart('bad', 'known')} or {apart('known', 'n')} or {apart('ends', 'n')}),
n{d} as (select host, template, branch, case when count(*) over (partition by host, template, bins) = 1 then branch else '*' || bins end as name from o{d}),
t{d + 1} as (select t{d}.host, t{d}.template || case when len(seg) <= {d} then '' when seg[{d + 1}] = '' then '/' else '/' || coalesce(name, '*') end as template, seg, n, known, bad from t{d} left join n{d} on t{d}.host = n{d}.host and t{d}.template = n{d}.template and seg[{d + 1}] = n{d}.branch)""")
    s = STRENGTH
    return rf"""
with x as (select row_number() over () as k, page_id, url, regexp_extract(url, '{_URL}', 1) as h, coalesce(regexp_extract(url, '{_URL}', 2), '') as path from pages),
u as (select k, page_id, translate(coalesce(h, ''), '{_UPPER}', '{_UPPER.lower()}') as host, path, string_split({mask}, '/') as parts, try_cast(regexp_extract(path, '/([0-9]+)[^/0-9]*/?$', 1) as bigint) as doc_id from x),
l as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 when quality is not null or toxic is not null then 0 end) as bad from labels group by 1),
p as (select k, page_id, host, path, case when len(parts) > {DEPTH + 1} then list_concat(parts[2:{DEPTH}], ['**']) else parts[2:] end as seg, l.bad from u left join l on u.doc_id = l.doc_id),
t0 as (select host, '' as template, seg, count(*) as n, count(bad) as known, coalesce(sum(bad), 0) as bad from p group by host, seg),{','.join(levels)},
q as (select host, template, sum(known) as known, sum(bad) as bad from t{DEPTH} group by 1, 2),
g as (select cast(coalesce(sum(bad), 0) as double) / (cast(coalesce(sum(known), 0) as double) + {s}) as prior from q),
h as (select host, (sum(bad) + {s} * any_value(prior)) / (sum(known) + {s}) as host_purity from q, g group by 1),
f as (select k, arg_max(v, length(rule)) as v, arg_max(rule, length(rule)) as rule from ({fits}) group by 1)
select page_id, p.host, p.path, f.rule, coalesce(f.v, case when (q.bad + {s} * host_purity) / (q.known + {s}) >= {REJECT} then 'block' else 'allow' end) as verdict,
 q.template, round((q.bad + {s} * host_purity) / (q.known + {s}), 9) as purity
from p join t{DEPTH} t on p.host = t.host and p.seg = t.seg join q on t.host = q.host and t.template = q.template join h on p.host = h.host left join f on p.k = f.k
"""


ORACLE = _oracle()
