"""Url filters by path-template trees, with DataFrame functions only.

Explicit rules come first: a rule names a host (which stands for itself and all
its subdomains) and a path prefix, and the longest that fits decides. Urls
without a rule are judged by the template tree:

1. Urls are reduced to distinct (host, path) with their counts of labelled
   pages (good, bad), so repeated urls and hot pages cost one row. Labels are independent of the
   rules: weak ones from what the page shows (``weak_label``), or any the caller has.
2. Level by level, a host's path segments become templates: numbers, dates and
   hashes by their form, and a segment by its statistics where its node has at
   least ``fan_out`` different children and the segment has less than
   ``rare_share`` of the node's pages. What stands below is counted under the
   wildcard, not under each value.
3. On each level labelled branches whose share of bad pages differs from that
   of the node's labelled pages by no more than ``z`` standard errors are one
   branch.
4. Purity is smoothed down the tree: a node's is (good + weight * p) / (labelled +
   weight) of the pages in and below it, with p the smoothed purity of its parent, and for a host
   the share of good pages over all. A template's is that of its own pages, with its parent's as p, so one without
   labels has that of its nearest labelled ancestor.
5. A template is rejected if its purity is under ``least_purity`` and some page of its host is labelled.

Segments from level ``levels`` on are taken as one last segment. Nothing is collected
and no host is gathered in one task: all keys hold the path so far, counts
are combined before each shuffle, and joins are equality joins of written tables or
plain shuffles, which Spark splits where a key is skewed.

Null urls and urls without ``://`` have an empty host and path and form one
template. A null or very short page has no weak label. Repeated rows get the same result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ascii_lower, discard, fresh, store

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule], what: str) -> Column:
    """``what`` ("name" or "verdict") of the longest rule that fits (of equals, the first given); null if none."""
    out = F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(getattr(r, what))).otherwise(out)
    return out


SYMBOLS = "#*$%|"


def weak_label(text: Column, *, words: int = 20, good: tuple[float, float] = (0.05, 0.2), bad: tuple[float, float] = (0.2, 0.4)) -> Column:
    """Whether what a page shows reads like a text: false from ``bad`` symbols per word, or words in capitals, on, true up to
    ``good`` of both, else (and under ``words`` words) null. ``text``: a column, as it is looked at several times."""
    rest = text
    for c in SYMBOLS:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    n, capitals = F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.regexp_count(text, F.lit("[A-Z]{3,}"))
    counts = F.struct(n.alias("n"), (F.octet_length(text) - F.octet_length(rest)).alias("symbols"), capitals.alias("capitals"))

    def rule(c: Column) -> Column:
        n, symbols, capitals = c["n"], c["symbols"], c["capitals"]
        is_bad, is_good = (symbols >= bad[0] * n) | (capitals >= bad[1] * n), (symbols <= good[0] * n) & (capitals <= good[1] * n)
        return F.when(n < words, None).when(is_bad, False).when(is_good, True)

    return F.get(F.transform(F.array(counts), rule), F.lit(0))  # counts are made once


def form(segment: Column) -> Column:
    """A segment by its form: what is a number, date, hash or id in it becomes a wildcard; a file ending stays."""
    steps = (
        (r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?(?=$|\.)", "{date}"),
        (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?=$|\.)", "{id}"),
        (r"^[0-9]+(?=$|\.)", "{n}"),
        (r"^(?=[^.]*[0-9])[0-9a-fA-F]{8,}(?=$|\.)", "{id}"),
        (r"[0-9]{3,}", "{n}"),
    )
    out = segment
    for pattern, wild in steps:
        out = F.regexp_replace(out, pattern, wild)
    return out


def segments(path: Column, levels: int) -> Column:
    """The path's segments by form; those below ``levels`` as one."""
    parts = F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), form)
    rest = F.array_join(F.slice(parts, levels, F.greatest(F.size(parts) - levels + 1, F.lit(0))), "/")
    return F.when(F.size(parts) <= levels, parts).otherwise(F.concat(F.slice(parts, 1, levels - 1), F.array(rest)))


def templates(
    paths: DataFrame,
    *,
    levels: int = 8,
    fan_out: int = 20,
    rare_share: float = 0.1,
    min_labels: int = 5,
    z: float = 2.0,
) -> DataFrame:
    """``paths`` (host, path, n, good, bad) with ``template``, the path's place in its host's tree, and ``above``,
    the nodes on the way there from the host's."""
    nothing = F.array().cast("array<string>")
    rows = store(paths.withColumns({"parts": segments(F.col("path"), levels), "template": F.lit(""), "above": nothing}), "url-paths")
    deepest = rows.agg(F.max(F.size("parts"))).first()[0] or 0
    for level in range(deepest):
        before, part = rows, F.get("parts", F.lit(level))
        rows = rows.withColumn("part", part)
        branches = rows.filter("part is not null").groupBy("host", "template", "part").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        told = F.col("good") + F.col("bad")
        branches = store(branches, "url-branches")
        nodes = branches.groupBy("host", "template").agg(
            F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum(told).alias("all_told")
        )
        nodes = store(nodes, "url-nodes")  # joins of written tables are split where a host is hot
        seen = branches.join(nodes, ["host", "template"])
        p = F.col("all_bad") / F.nullif(F.col("all_told"), F.lit(0))
        varies = (F.col("kids") >= fan_out) & (F.col("n") < rare_share * F.col("all_n"))
        alike = (F.col("kids") > 1) & (told >= min_labels) & (F.abs(F.col("bad") - told * p) <= z * F.sqrt(told * p * (1 - p)) + 0.5)
        name = F.when(varies, "{*}").when(alike, "{=}").otherwise(F.col("part"))
        named = seen.select("host", "template", "part", name.alias("branch"))
        rows = (
            rows.join(named, ["host", "template", "part"], "left")
            .withColumn("above", F.when(F.col("branch").isNull(), F.col("above")).otherwise(F.array_append("above", F.col("template"))))
            .withColumn("template", F.when(F.col("branch").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.col("branch"))))
            .drop("branch", "part")
        )
        rows = store(rows, "url-paths")  # each level reads the last one several times
        discard(before, branches, nodes)
    return rows.drop("parts")


def purities(tree: DataFrame, overall: DataFrame, weight: float) -> DataFrame:
    """(host, template, purity, known) of ``tree`` (host, template, above, good, bad); ``overall`` (p) is one row.

    ``known``: whether the host has labelled pages.
    """
    told = F.col("good") + F.col("bad")
    sums = [F.sum("good").alias("good"), F.sum(told).alias("told")]
    own = store(tree.groupBy("host", "template", "above").agg(*sums), "url-templates")
    nodes = own.select("host", F.explode("above").alias("node"), "good", "told").groupBy("host", "node").agg(F.sum("good").alias("good"), F.sum("told").alias("told"))
    nodes = store(nodes, "url-subtrees")
    places = own.select("host", "template", F.posexplode("above").alias("depth", "node"))
    counts = F.sort_array(F.collect_list(F.struct("depth", "good", "told")))  # a row per level
    chains = places.join(nodes, ["host", "node"]).groupBy("host", "template").agg(counts.alias("chain"))
    joined = own.join(chains, ["host", "template"], "left").crossJoin(F.broadcast(overall))  # one row

    def smoothed(good: Column, told: Column, p: Column) -> Column:
        return (good + weight * p) / (told + weight)

    above = F.coalesce(F.aggregate("chain", F.col("p"), lambda p, x: smoothed(x["good"], x["told"], p)), F.col("p"))
    known = (F.col("told") > 0) | F.exists(F.coalesce("chain", F.array().cast("array<struct<depth:int,good:bigint,told:bigint>>")), lambda x: x["told"] > 0)
    return joined.select("host", "template", smoothed(F.col("good"), F.col("told"), above).alias("purity"), known.alias("known"))


def judge(
    pages: DataFrame,
    keep: list[str],
    *,
    url_col: str = "url",
    rules: list[Rule] = RULES,
    label: Column | None = None,
    weight: float = 2.0,
    least_purity: float = 0.5,
    **options,
) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule``, ``template`` and ``verdict`` of every page.

    ``label``: true for good, false for bad, null for pages that nobody judged (default: what the rules say). A ``keep``
    column that is called like one of these stays; the new one gets underscores before its name.
    """
    own = {c: f"k{i}" for i, c in enumerate(keep)}
    names = [fresh(keep, c) for c in ("host", "path", "rule", "template", "verdict")]
    url = F.col(f"`{url_col}`").cast("string")
    src = pages.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], url_host(url).alias("host"), url_path(url).alias("path"), *([] if label is None else [label.alias("label")]))
    host, path = F.col("host"), F.col("path")
    src = src.withColumns({"rule": fitting_rule(host, path, rules, "name"), "ruled": fitting_rule(host, path, rules, "verdict")})
    good = F.col("ruled") == "allow" if label is None else F.col("label")
    paths = src.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad")
    )
    tree = templates(paths, **options)
    told = F.col("good") + F.col("bad")
    overall = tree.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).select(F.coalesce(F.col("good") / F.nullif(told, F.lit(0)), F.lit(1.0)).alias("p"))
    rejected = F.col("known") & (F.col("purity") < least_purity)
    verdicts = purities(tree, overall, weight).select("host", "template", F.when(rejected, "block").otherwise("allow").alias("judged"))
    by_path = tree.select("host", "path", "template").join(store(verdicts, "url-verdicts"), ["host", "template"])
    out = src.join(by_path, ["host", "path"])
    found = [F.col("host"), F.col("path"), F.col("rule"), F.col("template"), F.coalesce("ruled", "judged")]
    return out.select(*[F.col(k).alias(c) for c, k in own.items()], *[c.alias(name) for c, name in zip(found, names, strict=True)])
