"""URL filters by a path-template tree.

Each host has a tree of path segments. Segments that are variable by their shape (numbers, long hexadecimal names) become wildcards at
once, and paths that are equal then are added up, so the tree is grown from distinct paths and not from urls. It grows
level by level: a child keeps its name if it has ``MIN_URLS`` urls, however small a part of its parent's they are; all others are a
wildcard. Named children whose labelled share of bad urls doesn't differ from their siblings' (a two-sided test of two proportions)
are merged to one branch, which lists their names if they are at most ``LISTED`` and else is called ``MANY``. A template, which is a path of the final tree, is rejected where its smoothed
share of bad urls reaches ``LIMIT``: it is drawn to the host's share, and that to the share of all, by ``PRIOR`` urls each.

Hand-made rules go before: a rule fits its host and all subdomains where the path starts with its path; the longest wins.

All steps are aggregates and joins on (host, path); counts are combined before they are shuffled, and html is
never read. Only the join that gives each url its template moves urls, and adaptive execution can split it at a hot host.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged as such; an empty path is the root of its host; of segments beyond
``MAX_DEPTH`` only those with a name extend the template, to any depth where a template has ``MIN_URLS`` urls; labels of pages that don't exist are ignored, a page is bad if any of its labels is;
repeated rows count and return as often as they occur; other columns are not returned; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import cut

MAX_DEPTH = 6
MIN_URLS = 10
MIN_SHARE = 0.0  # a child needs no share of its parent, or its verdict would depend on the size of its host; only the brute force reads it
LISTED = 100
MANY = "(//)"  # no segment is empty, so no path has it
Z = 2.576  # two-sided, 1 in 100
PRIOR = 10.0
LIMIT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path, verdict) that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, said in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments with variable ones as wildcards."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, r"^[0-9a-fA-F-]{16,}(?=\.|$)", "{hex}"), r"[0-9]+", "{n}"))


def grown(paths: DataFrame) -> DataFrame:
    """(host, shape, n, labelled, bad, template) of distinct paths (host, shape, n, labelled, bad)."""
    depth = paths.agg(F.max(F.size("shape"))).first()[0] or 0
    tree = paths.withColumn("template", F.lit(""))
    for level in range(depth):
        deeper = tree.filter(F.size("shape") > level).groupBy("host", "template").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_URLS)
        if level >= MAX_DEPTH and deeper.isEmpty():
            break  # nor is any further down
        here = tree.withColumn("segment", F.get("shape", F.lit(level)))
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
        children = here.filter("segment IS NOT NULL").groupBy("host", "template", "segment").agg(*sums)
        named = children.filter(F.col("n") >= MIN_URLS)
        siblings = named.groupBy("host", "template").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        labelled, bad = F.col("labelled"), F.col("bad")
        others, others_bad = F.col("all_labelled") - labelled, F.col("all_bad") - bad
        pooled = F.try_divide("all_bad", "all_labelled")
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), labelled) + F.try_divide(F.lit(1), others)))
        differs = F.coalesce((labelled > 0) & (others > 0) & (F.abs(F.try_divide(bad, labelled) - F.try_divide(others_bad, others)) > Z * error), F.lit(False))
        tested = named.join(siblings, ["host", "template"]).select("host", "template", "segment", differs.alias("differs"))
        tested = cut(tested)
        alike = tested.filter(~F.col("differs"))
        few = alike.groupBy("host", "template").agg(F.count("*").alias("m")).filter(F.col("m") <= LISTED).drop("m")
        merged = alike.join(few, ["host", "template"], "left_semi").groupBy("host", "template").agg(F.array_sort(F.collect_list("segment")).alias("alike"))
        names = tested.join(merged, ["host", "template"], "left").select(
            "host", "template", "segment",
            F.when(F.col("differs") | (F.size("alike") == 1), F.col("segment")).when(F.col("alike").isNull(), MANY)
            .otherwise(F.concat(F.lit("("), F.array_join("alike", "|"), F.lit(")"))).alias("name"))
        tree = cut(here.join(names, ["host", "template", "segment"], "left").withColumn(
            "template", F.when(F.col("segment").isNull(), F.col("template"))
            .otherwise(F.concat("template", F.coalesce(F.concat(F.lit("/"), "name"), F.lit("/*" if level < MAX_DEPTH else ""))))).select(*paths.columns, "template"))
    return tree


def templates(tree: DataFrame) -> DataFrame:
    """(host, template, n, labelled, bad, purity): the smoothed share of good urls."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    by_template = tree.groupBy("host", "template").agg(*sums)
    by_host = tree.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("bad").alias("host_bad"))
    share = F.lit(tree.agg(F.try_divide(F.sum("bad"), F.sum("labelled"))).first()[0] or 0.0)
    host_share = (F.col("host_bad") + PRIOR * share) / (F.col("host_labelled") + PRIOR)
    return (by_template.join(by_host, "host")
            .select("host", "template", "n", "labelled", "bad",
                    (1 - (F.col("bad") + PRIOR * host_share) / (F.col("labelled") + PRIOR)).alias("purity")))


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, template, purity) of every page; ``labels`` has (key, bad)."""
    host, path = host_and_path(F.col(url))
    urls = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).withColumn("shape", shape(F.col("path")))
    known = labels.select(F.col(key).alias("key"), F.col("bad").cast("int").alias("bad")).dropna().groupBy("key").agg(F.max("bad").alias("bad"))
    counted = urls.join(known, "key", "left").groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = grown(cut(counted))
    judged = tree.join(templates(tree).select("host", "template", "purity"), ["host", "template"]).select("host", "shape", "template", "purity")
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    return urls.join(judged, ["host", "shape"]).select(
        F.col("key").alias(key), "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(F.col("purity") <= 1 - LIMIT, "block").otherwise("allow")).alias("verdict"), "template", "purity")
