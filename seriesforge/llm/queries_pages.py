"""Queries on web pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.llm import html_layout, url_tree
from seriesforge.llm.common import query, table

# Host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): a page's path ends with the number of the document that it was made from."""
    _, path = url_tree.host_and_path(F.col("url"))
    of = pages.select("page_id", F.regexp_extract(path, r"([0-9]{1,18})[^0-9/]*/?$", 1).try_cast("long").alias("doc_id"))
    return of.join(labels, "doc_id").select("page_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))


@query()
def op1_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url with its rule, or else the verdict of its template."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_tree.judge(pages, page_labels(pages, table(spark, sf_dir, "labels")), RULES)


@query()
def op3_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page as it is laid out, with its numbers of characters and lines."""
    texts = html_layout.extract(table(spark, sf_dir, "pages").select("page_id", "html"))
    return texts.select("page_id", "text", F.length("text").cast("long").alias("n_chars"),
                        F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
