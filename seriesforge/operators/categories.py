"""The category tree of a bulk file: all ancestors of a category, cycles, and totals of every category over the series below it.

A category record names its parent and lists its series (``childseries``). Categories may have several parents, a series may stand in several
categories, and faulty files have cycles. Ancestors are found by pointer doubling: each round joins the paths known so far end to end, so a
tree of depth ``n`` takes ``log2(n)`` rounds. A path that ends at a root goes into no join, so the root, where all paths end, is never a
join key. A category with very many series is split over tasks, and only its few ancestors are copied.

Defined cases: a category without a parent, or whose parent has no record, is a root; a record without id is left out; a repeated record
counts once; a node on a cycle is its own ancestor; a series counts once in each ancestor, however many ways lead there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.operators.star import HOT_ROWS, join_keys
from seriesforge.sources.tables import scratch_path


def parents(raw: DataFrame) -> DataFrame:
    """(node, parent) of the category records of a bulk file; null where a category has no parent."""
    rows = raw.filter(F.col("category_id").isNotNull())
    return rows.select(F.col("category_id").alias("node"), F.col("parent_category_id").alias("parent")).distinct()


def members(raw: DataFrame) -> DataFrame:
    """(series_id, category): what the categories list as their series."""
    rows = raw.filter(F.col("category_id").isNotNull()).select(F.col("category_id").alias("category"), F.explode("childseries").alias("series_id"))
    return rows.filter(F.col("series_id").isNotNull()).select("series_id", "category").distinct()


def ancestors(edges: DataFrame) -> DataFrame:
    """(node, ancestor, distance) of rows (node, parent), by the shortest way."""
    spark, folder = edges.sparkSession, scratch_path(edges.sparkSession, "ancestors")
    known = edges.filter(F.col("node").isNotNull() & F.col("parent").isNotNull()).distinct()
    nodes = edges.select(F.col("node").alias("ancestor")).filter("ancestor IS NOT NULL").distinct()
    above = known.select(F.col("node").alias("ancestor")).distinct().withColumn("more", F.lit(True))
    # A parent without a record of its own is no category; ``more`` says that a path goes on.
    paths = (known.withColumnRenamed("parent", "ancestor").join(nodes, "ancestor", "left_semi")
             .join(above, "ancestor", "left").select("node", "ancestor", F.lit(1).alias("distance"), F.coalesce("more", F.lit(False)).alias("more")))
    reach = 1
    while True:
        path = f"{folder}/reach-{reach}"
        paths.write.parquet(path)
        paths = spark.read.parquet(path)
        longest = paths.filter(F.col("more") & (F.col("distance") == reach))
        if longest.isEmpty():
            return paths.drop("more")
        first = longest.select("node", F.col("ancestor").alias("middle"), F.col("distance").alias("d1"))
        second = paths.select(F.col("node").alias("middle"), "ancestor", F.col("distance").alias("d2"), "more")
        longer = first.join(second, "middle").select("node", "ancestor", (F.col("d1") + F.col("d2")).alias("distance"), "more")
        paths = paths.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance"), F.any_value("more").alias("more"))
        reach *= 2


def cycles(closure: DataFrame) -> DataFrame:
    """(node, length): nodes that are their own ancestors."""
    return closure.filter("node = ancestor").select("node", F.col("distance").alias("length"))


def series_ancestors(listed: DataFrame, closure: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(series_id, ancestor) of rows (series_id, category), each pair once; its own category is an ancestor too."""
    own = closure.filter("node <> ancestor").select(F.col("node").alias("category"), "ancestor")
    above = join_keys(own, listed, "category", hot_rows).select("series_id", "ancestor")
    return above.unionByName(listed.select("series_id", F.col("category").alias("ancestor"))).distinct()


def roll_up(facts: DataFrame, listed: DataFrame, closure: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(category, date, total, n_series) of every category with series below it, from monthly rows (series_id, date, value).

    Sums are combined before they are shuffled, so the root receives one row a task and month.
    """
    above = series_ancestors(listed, closure, hot_rows)
    return (facts.join(above, "series_id").groupBy(F.col("ancestor").alias("category"), "date")
            .agg(F.sum("value").alias("total"), F.count("*").alias("n_series")))
