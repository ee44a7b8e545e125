"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import brief_shuffles, cut


def _mark(edges: DataFrame) -> tuple:
    with brief_shuffles(edges.sparkSession):
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; the root is the smallest node that can be reached.

    ``edges`` has columns a and b. Each round joins every node to the smallest of its neighbours, first
    upwards, then downwards, until the links form stars. Minima are combined before the shuffle, and
    a hot node's links meet them in a join that adaptive execution can split. A round is written to the
    shared folder, so the plan doesn't grow and lost executors cost one round.
    """
    links = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(links)
    while mark[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
                 .select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct())
        links = cut(small)
        before, mark = mark, _mark(links)
        if before == mark:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
