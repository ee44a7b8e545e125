"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` equal cells; a row falls into the cell of its key's hash. Every shard has ``virtual`` nodes, each
at the start of a cell by the hash of shard and number, and owns the cells from there to the next node. A shard holds exactly
its bound: the number of rows divided by the number of shards, one more for the first few. A shard with more keeps its
bound of them, each of its arcs the same share; the rest go on clockwise to the next nodes whose shards have room. No row moves that
needn't, and counts of shards differ by one at most: that is the law ``rows``.

All of it is joins and windows. Rows are counted by cell, so what the ring is worked out from has at most
CELLS rows, however large the input; the n-th row that overflows, clockwise from where every
overflow has been placed, takes the n-th free place. Cells, not shards, are the windows in which rows are
numbered: a row meets one in CELLS of the others at most, unless keys repeat; rows of one cell are spread over
``SALT`` windows by the rest of their hash. Only key, size and checksum are shuffled, never the text.

Defined cases: null keys count as one key of their own; rows with equal keys and equal texts are told apart by
nothing, so they take neighbouring places in any order; null texts have size 1 and checksum 0; groups of equal texts are
not kept together, as that would break the law; other columns are not returned; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seriesforge.llm.common import cut, whole_text

CELLS = 1 << 14
SALT = 4


def _cell(key: Column) -> tuple[Column, Column]:
    """Cell and place in it of a key."""
    h = F.xxhash64(key)
    return F.shiftrightunsigned(h, 50).cast("int"), F.shiftrightunsigned(F.shiftleft(h, 14), 60).cast("int")


def ring(spark, shards: int, virtual: int) -> DataFrame:
    """(cell, shard): the owner of every cell. Nodes that meet in a cell: the least hash has it."""
    nodes = (spark.range(shards * virtual).select((F.col("id") % shards).cast("int").alias("shard"),
                                                   F.xxhash64(F.lit("node"), "id").alias("h"))
             .select("shard", F.shiftrightunsigned("h", 50).cast("int").alias("cell"), "h")
             .groupBy("cell").agg(F.min_by("shard", "h").alias("shard")))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell"))
    around = W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    owned = cells.join(nodes, "cell", "left").withColumn("own", F.last("shard", True).over(around))
    # Cells before the first node belong to the last one: the ring closes.
    closing = F.max_by("shard", F.when(F.col("shard").isNotNull(), F.col("cell"))).over(W.partitionBy())
    return owned.select("cell", F.coalesce("own", closing).alias("shard"))


def placed(counts: DataFrame, shards: int, virtual: int) -> DataFrame:
    """Where the rows of each cell go: (cell, lo, hi, shard, slot): ranks lo to hi - 1 take slots from ``slot`` on.

    ``counts`` has (cell, n). Everything here has CELLS rows or a few times as many.
    """
    spark = counts.sparkSession
    cells = (ring(spark, shards, virtual).join(counts, "cell", "left")
             .select("cell", "shard", F.coalesce("n", F.lit(0)).alias("n")))
    own = W.partitionBy("shard")
    up_to = own.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("n").over(W.partitionBy())
    bound = F.floor(total / shards) + (F.col("shard") < total % shards).cast("int")

    def share(part: Column, whole: Column, of: Column, before: Column) -> Column:
        """Exact share of ``of`` for the ranks from ``before`` to ``part`` of ``whole``, by rounding running sums."""
        wide = lambda c: c.cast("decimal(19,0)")
        run = lambda c: F.floor(wide(c) * wide(of) / F.greatest(wide(whole), F.lit(1).cast("decimal(19,0)"))).cast("long")
        return run(part) - run(before)

    cells = (cells.withColumns({"bound": bound.cast("long"), "home": F.sum("n").over(own), "seen": F.sum("n").over(up_to),
                                "k": F.row_number().over(own.orderBy("cell")).cast("long"), "cells": F.count("*").over(own)})
             .withColumn("stay", F.when(F.col("home") <= F.col("bound"), F.col("n"))
                         .otherwise(share(F.col("seen"), F.col("home"), F.col("bound"), F.col("seen") - F.col("n"))))
             .withColumn("room", F.when(F.col("home") < F.col("bound"),
                                        share(F.col("k"), F.col("cells"), F.col("bound") - F.col("home"), F.col("k") - 1)).otherwise(0))
             .withColumn("over", F.col("n") - F.col("stay")))
    # Clockwise from the cell after which least is waiting: from there on no place is reached before a row for it.
    around = W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    cells = cells.withColumn("waiting", F.sum(F.col("over") - F.col("room")).over(around))
    start = F.min_by("cell", F.struct("waiting", "cell")).over(W.partitionBy())
    cells = cells.withColumn("turn", F.pmod(F.col("cell") - start - 1, F.lit(CELLS)))
    by_turn = W.orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    cells = cut(cells.withColumns({"overs": F.sum("over").over(by_turn), "rooms": F.sum("room").over(by_turn)}))

    # Overflowing rows and free places carry the same numbers; both sequences are cut wherever either begins anew.
    stays = cells.filter("stay > 0").select("cell", F.lit(0).cast("long").alias("lo"), F.col("stay").alias("hi"), "shard")
    begins = (cells.filter("over > 0").select((F.col("overs") - F.col("over")).alias("number"))
              .unionByName(cells.filter("room > 0").select((F.col("rooms") - F.col("room")).alias("number"))).distinct())
    marks = (begins.unionByName(cells.filter("over > 0").select((F.col("overs") - F.col("over")).alias("number"), F.struct(
                 (F.col("overs") - F.col("over")).alias("since"), "cell", "stay").alias("source")), allowMissingColumns=True)
             .unionByName(cells.filter("room > 0").select((F.col("rooms") - F.col("room")).alias("number"), F.col("shard").alias("target")), allowMissingColumns=True)
             .unionByName(cells.agg(F.sum("over").alias("number")), allowMissingColumns=True)  # where the last of them ends
             .groupBy("number").agg(F.max("source").alias("source"), F.max("target").alias("target")))
    line = W.orderBy("number")
    until = F.lead("number").over(line)
    source = F.last("source", True).over(line.rowsBetween(W.unboundedPreceding, 0))
    moves = (marks.select("number", source.alias("source"),
                          F.last("target", True).over(line.rowsBetween(W.unboundedPreceding, 0)).alias("shard"), until.alias("until"))
             .filter("number < until")
             .select("source.cell", (F.col("source.stay") + F.col("number") - F.col("source.since")).alias("lo"),
                     (F.col("source.stay") + F.col("until") - F.col("source.since")).alias("hi"), "shard"))
    parts = stays.unionByName(moves)
    before = W.partitionBy("shard").orderBy("cell", "lo").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("slot", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(before), F.lit(0)))


def assign(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16, virtual: int = 64) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; slots of a shard run from 0 without a gap."""
    if shards < 1 or virtual < 1 or shards * virtual > CELLS:
        raise ValueError(f"shards * virtual must be 1 to {CELLS}")
    cell, salt = _cell(F.col(key))
    rows = df.select(F.col(key).alias("key"), (F.octet_length(whole_text(text)) + 1).cast("long").alias("size"),
                     F.crc32(whole_text(text).cast("binary")).alias("text_crc32"), cell.alias("cell"), salt.alias("salt"))
    by_window = df.select(cell.alias("cell"), salt.alias("salt")).groupBy("cell", "salt").agg(F.count("*").alias("n"))
    starts = by_window.select("cell", "salt", F.coalesce(
        F.sum("n").over(W.partitionBy("cell").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    parts = placed(by_window.groupBy("cell").agg(F.sum("n").alias("n")), shards, virtual)
    # At most CELLS * SALT rows and a few times CELLS rows: bounded, whatever the input.
    within = F.row_number().over(W.partitionBy("cell", "salt").orderBy(F.xxhash64("key"), "key", "size", "text_crc32")) - 1
    ranked = (rows.withColumn("within", within).join(F.broadcast(starts), ["cell", "salt"])
              .withColumn("rank", F.col("within") + F.col("before")))
    found = ranked.join(F.broadcast(parts.withColumnRenamed("cell", "of")),
                        (F.col("cell") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return found.select(F.col("key").alias(key), "size", "text_crc32", "shard",
                        (F.col("slot") + F.col("rank") - F.col("lo")).cast("long").alias("slot"))
