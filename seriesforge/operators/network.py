"""Exchange networks: weighted flows between nodes, balances, and the share that circulates at each node.

Flows are rows ``(source, target, amount)``. ``shares`` follows what a node passes on: each round a node sends its share on in proportion to its
outgoing flows, what nodes without outgoing flow hold is spread over all nodes, and a small part starts anew everywhere, so that the shares
settle. A round is two aggregates over the flows, combined before they are shuffled; a node that very many flows reach is no
hot key, as only sums meet there. Flows are computed once and stored in blocks of the receiving node, so that no round moves them: a round
copies each node's share to the blocks that it has flows in, and sums per node leave a block. The flows to a node with more than ``HOT_FLOWS``
are dealt over several blocks. A round is written to the shared folder, so plans stay short, and one number a round passes through the driver.

Defined cases: rows with a null node or an amount that isn't positive take no part; repeated flows add up; flows of a node to itself stay
there; a network without flows has no nodes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.sources import bucketed
from seriesforge.sources.tables import scratch_path

BLOCK_FLOWS = 2_000_000
HOT_FLOWS = 500_000  # flows to one node in a block


def flows(df: DataFrame, source: str = "source", target: str = "target", amount: str = "amount") -> DataFrame:
    """(source, target, amount): one row for each pair of nodes."""
    rows = df.filter(F.col(source).isNotNull() & F.col(target).isNotNull() & (F.col(amount) > 0))
    return rows.groupBy(F.col(source).alias("source"), F.col(target).alias("target")).agg(F.sum(amount).alias("amount"))


def balances(net: DataFrame) -> DataFrame:
    """(node, sent, received, balance) of every node; flows of a node to itself count on both sides."""
    sides = net.select(F.inline(F.array(F.struct(F.col("source").alias("node"), F.col("amount").alias("sent"), F.lit(0).cast(net.schema["amount"].dataType).alias("received")),
                                        F.struct(F.col("target").alias("node"), F.lit(0).cast(net.schema["amount"].dataType).alias("sent"), F.col("amount").alias("received")))))
    return sides.groupBy("node").agg(F.sum("sent").alias("sent"), F.sum("received").alias("received")).withColumn("balance", F.col("received") - F.col("sent"))


def shares(net: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, share) after so many rounds; shares add up to 1."""
    spark, folder = net.sparkSession, scratch_path(net.sparkSession, "network")
    net.write.parquet(f"{folder}/flows")
    net, name = spark.read.parquet(f"{folder}/flows"), f"flows_{uuid.uuid4().hex}"
    blocks = bucketed.bucket_count(net.count(), BLOCK_FLOWS)
    numbers = _one_a_bucket(spark, blocks)
    hot = net.groupBy("target").count().filter(F.col("count") > HOT_FLOWS).select("target", F.ceil(F.col("count") / HOT_FLOWS).alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("source"), F.col("pieces")), F.lit(0))
    # At most one row for HOT_FLOWS flows is broadcast.
    dealt = net.join(F.broadcast(hot), "target", "left").withColumn("block", F.get(numbers, F.pmod(F.xxhash64("target", piece), F.lit(blocks)).cast("int")))
    parts = bucketed.store(dealt.select("block", "source", "target", "amount"), name, "block", (), blocks, f"{folder}/parts")
    # A node with flows in most blocks is copied to all of them, and its list isn't kept.
    own = F.when(F.size(F.collect_set("block")) <= blocks // 2, F.collect_set("block"))
    out = parts.groupBy("source").agg(F.sum("amount").alias("sent"), own.alias("blocks"))
    ends = net.select(F.explode(F.array("source", "target")).alias("node")).distinct()
    ends.join(out.withColumnRenamed("source", "node"), "node", "left").select(
        "node", F.col("sent").isNull().alias("dangling"), "sent", "blocks").write.parquet(f"{folder}/nodes")
    nodes = spark.read.parquet(f"{folder}/nodes")
    n = nodes.count()
    current = nodes.withColumn("share", F.lit(1.0 / n if n else 0.0))
    for k in range(rounds if n else 0):
        idle = current.filter("dangling").agg(F.sum("share")).first()[0] or 0.0
        sending = current.filter("NOT dangling").select(F.col("node").alias("source"), "sent", "share", F.explode(F.coalesce("blocks", numbers)).alias("block"))
        got = parts.join(sending, ["block", "source"]).groupBy("block", F.col("target").alias("node")).agg(
            F.sum(F.col("amount") / F.col("sent") * F.col("share")).alias("got")).groupBy("node").agg(F.sum("got").alias("got"))
        base = (1 - damping) / n + damping * idle / n
        path = f"{folder}/round-{k}"
        nodes.join(got, "node", "left").withColumn("share", F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).drop("got").write.parquet(path)
        current = spark.read.parquet(path)
    spark.sql(f"DROP TABLE {name}")  # its files stay, as all scratch does
    return current.select("node", "share")


def _one_a_bucket(spark: SparkSession, count: int) -> Column:
    """As many numbers, of which Spark's hash puts one into each bucket."""
    found = spark.range(64 * count).groupBy(F.pmod(F.hash("id"), F.lit(count))).agg(F.min("id").alias("id")).collect()
    return F.array(*[F.lit(i) for i in sorted(r.id for r in found)])
