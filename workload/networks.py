"""Clusters of series and exchange networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import cluster, network
from workload import catalogs as c
from workload.registry import query

CENTRES, ROUNDS = 4, 5


def part_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, features) of every sold part: months, pieces in tens and revenue in hundred thousands."""
    sums = c.part_months(spark, sf_dir).groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n"), F.sum("qty").alias("qty"), F.sum("rev").alias("rev"))
    return sums.select("id", F.array(F.col("n").cast("double"), F.col("qty") / 10.0, F.col("rev") / 100000.0).alias("features"))


def _near(centres: str) -> str:
    """Each row's nearest centre, ties to the smaller number."""
    square = " + ".join(f"(f.x{i} - z.x{i}) * (f.x{i} - z.x{i})" for i in range(3))
    return f"SELECT id, x0, x1, x2, min({{'d': d, 'c': c}}) AS m FROM (SELECT f.*, z.c, {square} AS d FROM feat f, {centres} z) GROUP BY id, x0, x1, x2"


_FEATURES = """
, feat AS (SELECT l_partkey AS id, CAST(count(*) AS DOUBLE) AS x0, sum(qty) / 10.0 AS x1, sum(rev) / 100000.0 AS x2 FROM parts GROUP BY 1),
c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, x0, x1, x2 FROM (SELECT * FROM feat ORDER BY id LIMIT 4))"""
_LLOYD = "".join(f""",
a{k} AS ({_near(f"c{k - 1}")}),
c{k} AS (SELECT z.c, coalesce(avg(a.x0), any_value(z.x0)) AS x0, coalesce(avg(a.x1), any_value(z.x1)) AS x1, coalesce(avg(a.x2), any_value(z.x2)) AS x2
         FROM c{k - 1} z LEFT JOIN a{k} a ON a.m.c = z.c GROUP BY z.c)""" for k in range(1, ROUNDS + 1))


@query(f"{_FEATURES}{_LLOYD} SELECT id, CAST(m.c AS INTEGER) AS cluster, round(m.d, 5) AS distance FROM ({_near(f'c{ROUNDS}')})", "parts")
def part_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's cluster after five rounds from fixed seeds, the first four parts."""
    rows = cluster.usable(part_statistics(spark, sf_dir))
    first = [r.features for r in rows.orderBy("id").limit(CENTRES).collect()]
    return cluster.assigned(rows, cluster.lloyd(rows, first, ROUNDS)).withColumn("distance", F.round("distance", 5))


def trade(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    """Flows of pieces from suppliers to customers, and from each customer (of ``customers`` alone, if given) to the nation where it is."""
    lines = c.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.col("l_quantity").cast("long").alias("amount"))
    # The nations a customer is in are one row each, so that both kinds of flows come from one join of lines and orders.
    customers = c.table(spark, sf_dir, "customer") if customers is None else customers
    at = customers.groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.collect_list("c_nationkey").alias("nations"))
    sold = lines.join(c.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(at, "o_custkey", "left"), "o_orderkey")
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    buyer = name("C", F.col("o_custkey"))
    goods = F.array(F.struct(name("S", F.col("l_suppkey")).alias("source"), buyer.alias("target")))
    used = F.transform(F.coalesce("nations", F.array().cast("array<int>")), lambda nation: F.struct(buyer.alias("source"), name("N", nation).alias("target")))
    return network.flows(sold.select("amount", F.inline(F.concat(goods, used))))


def _trade(customers: str) -> str:
    return f"""
WITH sold AS (SELECT l_suppkey, o_custkey, CAST(l_quantity AS BIGINT) AS amount FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
net AS (SELECT source, target, CAST(sum(amount) AS BIGINT) AS amount FROM (
            SELECT 'S' || l_suppkey AS source, 'C' || o_custkey AS target, amount FROM sold
            UNION ALL SELECT 'C' || o_custkey, 'N' || c_nationkey, amount FROM sold JOIN customer ON c_custkey = o_custkey WHERE {customers})
        WHERE amount > 0 GROUP BY 1, 2)"""


@query(f"""{_trade("c_nationkey % 2 = 0")}
SELECT node, CAST(sum(sent) AS BIGINT) AS sent, CAST(sum(received) AS BIGINT) AS received, CAST(sum(received) - sum(sent) AS BIGINT) AS balance
FROM (SELECT source AS node, amount AS sent, 0 AS received FROM net UNION ALL SELECT target, 0, amount FROM net) GROUP BY 1""")
def trade_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every node of the network sends and receives, where only customers in nations of even numbers pass goods on."""
    return network.balances(trade(spark, sf_dir, c.table(spark, sf_dir, "customer").filter(F.col("c_nationkey") % 2 == 0)))


_SHARES = """,
part AS (SELECT source, target, amount / CAST(sum(amount) OVER (PARTITION BY source) AS DOUBLE) AS part FROM net),
node AS (SELECT node, node NOT IN (SELECT source FROM net) AS dangling, count(*) OVER () AS n FROM (SELECT source AS node FROM net UNION SELECT target FROM net)),
r0 AS (SELECT node, dangling, n, 1.0 / CAST(n AS DOUBLE) AS share FROM node)""" + "".join(f""",
r{k} AS (SELECT o.node, o.dangling, o.n, 0.15 / o.n + 0.85 * (SELECT coalesce(sum(share), 0) FROM r{k - 1} WHERE dangling) / o.n + 0.85 * coalesce(g.got, 0) AS share
         FROM node o LEFT JOIN (SELECT target, sum(part * share) AS got FROM part JOIN r{k - 1} ON node = source GROUP BY 1) g ON g.target = o.node)""" for k in range(1, 7))


@query(f"{_trade('c_nationkey IS NOT NULL')}{_SHARES} SELECT node, round(share, 10) AS share FROM r6")
def trade_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share that circulates at every node after six rounds, over the flows of all customers."""
    return network.shares(trade(spark, sf_dir), rounds=6).withColumn("share", F.round("share", 10))
