"""Category trees and rule tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators import categories, rule_index
from seriesforge.sources.bulk import TOTAL_SCHEMA, read_bulk
from workload import catalogs as c
from workload.ingest import as_bulk_file
from workload.registry import query

_TREE = """
WITH RECURSIVE edge AS (
    SELECT 'C' || c_custkey AS node, CASE WHEN c_custkey < 10 THEN '0' ELSE 'C' || (c_custkey // 10) END AS parent FROM customer
    UNION SELECT 'C' || c_custkey, 'S-' || c_mktsegment FROM customer WHERE c_custkey % 50 = 0
    UNION SELECT 'S-' || c_mktsegment, '0' FROM customer
    UNION SELECT 'R' || r_regionkey, 'R' || ((r_regionkey + 1) % 5) FROM region
    UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation),
up AS (SELECT node, parent AS ancestor, 1 AS d FROM edge
       UNION SELECT up.node, edge.parent, d + 1 FROM up JOIN edge ON edge.node = up.ancestor WHERE d < 15),
closure AS (SELECT node, ancestor, min(d) AS distance FROM up GROUP BY 1, 2)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bulk(spark, as_bulk_file(spark, c.category_records(spark, sf_dir), "categories-json"), TOTAL_SCHEMA)


@query(f"{_TREE} SELECT node, ancestor, distance FROM closure")
def category_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of every category of a bulk file, by the shortest way."""
    return categories.ancestors(categories.parents(_records(spark, sf_dir)))


@query(f"{_TREE} SELECT node, distance AS length FROM closure WHERE node = ancestor")
def category_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories that are their own ancestors."""
    return categories.cycles(categories.ancestors(categories.parents(_records(spark, sf_dir))))


@query(f"""{_TREE},
listed AS (
    SELECT 'CUS.' || c_custkey || '.M' AS series_id, 'C' || c_custkey AS category FROM customer
    UNION SELECT 'CUS.' || c_custkey || '.M', 'S-' || c_mktsegment FROM customer WHERE c_custkey % 7 = 0
    UNION SELECT 'CUS.' || n_nationkey || '.M', 'N' || n_nationkey FROM nation),
pairs AS (SELECT series_id, category FROM listed UNION SELECT series_id, ancestor FROM listed JOIN closure ON node = category),
facts AS (SELECT 'CUS.' || o_custkey || '.M' AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents
          FROM orders GROUP BY 1, 2)
SELECT category, date, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n_series FROM pairs JOIN facts USING (series_id) GROUP BY 1, 2""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value of every category over all series below it, each counted once."""
    raw = _records(spark, sf_dir)
    closure = categories.ancestors(categories.parents(raw))
    return categories.roll_up(c.customer_facts(spark, sf_dir), categories.members(raw), closure)


@query("""
WITH n AS (SELECT p_partkey AS k, 'TPC.PART.REV.' || p_partkey || '-ALL.M' AS series_id, CASE WHEN p_partkey % 3 = 0 THEN 'pieces' ELSE 'dollars' END AS units FROM part)
SELECT k * 4 AS rule_id, 'exact' AS title, series_id FROM n WHERE units = 'dollars'
UNION ALL SELECT k * 4 + 1, 'named', series_id FROM n
UNION ALL SELECT r.k * 4 + 3, 'tenfold', n.series_id FROM n JOIN n r ON n.k = r.k WHERE n.units = 'pieces'
UNION ALL SELECT r.k * 4 + 3, 'tenfold', n.series_id FROM n JOIN n r ON n.k // 10 = r.k AND n.k >= 10 WHERE n.units = 'pieces'
UNION ALL SELECT -1, 'any', series_id FROM n WHERE units = 'dollars'
UNION ALL SELECT -3, 'first', series_id FROM n WHERE k IN (0, 1)""")
def rule_table_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of rules, four for each part and some without a literal, against the names of all parts."""
    found = rule_index.match_rule_table(c.part_names(spark, sf_dir), c.part_rules(spark, sf_dir))
    return found.select("rule_id", "title", "series_id")
