"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Register a function under its own name; ``ctes`` are the shared steps its SQL builds on."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = with_steps(sql, *ctes)
        return fn

    return register


def with_steps(sql: str, *names: str) -> str:
    needed: list[str] = []

    def add(name: str) -> None:
        for base in STEPS[name][0]:
            add(base)
        if name not in needed:
            needed.append(name)

    for name in names:
        add(name)
    if not needed:
        return sql
    sql = sql.strip()
    recursive = "RECURSIVE " if sql.startswith(",") else ""  # the query adds steps of its own
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({STEPS[n][1].strip()})" for n in needed) + "\n" + sql


_REV = "(SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT) * (100 - CAST(ROUND(l_discount * 100) AS BIGINT))) + 5000) // 10000"


def _spine(src: str) -> str:
    return f"""
    SELECT series_id, CAST(row_number() OVER (PARTITION BY series_id ORDER BY date) AS INTEGER) AS idx, date, y
    FROM (SELECT series_id, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date
          FROM (SELECT series_id, min(date) AS a, max(date) AS b FROM {src} GROUP BY 1)) s
    LEFT JOIN {src} USING (series_id, date)"""


# Shared steps: name -> (steps it needs, SQL).
STEPS: dict[str, tuple] = {
    "regional": ((), f"""
    SELECT p_type, r_name, r_regionkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
           CAST({_REV} AS BIGINT) AS rev, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
           CAST(SUM(CAST(ROUND(l_discount * 100) AS BIGINT)) * 100 // COUNT(*) AS BIGINT) AS disc,
           CAST(SUM(CAST(ROUND(l_tax * 100) AS BIGINT)) * 100 // COUNT(*) AS BIGINT) AS tax
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
    GROUP BY ALL"""),
    "reg": (("regional",), "SELECT 'TPC.REV.' || p_type || '-' || r_name || '.M' AS series_id, date, CAST(rev AS DOUBLE) AS y FROM regional"),
    "reg_ser": (("reg",), _spine("reg")),
    "typ": (("regional",), """
    SELECT 'TPC.TYPE.' || p_type || '.M' AS series_id, date, CAST(SUM(rev) AS DOUBLE) / day(last_day(date)) AS y
    FROM regional GROUP BY p_type, date"""),
    "typ_ser": (("typ",), _spine("typ")),
    "regional_long": (("regional",), """
    SELECT m AS measure, p_type, r_name, r_regionkey, strftime(date, '%Y%m') AS period, v AS value
    FROM (SELECT *, unnest(['REV', 'QTY', 'DISC', 'TAX']) AS m, unnest([rev, qty, disc, tax]) AS v FROM regional)"""),
    "regional_dim": (("regional_long",), """
    SELECT 'TPC.' || measure || '.' || p_type || '-' || r_name || '.M' AS series_id, measure, p_type, r_name,
           r_regionkey, min(period) AS first_period, max(period) AS last_period, count(*) AS n_obs
    FROM regional_long GROUP BY ALL"""),
    "parts": ((), f"""
    SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST({_REV} AS BIGINT) AS rev,
           CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty
    FROM lineitem GROUP BY ALL"""),
    "prt": (("parts",), "SELECT 'TPC.PART.REV.' || l_partkey || '-ALL.M' AS series_id, date, CAST(rev AS DOUBLE) AS y FROM parts"),
    "prt_ser": (("prt",), _spine("prt")),
    "part_fact": (("parts",), """
    SELECT 'TPC.PART.REV.' || l_partkey || '-ALL.M' AS series_id, l_partkey, date,
           CASE WHEN qty % 10 > 1 THEN CAST(rev AS VARCHAR) END AS value FROM parts"""),
    "returns": ((), """
    SELECT d.doc_id AS p_partkey, lang AS p_name, source AS p_type, date, qty FROM documents d LEFT JOIN (
        SELECT doc_id, unnest([DATE '2000-01-01', DATE '2000-02-01']) AS date, CAST(unnest([quality, toxic]) AS BIGINT) AS qty
        FROM labels) USING (doc_id)"""),
    "order_month": ((), """
    SELECT o_orderpriority, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
           SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents
    FROM orders GROUP BY ALL"""),
    "ord": (("order_month",), """
    SELECT 'TPC.ORD.' || o_orderpriority || '.M' AS series_id, date, CAST((cents + 50) // 100 AS DOUBLE) AS y
    FROM order_month"""),
    "ord_ser": (("ord",), _spine("ord")),
    "all_orders": (("order_month",), """
    SELECT date, CAST(SUM((cents + 50) // 100) AS DOUBLE) AS x FROM order_month GROUP BY 1"""),
    "reg_x": (("reg_ser", "all_orders"), """
    SELECT series_id, idx, s.date, y, x FROM reg_ser s
    LEFT JOIN all_orders a ON s.date = CAST(a.date + INTERVAL 1 MONTH AS DATE)"""),
    "seg_month": ((), """
    SELECT o_orderpriority AS prio, seg, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
           SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT)) AS cents, COUNT(*) AS orders
    FROM (SELECT *, unnest([c_mktsegment, 'ALL']) AS seg FROM orders JOIN customer ON c_custkey = o_custkey)
    GROUP BY ALL"""),
    "seg_fact": (("seg_month",), """
    SELECT 'TOT.' || measure || '.' || prio || '.' || seg || '.M' AS series_id, prio, seg, measure, date,
           CAST(value AS BIGINT) AS value,
           CASE measure WHEN 'REV' THEN 'Order Revenue' ELSE 'Order Count' END || ' From ' || prio || ', ' ||
             CASE seg WHEN 'ALL' THEN 'All Segments' ELSE upper(seg[1:1]) || lower(seg[2:]) || ' Segment' END ||
             ', Monthly' AS name,
           CASE measure WHEN 'REV' THEN 'Dollars' ELSE 'Orders' END AS units
    FROM (SELECT *, unnest(['REV', 'CNT']) AS measure, unnest([(cents + 50) // 100, orders]) AS value FROM seg_month)"""),
    "seg_dim": (("seg_fact",), "SELECT DISTINCT series_id, prio, seg, measure, name, units FROM seg_fact"),
}
