"""Star joins, filters, reshaping, series features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.functions.boxcox import boxcox, inverse_boxcox
from seriesforge.functions.clean import to_double
from seriesforge.functions.names import column_name, label_before_comma, matches_any
from seriesforge.operators import diagnose, evaluate, reshape, series, star
from seriesforge.operators.dims import Family, family_dimension, total_dimension
from seriesforge.operators.facts import explode_history
from seriesforge.operators.star import Rule
from seriesforge.plans import tables
from seriesforge.sources.bulk import keep_frequency
from workload import catalogs as c
from workload.registry import query

REDUCED = r"^Order Revenue From (.*), All Segments, Monthly$"
RULES = [
    Rule("All Segments", "(?=order revenue).*(all segments, monthly)$", "dollars"),
    Rule("Building", "(?=Order).*(Building Segment, Monthly)$", "Dollars|Orders"),
    Rule("Household", "(?=Order Revenue).*(Household Segment, Monthly)$", "Dollars"),
    Rule("Urgent", "from 1-urgent", "orders"),
]


def parts_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.regular(c.part_series(spark, sf_dir), tasks=series.tasks_for(c.table(spark, sf_dir, "lineitem")))


def regional_regular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.regular(c.regional_series(spark, sf_dir))


@query("""
SELECT series_id, name, units, date, CAST(value AS DOUBLE) AS value FROM seg_fact
WHERE (name LIKE '%Order Revenue%All Segments, Monthly' OR name LIKE '%Order Revenue%Building Segment, Monthly'
    OR name LIKE '%Order Revenue%Household Segment, Monthly' OR name LIKE '%Order Revenue%Machinery Segment, Monthly')
  AND units LIKE '%Dollars%'""", "seg_fact")
def dim_fact_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = ("All Segments", "Building Segment", "Household Segment", "Machinery Segment")
    names = [f"(?=Order Revenue).*({segment}, Monthly)$" for segment in segments]
    dim = star.filter_series(c.segment_dims(spark, sf_dir), names, ["Dollars"])
    facts = c.segment_facts(spark, sf_dir).select("series_id", "date", "value")
    return star.join_facts(dim, facts).withColumn("value", F.col("value").cast("double"))


@query("""
SELECT 'TPC.PART.RET.' || p_partkey || '-ALL.M' AS series_id, p_type AS fuel_type, date,
       CAST(qty AS DOUBLE) AS value
FROM returns""", "returns")
def fact_dim_right_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document keeps a row, also those with no label."""
    raw = keep_frequency(c.return_records(spark, sf_dir))
    returns = Family("returns", ("TPC.PART.RET.",), c.FAMILIES[1].parts)
    dim = family_dimension(raw, returns).select("series_id", "fuel_type")
    return star.join_facts(dim, explode_history(raw)).withColumn("value", to_double("value"))


@query("""
SELECT 'TPC.PART.REV.' || p_partkey || '-ALL.M' AS series_id, p_name, p_type, date, value
FROM part LEFT JOIN part_fact ON l_partkey = p_partkey""", "part_fact")
def broadcast_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts do not move while Spark's own size limit lets the dimension be broadcast."""
    part = c.table(spark, sf_dir, "part")
    dim = part.select(c.part_id("p_partkey").alias("series_id"), "p_name", "p_type")
    return star.join_facts(dim, c.part_facts(spark, sf_dir), hot_rows=None)


@query("""
SELECT series_id, name, units, max(date) AS updated
FROM seg_fact WHERE regexp_matches(name, '(Order Revenue From.*All Segments, Monthly$)') GROUP BY ALL""", "seg_fact")
def name_anchored_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = total_dimension(keep_frequency(c.segment_records(spark, sf_dir)))
    dim = dim.filter(matches_any("name", ["(Order Revenue From.*All Segments, Monthly$)"]))
    return dim.select("series_id", "name", "units", F.col("last_updated").cast("date").alias("updated"))


@query("""
SELECT r.category, series_id, name, units, regexp_extract(name, '^[^,]+') AS label
FROM seg_dim JOIN (VALUES ('All Segments', 'order revenue.*all segments, monthly$', 'dollars'),
                          ('Building', 'order.*building segment, monthly$', 'dollars|orders'),
                          ('Household', 'order revenue.*household segment, monthly$', 'dollars'),
                          ('Urgent', 'from 1-urgent', 'orders')) r(category, a, b)
  ON regexp_matches(lower(name), a) AND regexp_matches(lower(units), b)""", "seg_dim")
def category_rules_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = star.match_rules(c.segment_dims(spark, sf_dir), RULES)
    return matched.select("category", "series_id", "name", "units", label_before_comma("name").alias("label"))


@query("""
SELECT r.category, series_id, regexp_extract(name, '^[^,]+') AS label, units, date, CAST(value AS DOUBLE) AS value
FROM seg_fact JOIN (VALUES ('All Segments', 'order revenue.*all segments, monthly$', 'dollars'),
                           ('Building', 'order.*building segment, monthly$', 'dollars|orders'),
                           ('Household', 'order revenue.*household segment, monthly$', 'dollars'),
                           ('Urgent', 'from 1-urgent', 'orders')) r(category, a, b)
  ON regexp_matches(lower(name), a) AND regexp_matches(lower(units), b)""", "seg_fact")
def category_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations behind one chart per category, from the tables of the total job."""
    raw = keep_frequency(c.segment_records(spark, sf_dir))
    return tables.category_series(total_dimension(raw), explode_history(raw), RULES)


@query("""
SELECT regexp_extract(name, '^[^,]+') AS label, string_agg(DISTINCT units, ', ' ORDER BY units) AS unit_label
FROM seg_dim GROUP BY 1""", "seg_dim")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = c.segment_dims(spark, sf_dir).withColumn("label", label_before_comma("name"))
    return star.distinct_units(dim, "label")


@query("SELECT DISTINCT name, units FROM seg_dim", "seg_dim")
def distinct_name_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.segment_dims(spark, sf_dir).select("name", "units").distinct()


@query("""
SELECT series_id, date, y FROM prt WHERE date >= DATE '1996-01-01' AND date < DATE '2000-01-01'""", "prt")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.filter_dates(c.part_series(spark, sf_dir), since="1996-01-01", before="2000-01-01")


@query("SELECT series_id, date, y FROM reg WHERE date > DATE '1999-01-01'", "reg")
def date_strict_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.filter_dates(c.regional_series(spark, sf_dir), after="1999-01-01")


@query("""
SELECT count(*) AS n_rows, count(*) FILTER (value IS NULL OR value = '') AS n_value,
       count(*) FILTER (date IS NULL) AS n_date
FROM part_fact""", "part_fact")
def null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.count_missing(c.part_facts(spark, sf_dir), "value", "date")


@query("SELECT min(date) AS min_date, max(date) AS max_date FROM part_fact", "part_fact")
def date_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.date_limits(c.part_facts(spark, sf_dir))


@query("""
SELECT CAST(year AS INTEGER) AS year FROM (
  SELECT year, row_number() OVER (ORDER BY year) AS r FROM (SELECT DISTINCT year(date) AS year FROM part_fact))
WHERE r % 2 = 1""", "part_fact")
def tick_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.tick_years(c.part_facts(spark, sf_dir))


@query("""
SELECT series_id, replace(lower(regexp_replace(name, '^Order Revenue From (.*), All Segments, Monthly$', 'rev_\\1')), ' ', '_') AS column_name
FROM seg_dim""", "seg_dim")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.segment_dims(spark, sf_dir).select("series_id", column_name("name", REDUCED, "rev_$1").alias("column_name"))


def _total_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.segment_facts(spark, sf_dir).withColumn("name", c.segment_name())
    rows = rows.filter(matches_any("name", [REDUCED]))
    return rows.select("date", column_name("name", REDUCED, "rev_$1").alias("name"), F.col("value").cast("double").alias("value"))


COLUMNS = ["rev_1-urgent", "rev_2-high", "rev_3-medium", "rev_4-not_specified", "rev_5-low"]
_NAMED = """
    SELECT date, replace(lower('rev_' || prio), ' ', '_') AS name, CAST(value AS DOUBLE) AS value
    FROM seg_fact WHERE seg = 'ALL' AND measure = 'REV'"""
_PIVOT = ", ".join(f"avg(value) FILTER (name = '{n}') AS \"{n}\"" for n in COLUMNS)


@query(f"SELECT date, {_PIVOT} FROM ({_NAMED}) GROUP BY 1", "seg_fact")
def pivot_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.pivot_mean(_total_revenue(spark, sf_dir), "date", "name", "value", COLUMNS)


KEPT = ["rev_1-urgent", "rev_2-high", "rev_5-low"]


@query(f"""
SELECT date, {", ".join(f"avg(value) FILTER (name = '{n}') AS " + '"' + n + '"' for n in KEPT)},
       avg(value) FILTER (name NOT IN ('rev_1-urgent', 'rev_2-high', 'rev_5-low')) AS rev_other
FROM ({_NAMED}) WHERE date > DATE '1997-01-01' GROUP BY 1""", "seg_fact")
def pivot_mean_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bucket holds the mean of its members."""
    rows = star.filter_dates(_total_revenue(spark, sf_dir), after="1997-01-01")
    rows = rows.withColumn("name", star.bucket_other("name", KEPT, "rev_other"))
    return reshape.pivot_mean(rows, "date", "name", "value", [*KEPT, "rev_other"])


@query(f"""
SELECT date, {", ".join(f"avg(value) FILTER (name = '{n}') AS " + '"' + n + '"' for n in KEPT)},
       avg(value) FILTER (name NOT IN ('rev_1-urgent', 'rev_2-high', 'rev_5-low')) AS rev_other
FROM ({_NAMED}) WHERE date >= DATE '1996-01-01' AND date < DATE '2001-01-01' GROUP BY 1""", "seg_fact")
def wide_study_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table a forecasting study starts from, built from dimension and facts in one chain."""
    raw = keep_frequency(c.segment_records(spark, sf_dir))
    return tables.wide_table(total_dimension(raw), explode_history(raw), REDUCED, "rev_$1", KEPT,
                             since="1996-01-01", before="2001-01-01", other="rev_other")


@query(f"""
SELECT d.date, n.name AS id, v.value AS val
FROM (SELECT DISTINCT date FROM ({_NAMED})) d CROSS JOIN (SELECT DISTINCT name FROM ({_NAMED})) n
LEFT JOIN ({_NAMED}) v ON v.date = d.date AND v.name = n.name""", "seg_fact")
def unpivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.melt(pivot_mean(spark, sf_dir), ["date"], COLUMNS, "id", "val")


@query(f"""
SELECT series_id, CAST(year(date) AS INTEGER) AS year,
       {", ".join(f"avg(y) FILTER (month(date) = {m}) AS m{m}" for m in range(1, 13))}
FROM reg GROUP BY 1, 2""", "reg")
def seasonal_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.seasonal_profile(c.regional_series(spark, sf_dir), ["series_id"], value="y")


@query("SELECT series_id, idx, date, y FROM prt_ser", "prt_ser")
def month_spine_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts_regular(spark, sf_dir)


@query("""
SELECT series_id, idx, date, x_lag1 FROM (
  SELECT *, lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS x_lag1 FROM prt_ser) WHERE date > DATE '1999-01-01'""",
       "prt_ser")
def lag_before_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.lagged(parts_regular(spark, sf_dir), "y", 1, "x_lag1").drop("y")
    return star.filter_dates(rows, after="1999-01-01")


@query("""
SELECT a.series_id, a.idx, a.date, round(CASE WHEN count(b.y) = 13 THEN sum(b.y) / 13 END, 3) AS y_mean13
FROM reg_ser a JOIN reg_ser b ON a.series_id = b.series_id AND b.idx BETWEEN a.idx - 13 AND a.idx - 1
GROUP BY ALL UNION ALL SELECT series_id, idx, date, NULL FROM reg_ser WHERE idx = 1""", "reg_ser")
def rolling_mean_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the 13 months before the current one."""
    rows = series.lagged(regional_regular(spark, sf_dir), "y", 1, "x")
    rows = series.rolling_mean(rows, "x", 13, "y_mean13")
    return rows.select("series_id", "idx", "date", F.round("y_mean13", 3).alias("y_mean13"))


@query("""
SELECT series_id, idx, y - lag(y) OVER w AS d1, y - lag(y, 12) OVER w AS d12,
       (y - lag(y) OVER w) - (lag(y, 12) OVER w - lag(y, 13) OVER w) AS d1_12, y - 2 * lag(y) OVER w + lag(y, 2) OVER w AS d2
FROM prt_ser WINDOW w AS (PARTITION BY series_id ORDER BY idx)""", "prt_ser")
def difference_1_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parts_regular(spark, sf_dir)
    for name, (d, seasonal_d) in {"d1": (1, 0), "d12": (0, 1), "d1_12": (1, 1), "d2": (2, 0)}.items():
        rows = series.difference(rows, "y", d, seasonal_d, name=name)
    return rows.select("series_id", "idx", "d1", "d12", "d1_12", "d2")


@query("""
SELECT series_id, idx, y, CASE WHEN idx <= n - 24 THEN 'train' ELSE 'test' END AS part,
       CASE WHEN idx > n - 24 THEN idx - n + 24 END AS k
FROM (SELECT *, max(idx) OVER (PARTITION BY series_id) AS n FROM prt_ser)""", "prt_ser")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.split_train_test(parts_regular(spark, sf_dir), 24).drop("date")


@query("""
SELECT series_id, idx, y, 'train' AS part, NULL AS k FROM (
  SELECT *, max(idx) OVER (PARTITION BY series_id) AS n FROM reg_ser) WHERE idx <= n - 48
UNION ALL
SELECT series_id, idx, y, 'test', idx - n + 48 FROM (
  SELECT *, max(idx) OVER (PARTITION BY series_id) AS n FROM reg_ser) WHERE idx >= n - 48""", "reg_ser")
def train_test_split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test set starts at the last training row: 49 rows for a length of 48."""
    return series.split_train_test(regional_regular(spark, sf_dir), 48, overlap=1).drop("date")


@query("SELECT series_id, idx, date, y, x FROM reg_x", "reg_x")
def regressor_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_order_value(spark, sf_dir)


def with_order_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regional series with last month's value of all orders as regressor ``x``."""
    orders = c.order_series(spark, sf_dir).groupBy("date").agg(F.sum("y").alias("x"))
    return series.with_regressor(regional_regular(spark, sf_dir), orders)


_ACF = """
SELECT series_id, lag, n, s / (m + lag) / v AS acf FROM (
  SELECT a.series_id, l.lag, sum(a.c * b.c) AS s, count(a.c * b.c) AS m
  FROM c a CROSS JOIN (SELECT CAST(unnest(range(1, 25)) AS INTEGER) AS lag) l
  LEFT JOIN c b ON b.series_id = a.series_id AND b.idx = a.idx - l.lag GROUP BY ALL)
JOIN (SELECT series_id, avg(c * c) AS v, count(c) AS n FROM c GROUP BY 1) USING (series_id)"""
_CENTRED = "c AS (SELECT series_id, idx, {0} - avg({0}) OVER (PARTITION BY series_id) AS c FROM {1})"


@query(f"""
, {_CENTRED.format("y", "reg_ser")}
SELECT series_id, lag, n, round(acf, 6) AS acf FROM ({_ACF})""", "reg_ser")
def acf_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.acf(regional_regular(spark, sf_dir), 24)
    return rows.select("series_id", "lag", "n", F.round("acf", 6).alias("acf"))


@query(f"""
, {_CENTRED.format("y", "reg_ser")},
r AS (SELECT series_id, list(acf ORDER BY lag) AS r FROM ({_ACF}) GROUP BY 1),
dl(series_id, r, k, phi, p) AS (
  SELECT series_id, r, 1, [r[1]], r[1] FROM r
  UNION ALL
  SELECT series_id, r, k + 1,
         list_append(list_transform(range(1, k + 1), lambda j: phi[j] - last * phi[k + 1 - j]), last), last
  FROM (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[k + 1 - j])))
                  / (1 - list_sum(list_transform(range(1, k + 1), lambda j: phi[j] * r[j]))) AS last
        FROM dl WHERE k < 24))
SELECT series_id, k AS lag, round(p, 6) AS pacf FROM dl""", "reg_ser")
def pacf_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = diagnose.pacf(regional_regular(spark, sf_dir), 24)
    return rows.select("series_id", "lag", F.round("pacf", 6).alias("pacf"))


@query(f"""
, e AS (SELECT a.series_id, a.idx, a.y - b.y AS e FROM reg_ser a LEFT JOIN reg_ser b ON b.series_id = a.series_id AND b.idx = a.idx - 12),
{_CENTRED.format("e", "e")},
s AS (SELECT series_id, max(n) AS n, max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM ({_ACF}) GROUP BY 1)
SELECT series_id, n, round(q, 5) AS statistic, 24 AS df,
       round(exp(-q / 2) * list_sum(list_transform(range(0, 12), lambda j: pow(q / 2, j) / factorial(CAST(j AS INTEGER)))), 6) AS p_value
FROM (SELECT series_id, n, CASE WHEN n > 24 THEN q END AS q FROM s)""", "reg_ser")
def ljung_box_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series.difference(regional_regular(spark, sf_dir), "y", 0, 1, name="residual")
    test = diagnose.ljung_box(rows, 24)
    return test.withColumns({"statistic": F.round("statistic", 5), "p_value": F.round("p_value", 6)})


@query(f"""
, {_CENTRED.format("y", "prt_ser")},
s AS (SELECT series_id, max(n) AS n, CASE WHEN count(acf) = 6 THEN max(n) * (max(n) + 2) * sum(acf * acf / nullif(n - lag, 0)) END AS q FROM ({_ACF.replace("range(1, 25)", "range(1, 7)")}) GROUP BY 1)
SELECT series_id, n, round(q, 5) AS statistic, 6 AS df,
       round(exp(-q / 2) * list_sum(list_transform(range(0, 3), lambda j: pow(q / 2, j) / factorial(CAST(j AS INTEGER)))), 6) AS p_value
FROM (SELECT series_id, n, CASE WHEN n > 6 THEN q END AS q FROM s)""", "prt_ser")
def ljung_box_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same test on every part's series; short ones have a row without a statistic."""
    test = diagnose.ljung_box(parts_regular(spark, sf_dir), 6, column="y")
    return test.withColumns({"statistic": F.round("statistic", 5), "p_value": F.round("p_value", 6)})


@query("""
SELECT series_id, idx, round(ln(y), 6) AS log_y, round(2 * (sqrt(y) - 1), 4) AS half, y AS back
FROM reg_ser""", "reg_ser")
def boxcox_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regional_regular(spark, sf_dir)
    log_y, half = boxcox(F.col("y"), F.lit(0.0)), boxcox(F.col("y"), F.lit(0.5))
    return rows.select("series_id", "idx", F.round(log_y, 6).alias("log_y"), F.round(half, 4).alias("half"),
                       F.round(inverse_boxcox(log_y, F.lit(0.0))).alias("back"))


@query("""
, b AS (SELECT series_id, block, avg(y) AS m, stddev_samp(y) AS s
        FROM (SELECT *, (max(idx) OVER (PARTITION BY series_id) - idx) // 12 AS block FROM reg_ser)
        GROUP BY ALL HAVING count(*) = 12),
v AS (SELECT series_id, lam, stddev_samp(s / pow(m, 1 - lam)) / avg(s / pow(m, 1 - lam)) AS cv
      FROM b CROSS JOIN (SELECT CAST(round(-0.9 + 0.05 * unnest(range(0, 59)), 2) AS DOUBLE) AS lam) GROUP BY ALL)
SELECT series_id, arg_min(lam, cv) AS lam FROM v GROUP BY 1""", "reg_ser")
def boxcox_auto_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnose.auto_lambda(regional_regular(spark, sf_dir)).withColumnRenamed("lambda", "lam")


@query("""
SELECT series_id, CAST(year(date) AS INTEGER) AS year, count(*) AS n_rows
FROM part_fact GROUP BY 1, 2 HAVING count(value) = 0""", "part_fact")
def all_missing_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part and year without a single value that is not withheld."""
    facts = c.part_facts(spark, sf_dir).withColumn("year", F.year("date"))
    return evaluate.all_missing(facts, "value", "series_id", "year")
