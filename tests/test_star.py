import datetime

import pytest
from pyspark.sql import functions as F

from helpers import month, rows
from seriesforge.functions.names import column_name, label_before_comma
from seriesforge.operators import reshape, star
from seriesforge.operators.star import Rule
from seriesforge.sources.sinks import explain_text


@pytest.fixture(scope="module")
def facts(spark):
    data = [("a", month(i), str(i)) for i in range(30)] + [("b", month(0), None), ("z", month(1), "9")]
    return spark.createDataFrame(data, "series_id string, date date, value string")


@pytest.fixture(scope="module")
def dim(spark):
    return spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "series_id string, name string")


@pytest.mark.parametrize("hot_rows", [None, 5, 1_000_000])
def test_join_facts_is_the_outer_join_that_keeps_the_dimension(facts, dim, hot_rows):
    joined = star.join_facts(dim, facts, hot_rows=hot_rows)
    assert joined.columns == ["series_id", "name", "date", "value"]
    assert rows(joined) == rows(dim.join(facts, "series_id", "left"))
    assert rows(joined) == rows(facts.join(dim, "series_id", "right").select(*joined.columns))


def test_join_facts_broadcasts_the_small_side_only(spark, facts, dim, tmp_path):
    dim.write.parquet(str(tmp_path / "dim"))
    plan = explain_text(star.join_facts(spark.read.parquet(str(tmp_path / "dim")), facts, hot_rows=None), "simple")
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_hot_key_is_spread_over_tasks(spark, dim):
    """Half of the hot rows are copies of one another; all rows come back, and no task gets most of them."""
    hot = spark.range(0, 4000, numPartitions=8).select(
        F.lit("a").alias("series_id"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-1).alias("value"))
    facts = hot.unionByName(spark.createDataFrame([("b", 7), ("z", 8)], "series_id string, value bigint"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = star.join_facts(dim, facts, hot_rows=100)
        sizes = [r["count"] for r in joined.filter("series_id = 'a'").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) == 4000 and max(sizes) < 2000 and len(sizes) == 4
    assert rows(joined) == rows(dim.join(facts, "series_id", "left"))


def test_rules_match_name_and_unit_on_the_same_row(spark):
    df = spark.createDataFrame([
        ("1", "Net Generation, Coal, All Sectors, Monthly", "Million kWh"),
        ("2", "NET generation, Gas, all sectors, monthly", "percent"), ("3", "Other", "Million kWh"),
    ], "series_id string, name string, units string")
    rules = [Rule("all", "(?=net generation).*(all sectors, monthly)$", "million"), Rule("any", "generation", ".*")]
    matched = star.match_rules(df, rules)
    assert rows(matched, "category", "series_id") == [("all", "1"), ("any", "1"), ("any", "2")]
    plan = explain_text(matched, "simple")
    assert "Join" not in plan and "Exchange" not in plan
    assert rows(df.select(label_before_comma("name"))) == sorted([("Net Generation",), ("NET generation",), ("Other",)])


def test_filters_and_audits(facts):
    assert star.filter_dates(facts, since="2000-02-01", before="2000-04-01").count() == 3
    assert star.filter_dates(facts, after="2000-02-01").count() == 28
    assert star.count_missing(facts, "value", "date").first().asDict() == {"n_rows": 32, "n_value": 1, "n_date": 0}
    assert rows(star.date_limits(facts)) == [(month(0), month(29))]
    assert rows(star.tick_years(facts)) == [(2000,), (2002,)]


def test_date_filter_reaches_the_scan(spark, facts, tmp_path):
    facts.write.parquet(str(tmp_path / "f"))
    table = spark.read.parquet(str(tmp_path / "f"))
    plan = explain_text(star.filter_dates(table, since=datetime.date(2000, 3, 1)).select("date"), "simple")
    assert "GreaterThanOrEqual(date" in plan and "ReadSchema: struct<date:date>" in plan


def test_units_of_a_label(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("x", "a"), ("y", "c")], "label string, units string")
    assert rows(star.distinct_units(df, "label")) == [("x", "a, b"), ("y", "c")]


def test_column_names(spark):
    df = spark.createDataFrame([("Net From Natural Gas, All, Monthly",), ("Else Where",)], "name string")
    out = df.select(column_name("name", r"^Net From (.*), All, Monthly$", "eng_$1"))
    assert rows(out) == [("else_where",), ("eng_natural_gas",)]


def test_pivot_bucket_and_melt(spark):
    df = spark.createDataFrame(
        [("d1", "coal", 1.0), ("d1", "gas", 2.0), ("d1", "sun", 3.0), ("d1", "wind", 5.0), ("d2", "coal", 7.0)],
        "date string, name string, value double")
    bucketed = df.withColumn("name", star.bucket_other("name", ["coal", "gas"], "other"))
    wide = reshape.pivot_mean(bucketed, "date", "name", "value", ["coal", "gas", "other"])
    assert rows(wide) == [("d1", 1.0, 2.0, 4.0), ("d2", 7.0, None, None)]
    assert reshape.pivot_mean(df, "date", "name", "value").columns == ["date", "coal", "gas", "sun", "wind"]
    long = reshape.melt(wide, ["date"], ["coal", "gas", "other"])
    assert long.columns == ["date", "variable", "value"] and long.count() == 6 and long.filter("value is null").count() == 2
    back = reshape.pivot_mean(long, "date", "variable", "value", ["coal", "gas", "other"])
    assert rows(back) == rows(wide)


def test_seasonal_profile(spark):
    df = spark.createDataFrame([("s", month(i), float(i)) for i in range(14)], "series_id string, date date, value double")
    out = rows(reshape.seasonal_profile(df, ["series_id"]))
    assert out[0][:4] == ("s", 2000, 0.0, 1.0) and out[1][:5] == ("s", 2001, 12.0, 13.0, None)
