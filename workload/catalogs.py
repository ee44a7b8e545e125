"""Bulk catalogues derived from the driver's tables, in the layouts of the bulk files.

Values are whole numbers (money in whole units, rates in basis points), so that sums do not depend on
the order of addition. Every catalogue is an aggregate over a whole table to one row per series and
calendar month; a packed history therefore has at most one entry per calendar month.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesforge.operators.dims import Family
from seriesforge.sources.bulk import ELECTRICITY_SCHEMA, TOTAL_SCHEMA

# Families of the catalogues, the counterpart of the electricity families.
FAMILIES = (
    Family("power", ("TPC.REV.",), ("value_type", "fuel_type", "region", "sector", "frequency")),
    Family("plant_level", ("TPC.PART.REV.",),
           ("value_type", "plant_name", "fuel_type", "engine_type", "frequency"), plant_id=True),
    Family("retail", ("TPC.QTY.",), ("value_type", "region", "sector", "frequency")),
    Family("fossil_fuel", ("TPC.ORD.",), ("value_type", "fuel_type", "region", "sector", "frequency")),
    Family("fossil_fuel_quality", ("TPC.DISC.",),
           ("value_type", "quality_type", "fuel_type", "region", "sector", "frequency")),
)


# Columns of the driver's tables; a given schema saves the job that infers it on every read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def hundredths(name: str) -> Column:
    return F.round(F.col(name) * 100).cast("long")


def month_of(name: str) -> Column:
    return F.trunc(F.col(name).cast("date"), "month")


def regional_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(p_type, r_name, r_regionkey, date, rev, qty, disc, tax)`` per part type, region and ship month.

    The joins are plain inner equi-joins on unique keys: adaptive execution splits a hot key, and Spark
    broadcasts a side when its size is under the session's threshold.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_suppkey", month_of("l_shipdate").alias("date"),
        (hundredths("l_extendedprice") * (100 - hundredths("l_discount"))).alias("rev"),
        F.col("l_quantity").cast("long").alias("qty"),
        hundredths("l_discount").alias("disc"), hundredths("l_tax").alias("tax"),
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    # One base table after the other: Spark knows the size of each file, not that of a join.
    placed = (
        lines.join(part, "l_partkey").join(supplier, "l_suppkey").join(nation, "n_nationkey")
        .join(table(spark, sf_dir, "region"), "r_regionkey")
    )
    sums = placed.groupBy(
        "p_type", "r_name", "r_regionkey", "date").agg(
        F.sum("rev").alias("_rev"), F.sum("qty").alias("qty"), F.sum("disc").alias("_disc"),
        F.sum("tax").alias("_tax"), F.count("*").alias("_n"))
    return sums.select(
        "p_type", "r_name", "r_regionkey", "date", F.expr("(_rev + 5000) div 10000").alias("rev"), "qty",
        F.expr("(_disc * 100) div _n").alias("disc"), F.expr("(_tax * 100) div _n").alias("tax"))


def regional_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue per part type and region: ``(series_id, date, y)``."""
    rows = regional_months(spark, sf_dir)
    return rows.select(
        F.concat(F.lit("TPC.REV."), "p_type", F.lit("-"), "r_name", F.lit(".M")).alias("series_id"), "date",
        F.col("rev").cast("double").alias("y"))


def type_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean revenue per day of the month, per part type over all regions: ``(series_id, date, y)``."""
    return regional_months(spark, sf_dir).groupBy("p_type", "date").agg(F.sum("rev").alias("rev")).select(
        F.concat(F.lit("TPC.TYPE."), "p_type", F.lit(".M")).alias("series_id"), "date",
        (F.col("rev").cast("double") / F.dayofmonth(F.last_day("date"))).alias("y"))


def part_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(l_partkey, date, rev, qty)`` per part and ship month. Aggregated before anything is joined."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_partkey", month_of("l_shipdate").alias("date"),
        (hundredths("l_extendedprice") * (100 - hundredths("l_discount"))).alias("rev"),
        F.col("l_quantity").cast("long").alias("qty"))
    sums = lines.groupBy("l_partkey", "date").agg(F.sum("rev").alias("_rev"), F.sum("qty").alias("qty"))
    return sums.select("l_partkey", "date", F.expr("(_rev + 5000) div 10000").alias("rev"), "qty")


def part_id(key: str = "l_partkey", measure: str = "REV") -> Column:
    return F.concat(F.lit(f"TPC.PART.{measure}."), F.col(key).cast("string"), F.lit("-ALL.M"))


def part_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue per part: ``(series_id, date, y)``, gaps included as missing rows."""
    return part_months(spark, sf_dir).select(
        part_id().alias("series_id"), "date", F.col("rev").cast("double").alias("y"))


def withheld(value: Column, size: Column) -> Column:
    """Value as text; small cells are withheld by one of the two sentinel texts."""
    return F.when(size % 10 == 0, "null").when(size % 10 == 1, "").otherwise(value.cast("string"))


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact table per part ``(series_id, date, value)`` with ``value`` as cleaned text."""
    value = F.when(F.col("qty") % 10 > 1, F.col("rev").cast("string"))
    return part_months(spark, sf_dir).select(part_id().alias("series_id"), "date", value.alias("value"))


def order_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(o_orderpriority, date, cents)`` per priority and order month."""
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", month_of("o_orderdate").alias("date")).agg(
        F.sum(hundredths("o_totalprice")).alias("cents"))


def order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value per priority: ``(series_id, date, y)``."""
    return order_months(spark, sf_dir).select(
        F.concat(F.lit("TPC.ORD."), "o_orderpriority", F.lit(".M")).alias("series_id"), "date",
        F.expr("(cents + 50) div 100").cast("double").alias("y"))


def segment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(prio, seg, date, cents, orders)`` per priority, market segment (and ``ALL``) and order month."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("prio"),
        month_of("o_orderdate").alias("date"), hundredths("o_totalprice").alias("cents"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"))
    by_segment = orders.join(customers, "c_custkey").groupBy("prio", "seg", "date").agg(
        F.sum("cents").alias("cents"), F.count("*").alias("orders"))
    # The second level reads the small result of the first.
    return by_segment.select(
        "prio", F.explode(F.array("seg", F.lit("ALL"))).alias("seg"), "date", "cents", "orders",
    ).groupBy("prio", "seg", "date").agg(F.sum("cents").alias("cents"), F.sum("orders").alias("orders"))


def segment_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series_id, prio, seg, measure, date, value)`` with revenue and order counts."""
    rows = segment_months(spark, sf_dir).withColumn("REV", F.expr("(cents + 50) div 100"))
    long = rows.select("prio", "seg", "date", "REV", F.col("orders").alias("CNT")).unpivot(
        ["prio", "seg", "date"], ["REV", "CNT"], "measure", "value")
    ident = F.concat(F.lit("TOT."), "measure", F.lit("."), "prio", F.lit("."), "seg", F.lit(".M"))
    return long.select(ident.alias("series_id"), "prio", "seg", "measure", "date", "value")


def segment_name() -> Column:
    what = F.when(F.col("measure") == "REV", "Order Revenue").otherwise("Order Count")
    which = F.when(F.col("seg") == "ALL", "All Segments").otherwise(
        F.concat(F.initcap("seg"), F.lit(" Segment")))
    return F.concat(what, F.lit(" From "), "prio", F.lit(", "), which, F.lit(", Monthly"))


def segment_units() -> Column:
    return F.when(F.col("measure") == "REV", "Dollars").otherwise("Orders")


def segment_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(series_id, name, units)`` of the total catalogue."""
    return segment_facts(spark, sf_dir).select("series_id", "prio", "seg", "measure").distinct().select(
        "series_id", segment_name().alias("name"), segment_units().alias("units"))


def pack_history(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows ``(keys, period, value)`` to one record per key with ``data`` newest first, start and end."""
    pairs = F.sort_array(F.collect_list(F.struct("period", "value")), asc=False)
    return rows.groupBy(*keys).agg(
        F.transform(pairs, lambda p: F.array(p["period"], p["value"])).alias("data"),
        F.min("period").alias("start"), F.max("period").alias("end"))


def _stamp(end: Column) -> Column:
    return F.concat(F.substring(end, 1, 4), F.lit("-"), F.substring(end, 5, 2), F.lit("-01T12:00:00-04:00"))


def _record(rows: DataFrame, schema, **columns: Column) -> DataFrame:
    """Fill the columns of a bulk layout, NULL where the catalogue has none."""
    return rows.select(*[
        (columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema
    ])


def regional_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four measures per part type and region; the tax series belong to no family."""
    long = regional_months(spark, sf_dir).select(
        "p_type", "r_name", "r_regionkey", F.date_format("date", "yyyyMM").alias("period"),
        F.col("rev").alias("REV"), F.col("qty").alias("QTY"), F.col("disc").alias("DISC"),
        F.col("tax").alias("TAX"),
    ).unpivot(["p_type", "r_name", "r_regionkey", "period"], ["REV", "QTY", "DISC", "TAX"], "measure", "value")
    packed = pack_history(long.withColumn("value", F.col("value").cast("string")),
                          "measure", "p_type", "r_name", "r_regionkey")
    m, rk = F.col("measure"), F.col("r_regionkey")
    sep = F.lit(" : ")
    name = (
        F.when(m == "REV", F.concat(F.lit("Revenue"), sep, "p_type", sep, "r_name", F.lit(" : all : monthly")))
        .when(m == "QTY", F.concat(F.lit("Quantity"), sep, "r_name", sep, "p_type", F.lit(" : monthly")))
        .when(m == "DISC", F.concat(F.lit("Discount : rate"), sep, "p_type", sep, "r_name", F.lit(" :  : monthly")))
        .otherwise(F.concat(F.lit("Tax"), sep, "p_type"))
    )
    return _record(
        packed, ELECTRICITY_SCHEMA,
        copyright=F.lit("None"), description=F.when(rk == 0, "").when(rk == 1, "null").otherwise("Monthly totals"), start=F.col("start"),
        end=F.col("end"), f=F.lit("M"), geography=F.col("r_name"),
        iso3166=F.when(F.col("r_regionkey") > 2, "null").otherwise(F.concat(F.lit("R-"), F.col("r_regionkey").cast("string"))),
        lat=F.when(F.col("r_regionkey") == 3, "n/a").otherwise(F.concat(F.col("r_regionkey").cast("string"), F.lit("1.5"))),
        latlon=F.lit(""), lon=F.concat(F.lit("-8"), F.col("r_regionkey").cast("string"), F.lit(".25")),
        name=name, source=F.lit("tables"),
        units=F.when(m == "REV", "dollars").when(m == "QTY", "pieces").otherwise("basis points"),
        last_updated=F.when(F.col("r_regionkey") == 4, "bad").otherwise(_stamp(F.col("end"))),
        series_id=F.concat(F.lit("TPC."), "measure", F.lit("."), "p_type", F.lit("-"), "r_name", F.lit(".M")),
        data=F.col("data"),
    )


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One monthly revenue record per sold part, small cells withheld."""
    rows = part_months(spark, sf_dir).select(
        "l_partkey", F.date_format("date", "yyyyMM").alias("period"),
        withheld(F.col("rev"), F.col("qty")).alias("value"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    return _part_record(pack_history(rows, "l_partkey").join(part, "l_partkey"), "REV", "Revenue")


def return_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document with its labels as two months; documents without labels have no history."""
    months = F.inline(F.array(*[F.struct(F.lit(p).alias("period"), F.col(v).cast("string").alias("value"))
                                for p, v in (("200001", "quality"), ("200002", "toxic"))]))
    packed = pack_history(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_partkey"), months), "l_partkey")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("l_partkey"), F.col("lang").alias("p_name"), F.col("source").alias("p_type"))
    return _part_record(docs.join(packed, "l_partkey", "left"), "RET", "Labels")


def _part_record(rows: DataFrame, measure: str, label: str) -> DataFrame:
    key = F.col("l_partkey").cast("string")
    return _record(
        rows, ELECTRICITY_SCHEMA, f=F.lit("M"), start=F.col("start"), end=F.col("end"), units=F.lit("dollars"),
        name=F.concat(F.lit(f"{label} : "), "p_name", F.lit(" ("), key, F.lit(") : "), "p_type", F.lit(" : all : monthly")),
        last_updated=_stamp(F.col("end")), series_id=part_id(measure=measure), data=F.col("data"),
    )


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A monthly and an annual record per order priority."""
    months = order_months(spark, sf_dir)
    both = months.select(
        "o_orderpriority", "cents",
        F.inline(F.array(
            F.struct(F.lit("M").alias("f"), F.date_format("date", "yyyyMM").alias("period")),
            F.struct(F.lit("A").alias("f"), F.date_format("date", "yyyy").alias("period")))),
    ).groupBy("o_orderpriority", "f", "period").agg(F.sum("cents").alias("cents"))
    rows = both.withColumn("value", F.expr("(cents + 50) div 100").cast("string"))
    packed = pack_history(rows, "o_orderpriority", "f")
    return _record(
        packed, ELECTRICITY_SCHEMA, f=F.col("f"), start=F.col("start"), end=F.col("end"), units=F.lit("dollars"),
        name=F.concat(F.lit("Order value : "), "o_orderpriority", F.lit(" : all : all : "),
                      F.when(F.col("f") == "M", "monthly").otherwise("annual")),
        last_updated=F.when(F.col("f") == "M", _stamp(F.col("end"))),
        series_id=F.concat(F.lit("TPC.ORD."), "o_orderpriority", F.lit("."), "f"), data=F.col("data"),
    )


def segment_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total layout: revenue and order counts per priority and segment; ``ALL`` lists its segments."""
    rows = segment_facts(spark, sf_dir).select(
        "series_id", "prio", "seg", "measure", F.date_format("date", "yyyyMM").alias("period"),
        F.col("value").cast("string").alias("value"))
    packed = pack_history(rows, "series_id", "prio", "seg", "measure")
    children = packed.filter("seg <> 'ALL'").groupBy("prio", "measure").agg(
        F.array_sort(F.collect_set("series_id")).alias("childseries"))
    full = packed.join(children, ["prio", "measure"], "left")
    return _record(
        full, TOTAL_SCHEMA,
        category_id=F.substring("prio", 1, 1), f=F.lit("M"), name=segment_name(),
        notes=F.when(F.col("seg") == "ALL", "").otherwise("null"), parent_category_id=F.lit("0"),
        units=segment_units(), start=F.col("start"), end=F.col("end"), last_updated=_stamp(F.col("end")),
        series_id=F.col("series_id"), data=F.col("data"),
        childseries=F.when(F.col("seg") == "ALL", F.col("childseries")),
    )


def category_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category records of the total layout: customers under the customer with a tenth of their number, some also under their market segment;
    segments list every seventh customer's series; regions are each other's parents in a circle, with the nations below."""
    customer = table(spark, sf_dir, "customer")
    k, segment = F.col("c_custkey"), F.concat(F.lit("S-"), F.col("c_mktsegment"))
    series_id = F.concat(F.lit("CUS."), k.cast("string"), F.lit(".M"))

    def record(df: DataFrame, node: Column, parent: Column, name: Column, children: Column) -> DataFrame:
        return _record(df, TOTAL_SCHEMA, category_id=node, parent_category_id=parent, name=name, childseries=children)

    own, above = F.concat(F.lit("C"), k.cast("string")), F.concat(F.lit("C"), F.expr("c_custkey div 10").cast("string"))
    none = F.array().cast("array<string>")
    root = record(spark.range(1).toDF("id"), F.lit("0"), F.lit(None), F.lit("All customers"), none)
    customers = record(customer, own, F.when(k < 10, "0").otherwise(above), F.col("c_name"), F.array(series_id))
    second = record(customer.filter(k % 50 == 0), own, segment, F.col("c_name"), F.array(series_id))
    listed = customer.groupBy("c_mktsegment").agg(F.collect_list(F.when(k % 7 == 0, series_id)).alias("children"))
    segments = record(listed, segment, F.lit("0"), F.col("c_mktsegment"), F.col("children"))
    region = F.concat(F.lit("R"), F.col("r_regionkey").cast("string"))
    ring = record(table(spark, sf_dir, "region"), region, F.concat(F.lit("R"), ((F.col("r_regionkey") + 1) % 5).cast("string")), F.col("r_name"), none)
    nations = record(table(spark, sf_dir, "nation"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")),
                     F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), F.col("n_name"),
                     F.array(F.concat(F.lit("CUS."), F.col("n_nationkey").cast("string"), F.lit(".M"))))
    return root.unionByName(customers).unionByName(second).unionByName(segments).unionByName(ring).unionByName(nations)


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value of each customer, in cents."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", month_of("o_orderdate").alias("date"), hundredths("o_totalprice").alias("cents"))
    return orders.groupBy(F.concat(F.lit("CUS."), F.col("o_custkey").cast("string"), F.lit(".M")).alias("series_id"), "date").agg(F.sum("cents").alias("value"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's series with a name and a unit."""
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(
        part_id("p_partkey").alias("series_id"),
        F.concat(F.lit("Revenue : "), "p_name", F.lit(" ("), key, F.lit(") : "), "p_type", F.lit(" : all : monthly")).alias("name"),
        F.when(F.col("p_partkey") % 3 == 0, "pieces").otherwise("dollars").alias("units"))


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four rules for each part, and three that no literal can index."""
    key = F.col("p_partkey").cast("string")
    patterns = [
        ("exact", F.concat(F.lit(r"\("), key, F.lit(r"\) : "), "p_type"), "dollars"),
        ("named", F.concat(F.lit("(?=revenue).*"), F.upper("p_name"), F.lit(r" \("), key, F.lit(r"\)")), "DOLLARS|pieces"),
        ("labels", F.concat(F.lit(r"^labels .*\("), key, F.lit(r"\)")), "."),
        ("tenfold", F.concat(F.lit(r" \("), key, F.lit(r"[0-9]?\) : [a-z]+ : all : MONTHLY$")), "^pieces$")]
    rules = F.inline(F.array(*[F.struct((F.col("p_partkey") * 4 + i).alias("rule_id"), F.lit(t).alias("title"), n.alias("name_pattern"), F.lit(u).alias("unit_pattern"))
                               for i, (t, n, u) in enumerate(patterns)]))
    rest = [(-1, "any", "^r|^l", "^d"), (-2, "none", "[0-9]$", "."), (-3, "first", r"\(0\)|\(1\)", "s$")]
    return table(spark, sf_dir, "part").select(rules).unionByName(
        spark.createDataFrame(rest, "rule_id long, title string, name_pattern string, unit_pattern string"))
