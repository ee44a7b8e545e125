import json
import os

import pytest
from pyspark.sql import functions as F

from helpers import rows
from seriesforge.operators.evaluate import compare
from seriesforge.plans.etl import ELECTRICITY_TABLES, TOTAL_TABLES, run_electricity, run_total
from seriesforge.sources.sinks import (
    Output, append_pending, backup_table, explain_to_file, log_sample, write_outputs, write_table,
)
from seriesforge.sources.tables import list_files, read_table, register, scratch_path

IDS = ["ELEC.GEN.1.M", "ELEC.PLANT.GEN.7-ALL.M", "ELEC.SALES.1.M", "ELEC.STOCKS.1.M", "ELEC.ASH_CONTENT.1.M", "ELEC.NEW.1.M"]


@pytest.fixture(scope="module")
def bulk(tmp_path_factory):
    path = tmp_path_factory.mktemp("bulk") / "e.json"
    lines = [{"series_id": i, "f": "M", "name": "a : b : c : d : e : f", "data": [["200102", n], ["200101", None]]} for n, i in enumerate(IDS)]
    path.write_text("\n".join(map(json.dumps, lines + [{"series_id": "ELEC.GEN.2.A", "f": "A", "data": [["2001", 1]]}])))
    return str(path)


def test_electricity_job(spark, bulk, tmp_path):
    root, plans, backup = (str(tmp_path / n) for n in ("out", "plans", "backup"))
    os.mkdir(plans)
    for _ in range(2):  # a second run replaces the first
        written = run_electricity(spark, bulk, root, plan_dir=plans, show_samples=True, backup_root=backup)
    assert [os.path.basename(p) for p in written] == list(ELECTRICITY_TABLES.values())
    counts = {name: spark.read.parquet(f"{root}/{table}").count() for name, table in ELECTRICITY_TABLES.items()}
    assert counts == {"facts": 12, "power": 1, "plant_level": 1, "retail": 1, "fossil_fuel": 1, "fossil_fuel_quality": 1, "missed": 1}
    for table in ELECTRICITY_TABLES.values():
        assert rows(spark.read.parquet(f"{root}/{table}")) == rows(spark.read.parquet(f"{backup}/{table}"))
    assert spark.read.parquet(f"{root}/ElectricityPlantLevelDimDF").first()["plant_id"] == "7"
    dumps = sorted(os.listdir(plans))
    assert len(dumps) == 7
    text = open(f"{plans}/plan_electricity_power_dimensions.general.txt").read()
    physical = text[text.index("== Physical Plan =="):]
    # Outputs read the staged table, each only its family, and never parse the text again.
    assert "FileScan json" not in text and "family=power" in physical.replace("family#", "family=") or "PartitionFilters: [isnotnull(family" in physical
    assert "Exchange" not in physical and "data:array" not in physical


def test_total_job(spark, tmp_path):
    source = tmp_path / "t.json"
    source.write_text(json.dumps({"series_id": "T", "f": "M", "name": "n", "data": [["200001", 2]], "childseries": ["x"]}))
    run_total(spark, str(source), str(tmp_path / "out"))
    dim = spark.read.parquet(str(tmp_path / "out" / TOTAL_TABLES["dimensions"])).first()
    fact = spark.read.parquet(str(tmp_path / "out" / TOTAL_TABLES["facts"])).first()
    assert dim["childseries"] == ["x"] and fact["value"] == "2"


def test_output_needs_exactly_its_keys(spark, tmp_path):
    df = spark.range(2)
    for spec in ({"df": df, "path": "p"}, {"df": df, "description": "d", "path": "p", "more": 1}):
        with pytest.raises(ValueError):
            Output.from_dict(spec)
    path = str(tmp_path / "t")
    assert write_outputs([{"df": df, "description": "two rows", "path": path}]) == [path]
    assert spark.read.parquet(path).count() == 2


def test_sample_and_views(spark, tmp_path):
    df = spark.range(100)
    assert len(log_sample(df, "ids")) == 10
    write_table(df.withColumn("x", F.lit(1)), str(tmp_path / "v"))
    table = read_table(spark, str(tmp_path / "v"), "id", view="ids", cache=True)
    assert table.columns == ["id"] and spark.sql("select count(*) c from ids").first()["c"] == 100 and spark.catalog.isCached("ids")
    spark.catalog.uncacheTable("ids")
    register(df.limit(1), "ids")
    assert spark.table("ids").count() == 1
    assert "Physical Plan" in open(explain_to_file(df, str(tmp_path), "ids")).read()


def test_backup_replaces_and_files_are_listed(spark, tmp_path):
    table, copy = str(tmp_path / "t"), str(tmp_path / "c")
    write_table(spark.range(10).withColumn("g", F.col("id") % 2), table, ["g"])
    backup_table(spark, table, copy)
    write_table(spark.range(3).withColumn("g", F.col("id") % 2), table, ["g"])
    backup_table(spark, table, copy)
    result = compare(spark.read.parquet(table), spark.read.parquet(copy), ["id"], "g", 0).first()
    assert result["n_rows"] == 3 and result["n_left_only"] == result["n_right_only"] == result["n_different"] == 0
    files = list_files(spark, table, r"g=1/.*\.parquet$")
    assert files.columns == ["path", "length", "modificationTime"] and files.count() >= 1
    assert files.count() < list_files(spark, table).count()
    assert list_files(spark, table, "nothing").count() == 0


def test_append_pending_runs_only_what_is_missing_and_ignores_lost_jobs(spark):
    path, seen = scratch_path(spark, "metrics"), []

    def evaluate(work):
        seen.append(sorted(r["k"] for r in work.collect()))
        return work.withColumn("score", F.col("k") * 10)

    append_pending(spark.range(3).withColumnRenamed("id", "k"), ["k"], path, evaluate)
    lost = spark.range(3, 60).withColumnRenamed("id", "k").withColumn("score", F.lit(0).cast("long"))
    lost.withColumn("run_time", F.current_timestamp()).write.parquet(f"{path}/results/batch=lost")  # its commit was never written
    done = append_pending(spark.range(5).withColumnRenamed("id", "k"), ["k"], path, evaluate)
    assert seen == [[0, 1, 2], [3, 4]] and rows(done, "k", "score") == [(k, 10 * k) for k in range(5)]
    again = append_pending(spark.range(4).withColumnRenamed("id", "k"), ["k"], path, evaluate)
    assert len(seen) == 2 and rows(again, "k", "score") == rows(done, "k", "score")
    assert done.filter("run_time IS NULL").count() == 0
    assert len([f for f in os.listdir(f"{path}/results") if f.startswith("batch=")]) == 3  # two and the lost one


def test_append_pending_without_work(spark):
    path = scratch_path(spark, "none")
    none = spark.range(0).withColumnRenamed("id", "k")
    assert append_pending(none, ["k"], path, lambda w: w.withColumn("score", F.lit(1))).count() == 0


def test_scratch_follows_the_session(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))
