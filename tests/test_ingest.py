import datetime
import json

import pytest

from helpers import rows
from seriesforge.functions.clean import null_sentinels, period_to_date, to_int
from seriesforge.operators.dims import (
    ELECTRICITY_FAMILIES, all_dimensions, base_dimension, family_dimension, missed_dimension, total_dimension, with_family,
)
from seriesforge.operators.facts import explode_history
from seriesforge.sources.bulk import ELECTRICITY_SCHEMA, TOTAL_SCHEMA, keep_frequency, read_bulk

PLANT = {
    "series_id": "ELEC.PLANT.GEN.123-ALL-ALL.M", "f": "M", "units": "megawatthours", "start": "200101", "end": "200103",
    "name": "Net generation : Foo (123) : all fuels : all primemovers : monthly", "lat": "41.2", "lon": "-80.1",
    "last_updated": "2020-09-25T12:00:00-04:00", "data": [["200103", 12.5], ["200102", None], ["200101", "null"]],
}
RECORDS = [
    PLANT,
    {"category_id": "1", "childseries": ["a"]},
    {"series_id": "ELEC.GEN.A.A", "f": "A", "data": [["2001", 1]]},
    {"series_id": "ELEC.GEN.A.Q", "f": "Q", "data": [["2001Q1", 1]]},
    {"series_id": "ELEC.GEN.E.M", "f": "M", "name": "a : b", "data": []},
    {"series_id": "ELEC.CONS_TOT.N.M", "f": "M", "name": "a :  : c", "start": "2001Q1", "last_updated": "bad"},
    {"series_id": "ELEC.CONS_TOT_BTU.N.M", "f": "M", "name": "a : null : c : d : e", "data": [["200101"], ["20011", "3"], ["200102", ""]]},
    {"series_id": "ELEC.PLANT.GEN.X.M", "f": "M", "name": "v : p", "description": "", "iso3166": "null", "data": [["200101", "7"]]},
    {"series_id": "ELEC.OTHER.1.M", "f": "M", "name": "o", "data": [["200101", "x"]]},
    {"f": "M", "name": "no id", "data": [["200101", "1"]]},
]


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bulk") / "bulk.json"
    path.write_text("\n".join([json.dumps(r) for r in RECORDS] + ["{bad json"]))
    return read_bulk(spark, str(path), ELECTRICITY_SCHEMA)


def test_scan_keeps_numbers_as_text_and_drops_what_is_not_monthly(raw):
    assert raw.count() == len(RECORDS) + 1
    kept = keep_frequency(raw)
    assert kept.count() == 6
    assert kept.filter("series_id = 'ELEC.PLANT.GEN.123-ALL-ALL.M'").first()["data"] == [
        ["200103", "12.5"], ["200102", None], ["200101", "null"]]
    assert keep_frequency(raw, "A").count() == 1


def test_explode_history(raw):
    d = datetime.date
    facts = explode_history(keep_frequency(raw))
    assert facts.dtypes == [("series_id", "string"), ("date", "date"), ("value", "string")]
    assert rows(facts) == sorted([
        ("ELEC.PLANT.GEN.123-ALL-ALL.M", d(2001, 3, 1), "12.5"), ("ELEC.PLANT.GEN.123-ALL-ALL.M", d(2001, 2, 1), None),
        ("ELEC.PLANT.GEN.123-ALL-ALL.M", d(2001, 1, 1), None), ("ELEC.CONS_TOT_BTU.N.M", d(2001, 1, 1), None),
        ("ELEC.CONS_TOT_BTU.N.M", None, "3"), ("ELEC.CONS_TOT_BTU.N.M", d(2001, 2, 1), None),
        ("ELEC.PLANT.GEN.X.M", d(2001, 1, 1), "7"), ("ELEC.OTHER.1.M", d(2001, 1, 1), "x"),
    ], key=repr)
    empty = {r[0] for r in rows(explode_history(keep_frequency(raw), keep_empty=True))} - {r[0] for r in rows(facts)}
    assert empty == {"ELEC.GEN.E.M", "ELEC.CONS_TOT.N.M"}


def test_families_are_a_partition(raw):
    kept = keep_frequency(raw)
    families = dict(rows(with_family(kept), "series_id", "family"))
    assert families == {
        "ELEC.PLANT.GEN.123-ALL-ALL.M": "plant_level", "ELEC.PLANT.GEN.X.M": "plant_level", "ELEC.GEN.E.M": "power",
        "ELEC.CONS_TOT.N.M": "power", "ELEC.CONS_TOT_BTU.N.M": "power", "ELEC.OTHER.1.M": "missed"}
    split = [family_dimension(kept, f).count() for f in ELECTRICITY_FAMILIES] + [missed_dimension(kept).count()]
    assert sum(split) == kept.count() and split == [3, 2, 0, 0, 0, 1]


def test_dimension_columns_and_types(raw):
    kept = keep_frequency(raw)
    plants = family_dimension(kept, ELECTRICITY_FAMILIES[1])
    assert plants.columns == [
        "copyright", "description", "end", "f", "geography", "iso3166", "lat", "lon", "name", "source", "start", "units",
        "last_updated", "series_id", "value_type", "plant_name", "fuel_type", "engine_type", "frequency", "plant_id"]
    types = dict(plants.dtypes)
    assert (types["start"], types["lat"], types["lon"], types["last_updated"]) == ("int", "double", "double", "timestamp")
    first, other = sorted(plants.collect(), key=lambda r: r["series_id"])
    assert (first["lat"], first["lon"], first["start"], first["plant_id"], first["plant_name"]) == (41.2, -80.1, 200101, "123", "Foo (123)")
    assert first["last_updated"] == datetime.datetime(2020, 9, 25, 16)
    assert (other["plant_id"], other["description"], other["iso3166"], other["fuel_type"]) == (None, None, None, None)
    power = {r["series_id"]: r for r in family_dimension(kept, ELECTRICITY_FAMILIES[0]).collect()}
    assert (power["ELEC.GEN.E.M"]["fuel_type"], power["ELEC.GEN.E.M"]["region"]) == ("b", None)
    assert (power["ELEC.CONS_TOT.N.M"]["fuel_type"], power["ELEC.CONS_TOT.N.M"]["start"], power["ELEC.CONS_TOT.N.M"]["last_updated"]) == (None, None, None)
    assert power["ELEC.CONS_TOT_BTU.N.M"]["fuel_type"] is None


def test_all_dimensions_equals_the_single_ones(raw):
    kept = keep_frequency(raw)
    together = all_dimensions(kept)
    for family in ELECTRICITY_FAMILIES:
        columns = ["series_id", "start", *family.attributes]
        assert rows(together.filter(f"family = '{family.name}'"), *columns) == rows(family_dimension(kept, family), *columns)
    assert rows(together.filter("family = 'missed'"), "series_id") == rows(missed_dimension(kept), "series_id")


def test_dimension_scan_does_not_read_the_history(raw):
    from seriesforge.sources.sinks import explain_text

    plan = explain_text(base_dimension(keep_frequency(raw)), "simple")
    assert "array<array" not in plan and "PushedFilters" in plan


def test_total_layout(spark, tmp_path):
    lines = [
        {"series_id": "T1", "f": "M", "name": "n", "start": "200001", "notes": "", "childseries": ["a", "b"], "data": [["200001", 1]]},
        {"category_id": "9", "childseries": ["x"]},
    ]
    path = tmp_path / "total.json"
    path.write_text("\n".join(map(json.dumps, lines)))
    dim = total_dimension(keep_frequency(read_bulk(spark, str(path), TOTAL_SCHEMA)))
    assert dim.columns == ["category_id", "f", "name", "notes", "parent_category_id", "units", "end", "start", "last_updated", "series_id", "childseries"]
    row = dim.collect()
    assert len(row) == 1 and row[0]["childseries"] == ["a", "b"] and row[0]["start"] == "200001" and row[0]["notes"] is None


def test_sentinels_and_malformed_text(spark):
    df = spark.createDataFrame([("", 1, ["null"]), ("null", 2, [""]), ("nullable", 3, None)], "t string, n int, a array<string>")
    assert rows(null_sentinels(df), "t", "n") == sorted([(None, 1), (None, 2), ("nullable", 3)], key=repr)
    assert rows(null_sentinels(df), "n", "a")[0] == (1, ["null"])
    bad = spark.createDataFrame([("200113",), ("x",), (None,), ("200112",)], "p string")
    assert rows(bad.select(period_to_date("p"), to_int("p"))) == sorted(
        [(None, 200113), (None, None), (None, None), (datetime.date(2001, 12, 1), 200112)], key=repr)
