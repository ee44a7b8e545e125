"""Checked intake: what is put aside, what is counted, and that it costs one scan."""

import json

from seriesforge.sources import intake
from seriesforge.sources.bulk import ELECTRICITY_SCHEMA


def record(series_id, data, last_updated="2020-01-02T03:04:05-05:00", **more):
    return json.dumps({"series_id": series_id, "f": "M", "data": data, "last_updated": last_updated, **more})


LINES = [
    record("A", [["202001", "1.5"], ["202002", None], ["2020xx", "2"], ["202003", "n.a."], ["202004", ""], ["202005", "null"]]),
    record("B", [], last_updated="yesterday"), record("C", None, last_updated=None), record("D", [["202001"], []], last_updated="null"),
    record(None, [["202001", "x"]]), json.dumps({"category_id": "1"}), "{\"series_id\": \"E\", \"data\": [[", "no json", json.dumps([1, 2]),
]


def test_counters_and_quarantine(spark, tmp_path):
    (tmp_path / "bulk.json").write_text("\n".join(LINES))
    target = str(tmp_path / "target")
    got = intake.take_in(spark, str(tmp_path / "bulk.json"), ELECTRICITY_SCHEMA, target)
    assert {k: got[k] for k in ("n_lines", "n_without_id", "n_bad_stamps", "n_pairs", "n_bad_dates", "n_bad_numbers")} == {
        "n_lines": 9, "n_without_id": 1, "n_bad_stamps": 1, "n_pairs": 8, "n_bad_dates": 2, "n_bad_numbers": 1}
    assert got["n_broken"] == 3 and got["n_records"] == 5
    kept = intake.records(spark, target, ELECTRICITY_SCHEMA)
    assert kept.columns == ELECTRICITY_SCHEMA.fieldNames()
    assert sorted(r.series_id or "" for r in kept.collect()) == ["", "A", "B", "C", "D"]
    aside = [(r.reason, r.line) for r in intake.quarantine(spark, target, ELECTRICITY_SCHEMA).collect()]
    assert sorted(line for reason, line in aside if reason == "not a record") == sorted(LINES[6:])
    [line] = [line for reason, line in aside if reason == "no id"]
    assert json.loads(line)["data"] == [["202001", "x"]]


def test_empty_file(spark, tmp_path):
    (tmp_path / "none.json").write_text("")
    got = intake.take_in(spark, str(tmp_path / "none.json"), ELECTRICITY_SCHEMA, str(tmp_path / "target"))
    assert set(got.values()) == {0}
