"""Incremental backups: what is copied, kept, linked and dropped, and what comes back."""

import os
import shutil

import pytest

from seriesforge.sources import vault


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "it's a table"
    (root / "year=1").mkdir(parents=True)
    (root / "year=2").mkdir()
    for name, text in {"year=1/a.bin": "one", "year=1/b.bin": "two", "year=2/c.bin": "one", "_SUCCESS": "", "year=2/.c.crc": "x"}.items():
        (root / name).write_text(text)
    return root


def actions(spark, store, run=None):
    return {r.path: r.action for r in vault.manifest(spark, store, run).collect()}


def held(spark, store, run=None):
    return {r.path: bytes(r.content).decode() for r in vault.files(spark, store, run).collect()}


def test_runs(spark, source, tmp_path):
    store = str(tmp_path / "vault")
    first = vault.back_up(spark, str(source), store)
    assert sorted(actions(spark, store).values()) == ["copied", "copied", "linked"]  # one content stands in two files
    everything = {"year=1/a.bin": "one", "year=1/b.bin": "two", "year=2/c.bin": "one"}
    assert held(spark, store) == everything
    os.utime(source / "year=1/a.bin", (1, 1))  # touched, but the same
    (source / "year=1/b.bin").write_text("new")  # as long as before
    os.utime(source / "year=1/b.bin", (2, 2))
    (source / "year=2/c.bin").rename(source / "year=2/moved.bin")
    (source / "year=2/d.bin").write_text("four")
    second = vault.back_up(spark, str(source), store)
    assert actions(spark, store) == {"year=1/a.bin": "kept", "year=1/b.bin": "copied", "year=2/c.bin": "dropped", "year=2/moved.bin": "linked", "year=2/d.bin": "copied"}
    assert held(spark, store) == {"year=1/a.bin": "one", "year=1/b.bin": "new", "year=2/moved.bin": "one", "year=2/d.bin": "four"}
    assert held(spark, store, first) == everything  # earlier runs stay whole
    vault.back_up(spark, str(source), store)
    assert set(actions(spark, store).values()) == {"kept"} and len(actions(spark, store)) == 4
    numbers = {(r.number, r.action): r.n_files for r in vault.summary(spark, store).collect()}
    assert numbers == {(1, "copied"): 2, (1, "linked"): 1, (2, "kept"): 1, (2, "copied"): 2, (2, "linked"): 1, (2, "dropped"): 1, (3, "kept"): 4}
    small = str(tmp_path / "small")
    vault.compacted(spark, store, small, second)
    assert held(spark, small) == held(spark, store, second)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{small}/contents").count() == 3


def test_a_lost_run_does_not_count(spark, source, tmp_path):
    store = str(tmp_path / "vault")
    vault.back_up(spark, str(source), store)
    (source / "year=1/e.bin").write_text("late")
    lost = vault.back_up(spark, str(source), store)
    shutil.rmtree(f"{store}/commits")  # as if neither run had ended
    assert vault.manifest(spark, store).count() == 0
    vault.back_up(spark, str(source), store)
    assert sorted(actions(spark, store).values()) == ["copied", "copied", "copied", "linked"] and lost not in [r.run for r in vault.runs(spark, store).collect()]


def test_nothing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    store = str(tmp_path / "vault")
    vault.back_up(spark, str(tmp_path / "empty"), store)
    assert vault.manifest(spark, store).count() == 0 and vault.files(spark, store).count() == 0


def test_long_files_are_stored_in_pieces(spark, source, tmp_path):
    """What a row holds, and so a task's Python, doesn't grow with the files."""
    long = os.urandom(2 * vault.BLOCK + 3 * vault.PIECE + 5)
    (source / "year=1/long.bin").write_bytes(long)
    store, small = str(tmp_path / "vault"), str(tmp_path / "small")
    vault.back_up(spark, str(source), store)
    vault.compacted(spark, store, small)
    for folder in (store, small):
        stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/contents")
        assert stored.selectExpr("max(length(content))").first()[0] == vault.PIECE
        got = {r.path: bytes(r.content) for r in vault.files(spark, folder).collect()}
        assert got["year=1/long.bin"] == long and got["year=1/a.bin"] == b"one"


def test_rows_come_back_from_files_of_many_pieces(spark, tmp_path):
    table, store = str(tmp_path / "table"), str(tmp_path / "vault")
    df = spark.range(0, 300_000, numPartitions=3).selectExpr("id", "sha2(string(id), 256) AS text")
    df.write.parquet(table)
    vault.back_up(spark, table, store)
    assert vault.pieces(spark, store).count() > 1000
    assert vault.restored(spark, store, "text string, id long").select("id", "text").exceptAll(df).isEmpty()
    assert vault.restored(spark, store, "id long").count() == 300_000
