"""Stored tables changed by key."""

import os

import pytest
from helpers import events, lockout, rows
from pyspark.sql import functions as F

from nightdesk.sources import catalog
from nightdesk.sources.events import catalog_summary, stored_events, write_events
from nightdesk.sources.keyed import KeyedTable


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/users", "id string, name string", ["id"], buckets=4)


def made(spark, *pairs):
    return spark.createDataFrame([(*p, "x") for p in pairs], "id string, name string, extra string")


def held(table, version=None):
    return sorted(rows(table.read(version)), key=str)


def test_upsert_delete_and_repeat(spark, table):
    assert held(table) == [] and table.versions() == []
    assert table.upsert(made(spark, ("a", "1"), ("b", "2"), ("b", "3"), (None, "n"))) == 1
    assert held(table) == sorted([("a", "1"), ("b", "2"), (None, "n")], key=str)
    assert table.upsert(made(spark, ("a", "9"), ("c", "4")), overwrite=False) == 2
    assert held(table) == sorted([("a", "1"), ("b", "2"), ("c", "4"), (None, "n")], key=str)
    # The same again changes nothing and writes no version.
    assert table.upsert(made(spark, ("a", "9"), ("c", "4")), overwrite=False) == 2
    assert table.upsert(made(spark, ("a", "9")), overwrite=True) == 3
    assert table.upsert(made(spark, ("a", "9")), overwrite=True) == 3
    assert table.delete(F.col("name").isin("2", "4")) == 4
    assert table.delete(F.col("name").isin("2", "4")) == 4
    assert held(table) == sorted([("a", "9"), (None, "n")], key=str)
    assert held(table, 1) == sorted([("a", "1"), ("b", "2"), (None, "n")], key=str)  # older versions stay readable


def test_only_touched_buckets_are_rewritten(spark, table):
    table.upsert(made(spark, *[(f"k{i}", "old") for i in range(60)]))
    before = table._record(1)
    table.upsert(made(spark, ("k7", "new")))
    after = table._record(2)
    assert len(before) == 4 and sum(before[b] != after[b] for b in before) == 1
    assert held(table) == sorted([(f"k{i}", "new" if i == 7 else "old") for i in range(60)])


def test_a_run_that_dies_leaves_the_old_state(spark, table, monkeypatch):
    table.upsert(made(spark, ("a", "1"), ("b", "2")))

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(KeyedTable, "_commit", dies)
    with pytest.raises(RuntimeError, match="lost"):
        table.upsert(made(spark, ("a", "9")))
    monkeypatch.undo()
    assert table.versions() == [1] and held(table) == [("a", "1"), ("b", "2")]
    assert table.upsert(made(spark, ("a", "9"))) == 2 and held(table) == [("a", "9"), ("b", "2")]


def test_a_version_is_never_replaced(spark, table):
    table.upsert(made(spark, ("a", "1")))
    with pytest.raises(RuntimeError, match="someone else"):
        table._commit(1, {})
    assert held(table) == [("a", "1")]


def test_key_of_two_columns_and_all_rows_deleted(spark, tmp_path):
    pairs = KeyedTable(spark, str(tmp_path / "pairs"), "sam string, `group` string", ["sam", "group"], buckets=2)
    rows_ = spark.createDataFrame([("a", "g"), ("a", "h"), ("b", "g")], "sam string, `group` string")
    pairs.upsert(rows_)
    assert pairs.delete(F.col("sam") == "a") == 2 and rows(pairs.read()) == [("b", "g")]
    assert pairs.delete(F.lit(True)) == 3 and pairs.read().count() == 0
    assert os.path.isdir(tmp_path / "pairs" / "_versions")


def test_catalogue_from_statistics(spark, tmp_path, monkeypatch):
    """Up-to-date statistics answer alone; a partition that has grown is read anew, and only that."""
    path = f"file://{tmp_path}/store"
    write_events(events(spark, [lockout(f"2024-03-0{d} 10:00:0{k}") for d in (1, 2, 3) for k in range(d)]), path)
    want = lambda: rows(catalog_summary(stored_events(spark, path)))
    assert rows(catalog.catalog_from_stats(spark, path)) == want()
    catalog.refresh_stats(spark, path)
    read = []
    monkeypatch.setattr(catalog, "stored_events", lambda s, p: read.append(p) or stored_events(s, p))
    assert rows(catalog.catalog_from_stats(spark, path)) == want() and read == []
    write_events(events(spark, [lockout("2024-03-02 23:00:00")]), path)
    assert rows(catalog.catalog_from_stats(spark, path)) == want() and len(read) == 1
    catalog.refresh_stats(spark, path)
    assert rows(catalog.catalog_from_stats(spark, path)) == want() and len(read) == 2
    held = {r["event_date"]: r["total"] for r in catalog.stats_table(spark, path).read().collect()}
    assert held == {"2024-03-01": 1, "2024-03-02": 3, "2024-03-03": 3}
