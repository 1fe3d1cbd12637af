"""Tables that change as a whole or not at all."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from barloom.sources.store import Store, scratch

COLUMNS = "code long, day int, v double"


@pytest.fixture
def store(spark):
    rows = [(1, 1, 1.0), (1, 2, 2.0), (1, None, 3.0), (2, 1, 4.0), (None, 1, 5.0), (None, 5, 6.0)]
    return Store(spark, scratch(spark, "t"), "code").create(spark.createDataFrame(rows, COLUMNS))


def rows(store):
    return sorted(map(tuple, store.read().collect()), key=str)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def test_upsert_keeps_rows_without_day(spark, store):
    store.upsert_range(table(spark, (1, 2, 20.0), (None, 1, 50.0), (3, 9, 9.0)), "day")
    assert rows(store) == sorted([(1, 1, 1.0), (1, 2, 20.0), (1, None, 3.0), (2, 1, 4.0), (None, 1, 50.0), (None, 5, 6.0), (3, 9, 9.0)], key=str)


def test_replace_range(spark, store):
    store.replace_range(table(spark, (4, 1, 0.5)), "day", 1, 2)
    assert rows(store) == sorted([(1, None, 3.0), (None, 5, 6.0), (4, 1, 0.5)], key=str)
    store.replace_range(table(spark), "day", 1, 9)
    assert rows(store) == [(1, None, 3.0)]


def test_append_and_remove(spark, store):
    store.append(table(spark, (2, 7, 7.0), (None, 7, 8.0)))
    assert store.read().count() == 8
    store.remove(table(spark, (None, 0, 0.0), (2, 0, 0.0)))
    assert rows(store) == sorted([(1, 1, 1.0), (1, 2, 2.0), (1, None, 3.0)], key=str)


@pytest.mark.parametrize("change", ["replace_partitions", "append", "replace_range", "upsert_range"])
def test_failing_writer(spark, store, change):
    """A row fails after others were written: readers see the old table, and no folder is left."""
    bad = spark.range(2000).select((F.col("id") % 3).alias("code"), F.lit(1).alias("day"), F.when(F.col("id") == 1999, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0).alias("v"))
    before, reader = rows(store), store.read()
    args = {"replace_range": ("day", 1, 2), "upsert_range": ("day",)}.get(change, ())
    with pytest.raises(Exception, match="broken"):
        getattr(store, change)(bad, *args)
    assert rows(store) == before and reader.count() == len(before)
    assert store.vacuum() == 0


def test_old_readers_and_second_writer(spark, store):
    reader = store.read()
    text = store._text()
    store.replace_partitions(table(spark, (1, 8, 8.0)))
    assert reader.count() == 6 and store.read().count() == 4
    with pytest.raises(RuntimeError, match="another writer"):
        store._swap(text, table(spark, (2, 0, 0.0)), {"32"})
    assert store.read().count() == 4 and store.vacuum() == 1


def test_staged_update_and_columns(spark, store):
    store.staged_update(table(spark, (2, 1, -1.0)), ["code", "day"], ["v"])
    assert (2, 1, -1.0) in rows(store) and store.read().count() == 6
    assert store.with_columns({"w": F.col("v") * 2}, ("v",)).read().columns == ["code", "day", "w"]


def test_empty_table(spark):
    store = Store(spark, scratch(spark, "t"), "code").create(table(spark))
    assert store.read().count() == 0
    store.append(table(spark, (1, 1, 1.0)))
    store.replace_partitions(table(spark))
    assert rows(store) == [(1, 1, 1.0)]


def test_buckets(spark):
    """Folders don't grow in number with the keys, and changes of some keys leave the others of their bucket."""
    store = Store(spark, scratch(spark, "b"), "code", 2).create(spark.range(500).select(F.col("id").alias("code"), F.lit(1).alias("day"), F.lit(0.5).alias("v")).unionByName(table(spark, (None, 1, 5.0))))
    assert len(json.loads(store._text())["parts"]) == 2
    store.replace_partitions(table(spark, (7, 1, 7.0), (7, 2, 8.0), (None, 3, 6.0)))
    store.upsert_range(table(spark, (7, 2, 9.0), (9, 5, 1.0), (600, 1, 1.0)), "day")
    store.remove(table(spark, (8, 0, 0.0), (600, 0, 0.0)))
    store.append(table(spark, (8, 3, 3.0)))
    want = [(c, 1, 0.5) for c in range(500) if c not in (7, 8)] + [(7, 1, 7.0), (7, 2, 9.0), (9, 5, 1.0), (None, 3, 6.0), (8, 3, 3.0)]
    assert rows(store) == sorted(want, key=str)
    store.remove(table(spark, (None, 0, 0.0)))
    assert rows(store) == sorted([r for r in want if r[0] is not None], key=str)
