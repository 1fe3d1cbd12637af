"""Streams into tables: late and repeated batches, repair, and prices that come too late."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.sources.store import Store, scratch
from barloom.streaming import live as lv
from barloom.streaming import snapshots as st

PANEL = "code int, rank int, day int, quoted boolean, price double, hits array<string>, version int, refreshes int"


def quotes(spark, *rows):
    return spark.createDataFrame(list(rows), "code int, day int, close double, version int")


def test_live_panel(spark):
    history = spark.createDataFrame([(c, day, 10.0 + day, 5) for c in (1, 2, 3) for day in (1, 2, 3)], "code int, day int, close double, rank int")
    people = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "code int, rank int")
    table = Store(spark, scratch(spark, "live"), "quoted").create(spark.createDataFrame([], PANEL))
    templates = {"up": F.col("close") > 12.5, "ranked": F.col("rank") < 100, "day": F.col("day") == 3}

    def feed(*rows):
        lv.live_panel(quotes(spark, *rows), history, people, table, "code", "day", "version", 3, templates, {"price": F.col("close")})
        return sorted((r.code, r.rank, r.quoted, r.price, r.hits, r.version, r.refreshes) for r in table.read().collect())

    first = feed((1, 3, 13.5, 2), (2, 4, 11.0, 2), (2, 4, 10.0, 2), (3, 4, 99.0, 1))
    assert first == [(1, 7, True, 13.5, ["up", "day"], 2, 1), (2, None, True, 11.0, [], 2, 1), (3, 9, False, None, [], 2, 1)]
    assert feed((1, 3, 1.0, 2)) == feed((1, 3, 1.0, 1)) == feed((1, 3, 1.0, None)) == feed() == first
    assert feed((3, 4, 50.0, 3), (9, 4, 1.0, 3)) == [(1, 7, False, None, [], 3, 2), (2, None, False, None, [], 3, 2), (3, 9, True, 50.0, ["up"], 3, 2)]


def test_ingest(spark):
    """Appends, repair, an entity whose load fails at first, a load that fails as a whole, batches that run again."""
    kind = "code int, day int, close double, pre_close double"
    df = lambda *rows: spark.createDataFrame(list(rows), kind)
    table = Store(spark, scratch(spark, "d"), "code").create(df((1, 1, 10.0, None), (2, 1, 20.0, None), (3, 1, 30.0, None)))
    failed = Store(spark, scratch(spark, "f"), "code").create(spark.createDataFrame([], "code int, error string"))
    source = {2: [(2, 1, 10.0, None), (2, 2, 11.0, 10.0)], 3: [(3, 1, 15.0, None), (3, 2, 16.0, 15.0), (3, 3, 17.0, 16.0)]}
    broken = {3}

    def load(keys):
        wanted = [r.code for r in keys.collect()]
        rows = [(*r, "gone" if c in broken else None) for c in wanted for r in source.get(c, [])]
        return spark.createDataFrame(rows, kind + ", error string")

    def feed(*rows, load=load):
        lv.ingest_daily(df(*rows), table, failed, load, "code", "day")
        return sorted(map(tuple, table.read().select("code", "day", "close").collect())), sorted(map(tuple, failed.read().collect()))

    day2 = [(1, 2, 11.0, 10.0), (2, 2, 11.0, 10.0), (3, 2, 16.0, 15.0), (4, 2, 5.0, 4.0), (None, 2, 1.0, 1.0), (1, None, 1.0, 1.0)]
    after = ([(1, 1, 10.0), (1, 2, 11.0), (2, 1, 10.0), (2, 2, 11.0), (4, 2, 5.0)], [(3, "gone")])
    assert feed(*day2) == after
    assert feed(*day2) == after  # again: nothing doubled, the failed load is tried once more
    broken.clear()
    assert feed((3, 3, 17.0, 16.0), (1, 3, 11.5, 11.0005)) == (sorted([*after[0], (1, 3, 11.5), (3, 1, 15.0), (3, 2, 16.0), (3, 3, 17.0)]), [])

    def down(keys):
        raise OSError("source is down")

    rows, lost = feed((1, 4, 12.0, 11.5), (4, 3, 6.0, None), load=down)
    assert (1, 4, 12.0) in rows and not [r for r in rows if r[0] == 4] and lost == [(4, "OSError")]


def ticks(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, t long, i long, p double")


def test_speeds(spark):
    rows = [("a", 0, 1, 10.0), ("a", 5, 2, 8.0), ("a", 5, 3, None), ("a", 12, 4, 12.0), ("a", 12, 5, 9.0), ("a", 40, 6, 9.9), ("a", 200, 7, 5.0), ("b", 1, 8, -1.0), ("b", 2, 9, 3.0), (None, 1, 10, 1.0)]
    batch = {r.i: (r.speed_10, r.speed_30, r.speed_60) for r in lv.speeds_batch(ticks(spark, *rows), "k", "t", "i", "p").collect()}
    near = lambda v: None if v is None else round(v, 6)
    got = {i: tuple(map(near, v)) for i, v in batch.items()}
    assert got == {1: (0, 0, 0), 2: (0, 0, 0), 3: (None,) * 3, 4: (50.0,) * 3, 5: (12.5,) * 3, 6: (10.0, 23.75, 23.75), 7: (0, 0, 0), 8: (None,) * 3, 9: (0, 0, 0)}


def test_speeds_stream_late(spark):
    stream = lv.file_stream(spark, [ticks(spark, ("a", 10, 1, 10.0), ("a", 20, 2, 20.0)), ticks(spark, ("a", 15, 3, 1.0)), ticks(spark, ("a", 25, 4, 15.0), ("b", 1, 5, 2.0))], scratch(spark, "t"))
    out = st.run_once(spark, lv.speeds_stream(stream, "k", "t", "i", "p"), "append", scratch(spark, "s"))
    got = {r.i: (r.speed_10, r.speed_30) for r in out.collect()}
    assert got == {1: (0.0, 0.0), 2: (100.0, 100.0), 3: (None, None), 4: (50.0, 50.0), 5: (0.0, 0.0)}


def test_late_total(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, o int, total double")
    stream = lv.file_stream(spark, [make((1, 1, 5.0), (1, 3, 9.0)), make((1, 2, 7.0), (2, 1, 1.0)), make((1, 4, 12.0), (1, 5, 2.0))], scratch(spark, "t"))
    out = st.run_once(spark, st.deltas(stream, "k", "o", "total"), "append", scratch(spark, "s"))
    assert sorted((r.k, r.o, r.delta, r.fell) for r in out.collect()) == [(1, 1, 5.0, False), (1, 2, None, None), (1, 3, 4.0, False), (1, 4, 3.0, False), (1, 5, 2.0, True), (2, 1, 1.0, False)]
