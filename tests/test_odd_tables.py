"""Queries on small odd tables against their SQL: zeros, ties by rounding, fractions of seconds."""

from __future__ import annotations

import datetime as dt
import itertools
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.functions import semantics as m
from barloom.operators import scoring as sc
from barloom.operators import validation as va
from barloom.queries import ORACLE, QUERIES
from tests.test_oracles import plain

START = dt.datetime(2024, 1, 1)


def same_as_sql(spark, folder, name, events):
    """The query's rows on events (event_id, ts, user_id, value) and the SQL's."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, 'view', ?, '')", events)
    con.execute(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    got, want = plain(QUERIES[name](spark, str(folder)).toArrow()), plain(con.execute(ORACLE[name]).to_arrow_table())
    assert got == want
    return got[1]


def test_kernels_over_scores_of_0(spark, tmp_path):
    rows = [(1 + u * 40 + d, START + dt.timedelta(days=d), u, 0.0 if (u, d) in ((2, 5), (3, 7), (3, 8)) else 10.0 + (u * 7 + d * d) % 11) for u in range(7) for d in range(20)]
    out = same_as_sql(spark, tmp_path, "b25_all_kernels", rows)
    assert any("inf" in r or "nan" in r for r in out)


def test_minutes_of_price_0(spark, tmp_path):
    at = lambda k: START + dt.timedelta(minutes=k)
    rows = [(i, at(i), u, v) for i, (u, v) in enumerate([(6, 0.0), (6, 3.5), (7, 0.0), (9, 2.0), (9, 0.0), (13, 0.0), (13, 4.0)], 1)]
    assert len(same_as_sql(spark, tmp_path, "s13_minutes", rows)) == 6


def test_speed_by_nearest_second(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    rows = [(1, at(0.4), 1, 5.0), (2, at(86400.6), 1, 10.0), (3, at(0.6), 2, 5.0), (4, at(86401.4), 2, 10.0), (5, at(0.5), 3, 5.0), (6, at(86400.5), 3, 10.0)]
    assert len(same_as_sql(spark, tmp_path, "m09_speed", rows)) == 6


def test_log_of_value_at_0(spark, values, want):
    days = spark.createDataFrame([*enumerate(values)], "day int, r double")
    got = [r.v for r in days.select("day", m.ieee_log(va.net_value(days, "day", "r")).alias("v")).orderBy("day").collect()]
    if want is None:
        assert got[-1] == -math.inf and math.isfinite(got[0])
    else:
        assert all(a == b or abs(a - b) < 1e-12 or (math.isnan(a) and math.isnan(b)) for a, b in zip(got, want, strict=True))
def test_equal_scores_have_equal_sums(spark):
    """Rows in any order; ranks of equal entities go by the entity."""
    orders = [*itertools.permutations(enumerate((1.1, 0.3, 0.3), 1))]
    rows = [(code, f"2024-01-0{d}", s) for code in range(300) for d, s in orders[code % 6]]
    scores = spark.createDataFrame(rows, "code int, day string, score double").withColumn("day", F.to_date("day")).coalesce(1)
    out = sc.convolution_rank_on(scores, [5.0, 3.0, 2.0], "code", "day", "score", F.lit("2024-01-03").cast("date")).collect()
    assert len({r.smooth for r in out}) == 1
    assert [r.code for r in sorted(out, key=lambda r: r.conv_rank)] == list(range(300))


def test_program_compares_as_its_sql(spark, tmp_path):
    """The mean of the five is 22.44 less the last digit of its double."""
    rows = [(i, START + dt.timedelta(minutes=i), 1, v) for i, v in enumerate([15.32, 50.5, 40.39, 4.99, 1.0, 22.44, 1.0], 1)]
    assert ("6", "True", "1") in same_as_sql(spark, tmp_path, "x09_program", rows)
