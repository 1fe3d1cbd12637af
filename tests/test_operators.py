"""Errors and edges of operators that queries don't show."""

from __future__ import annotations

import random
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barloom.functions.series import Series, smoothed
from barloom.operators import scoring as sc
from barloom.operators import validation as va

S = Series("code", "day")


def test_attach_refuses_a_key_twice(spark):
    left = spark.createDataFrame([(1,), (2,)], "code int")
    once = spark.createDataFrame([(1, "a")], "code int, name string")
    assert sorted((r.code, r.name) for r in va.attach(left, once, ["code"]).collect()) == [(1, "a"), (2, None)]
    with pytest.raises(PySparkException, match="key occurs twice"):
        va.attach(left, once.unionByName(once), ["code"]).collect()


def test_combination_scopes():
    with pytest.raises(ValueError, match="RECENT"):
        sc.combination(S, [(F.lit(True), 0.0)], [0.0, 1.0], "RECENT")


@pytest.mark.parametrize("kernel", [[], [0.0, 0.0], [1.0, -0.5], [float("nan")]])
def test_kernels_that_are_refused(kernel):
    with pytest.raises(ValueError, match="kernel"):
        sc.checked_kernel(kernel)


def test_convolution_needs_enough_days(spark):
    scores = spark.createDataFrame([("a", "2024-01-01", 1.0), ("a", "2024-01-02", 3.0), ("b", "2024-01-02", 2.0)], "code string, day string, score double").withColumn("day", F.to_date("day"))
    on = F.lit("2024-01-05").cast("date")
    (row,) = sc.convolution_rank_on(scores, [3.0, 1.0], "code", "day", "score", on).collect()
    assert (row.code, row.smooth, row.raw_rank, row.conv_rank) == ("a", 2.5, 1, 1)
    with pytest.raises(ValueError, match="score days"):
        sc.convolution_rank_on(scores, [1.0] * 3, "code", "day", "score", on)


def test_smoothed_long_period(spark):
    """Old rows keep their weight however far back they are; a null starts afresh."""
    rows = [("a", i, 1e6 if i == 0 else 1.0) for i in range(5000)] + [("b", 0, 2.0), ("b", 1, None), ("b", 2, 4.0)]
    out = smoothed(spark.createDataFrame(rows, "code string, i int, x double"), "code", "i", "x", 1 / 1000, "s")
    got = {(r.code, r.i): r.s for r in out.collect()}
    assert abs(got["a", 4000] - ((1e6 - 1) * 0.999**4000 + 1)) < 1e-3
    assert (got["b", 0], got["b", 1], got["b", 2]) == (2.0, None, 4.0)
    with pytest.raises(ValueError, match="smoothed"):
        S.sma(F.col("x"), 1000, 1)


def test_boards_come_to_the_bars(spark):
    """Bars repeated for their boards are neither shuffled nor sorted by day and board; ties go to the first name."""
    from barloom.operators import panel as op

    bars = spark.createDataFrame([(c, d, float((c + d) % 3 - 1)) for c in range(4) for d in range(30)] + [(9, d, None) for d in range(30)], "code int, day int, pct double").repartition(3, "code")
    members = spark.createDataFrame([(c, b) for c in (0, 1, 2, 3, 9) for b in ("x", "y", "z")], "code int, board string")
    boards = spark.createDataFrame([(d, b, float(d % 3 - 1) * k) for d in range(30) for b, k in (("x", -1.0), ("y", 2.0), ("z", 1.0))], "day int, board string, performance double")
    out = op.cosine_to_boards(bars, boards, members, "code", "day", "board")
    got = {r.code: (r.board, r.days, r.similarity) for r in out.collect()}
    assert got[0] == ("y", 30, 1.0) and got[3] == ("y", 30, 1.0) and sorted(got) == [0, 1, 2, 3]
    assert got[1] == ("x", 30, 0.5)
    assert "hashpartitioning(day" not in out._jdf.queryExecution().executedPlan().toString()


def test_kdj_in_one_pass(spark):
    """k and d of a long series come from one pass, without a window of values for each row, and from rows dealt by entity without a shuffle."""
    from barloom.functions.series import kdj_j

    rng = random.Random(5)
    rows = [(c, d, float(x), x + 1.0, x - 1.5) for c in range(3) for d in range(400) for x in [None if (c, d) == (1, 200) else rng.randrange(5, 60)] if x is not None]
    rows.append((1, 200, None, 7.0, 5.0))
    out = kdj_j(spark.createDataFrame(rows, "code int, day int, c double, h double, l double").repartition(2, "code"), "code", "day", F.col("c"), F.col("h"), F.col("l"), dealt=True)
    got = {(r.code, r.day): r.j for r in out.collect()}
    assert len(got) == 1200
    for code in range(3):
        mine, k, d = sorted(r[1:] for r in rows if r[0] == code), None, None
        for i, (day, c, _, _) in enumerate(mine):
            last = mine[max(i - 8, 0) : i + 1]
            if len(last) < 9 or any(r[1] is None for r in last):
                k = d = None
                assert got[code, day] is None
                continue
            low, high = min(r[3] for r in last), max(r[2] for r in last)
            rsv = (c - low) * 100 / (high - low)
            k = rsv if k is None else rsv / 3 + k * 2 / 3
            d = k if d is None else k / 3 + d * 2 / 3
            assert abs(got[code, day] - (3 * k - 2 * d)) < 1e-9
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.split("Initial Plan")[-1].count("Exchange") == 1
