"""Rule files, minute answers, list dates, exact rounding and runs: faults and edges."""

from __future__ import annotations

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.functions.rounding import exact_round2
from barloom.functions.series import Series
from barloom.operators import eligibility as el
from barloom.queries.files import RULE_FILE, formulas
from barloom.sources.minutes import minute_series
from barloom.sources.rules import RuleError, parse_rules
from barloom.sources.runs import compare_runs, save_run
from barloom.sources.store import Store, scratch

FAULTS = [
    ("version = 1", "version = ", "no TOML"),
    ("version = 1", "[[chip]]\nname = 'x'", "unknown tables"),
    ('name = "heat"', 'name = "trend"', "scene trend occurs twice"),
    ('name = "hot"', 'name = "above"', "rule above occurs twice"),
    ("confirm_threshold = 6.0", "confirm_threshold = 0.0", r"scene 1 \(trend\): confirm_threshold"),
    ("confirm_threshold = 6.0", "", r"scene 1 \(trend\): a threshold is missing"),
    ('direction = "short"', 'direction = "down"', "direction"),
    ('scene = "heat"\nstage', 'scene = "cold"\nstage', r"rule 4 \(hot\): no scene cold"),
    ('stage = "fail"', 'stage = "end"', r"rule 5 \(broken\): no stage end"),
    ('scope_way = "ANY"', 'scope_way = "CONSEC>=0"', r"rule 4 \(hot\): no scope_way"),
    ("scope_windows = 3", "scope_windows = 0", "scope_windows"),
    ('when = "hot below"', 'when = "cold"', r"rule 5 \(broken\): no formula cold"),
    ("points = -2.0", "points = nan", "points must be a finite number"),
    ("{ min = 1, max = 2, points = 3.0 }", "{ min = 0, max = 2, points = 3.0 }", "overlap"),
    ("{ min = 1, max = 2, points = 3.0 }", "{ min = 2, max = 1, points = 3.0 }", "dist_points 2 has no range"),
    ('when = "above"\npoints', 'when = "above"\nmax_points = 2.0\npoints', "max_points need EACH"),
    ("points = -4.0", "points = -4.0\ndist_points = [{ min = 0, max = 0, points = 1.0 }]", "dist_points need EACH or RECENT"),
    ("points = -4.0", "points = -4.0\npoints_by_hits = [0.0, 1.0]", "points_by_hits not allowed here"),
    ("points_by_hits = [0.0, 1.0, 3.0, 5.0]", "points_by_hits = [0.0, 1.0, 3.0]", r"rule 3 \(joined\): points_by_hits must have 4"),
    ("points_by_hits = [0.0, 1.0, 3.0, 5.0]", "points_by_hits = [0.0, 0.0, 0.0, 0.0]", "not all 0"),
    ('{ name = "b", when = "crossed" }', '{ name = "a", when = "crossed" }', "condition a occurs twice"),
    ('explain = "how many hold"', "", r"rule 3 \(joined\): explain is missing"),
]


@pytest.mark.parametrize("old,new,message", FAULTS)
def test_rule_file_faults(spark, old, new, message):
    assert old in RULE_FILE
    with pytest.raises(RuleError, match=message):
        parse_rules(RULE_FILE.replace(old, new, 1), Series("code", "day"), formulas())


def answer(points, key="sh1", date="20260811", code=0):
    return json.dumps({"code": code, "msg": "", "data": {key: {"data": {"data": points, "date": date}, "qt": {key: ["", "x"]}}}})


def test_minute_answers(spark):
    rows = [
        ("SH1", answer(["0930 11.31 2670 3019770.00", "0931 11.33 15028 17019975.00"])),
        ("SH2", answer(["0930 70.06 1457695 102126112.00", "0931 70.50 1600000 112500000.00"], "sh2")),
        ("SH3", answer([], "sh3")), ("SH4", answer(["0930 1 0 0", "1500 1 5 5"], "sh4")),
        ("E1", answer(["0930 1 5 5"], "e1", code=3)), ("E2", "{broken"), ("E3", None), ("E4", answer(["0930 1 5 5"], "e1")),
        ("E5", answer(["0930 1 5"], "e5")), ("E6", answer(["2530 1 5 5"], "e6")), ("E7", answer(["0930 x 5 5"], "e7")), ("E8", answer(["0930 1 5 5", "0931 1 4 6"], "e8")),
        ("E9", answer(["0930 1 -5 5"], "e9")), ("E10", answer(["0930 1 5 5"], "e10", "2026-08-11")), ("E11", "[]"), (None, answer(["0930 1 5 5"])),
    ]
    out = minute_series(spark.createDataFrame(rows, "code string, body string"), "code", "body").collect()
    good = [(r.code, r.no, r.time, r.vol, r.amount, None if r.average_price is None else round(r.average_price, 6)) for r in out if r.error is None]
    assert sorted(good) == [("SH1", 0, "09:30", 2670.0, 3019770.0, 11.31), ("SH1", 1, "09:31", 12358.0, 14000205.0, 11.325509), ("SH2", 0, "09:30", 1457695.0, 102126112.0, 70.06), ("SH2", 1, "09:31", 142305.0, 10373888.0, 70.3125), ("SH4", 0, "09:30", 0.0, 0.0, None), ("SH4", 1, "15:00", 5.0, 5.0, 1.0)]
    assert all(r.date == dt.date(2026, 8, 11) for r in out if r.error is None)
    errors = {r.code: r.error for r in out if r.error is not None}
    assert errors == {"E1": "code 3", "E2": "no JSON answer", "E3": "no JSON answer", "E4": "key is missing", "E5": "too few fields", "E6": "bad time", "E7": "bad number", "E8": "total falls", "E9": "bad number", "E10": "no date or points", "E11": "no JSON answer", None: "key is missing"}


def test_exact_rounding(spark):
    rng = random.Random(3)
    values = [0.125, 0.375, 2.675, 1.005, 0.145, 0.005, 0.015, -0.125, -0.005, -0.001, 0.0, -0.0, 1e13 + 0.125, 7e13, 1e300, 123456.785, 0.995, 1e-320, 4503599627370.115]
    values += [rng.uniform(-1000, 1000) for _ in range(20000)] + [round(rng.uniform(0, 500), 3) for _ in range(20000)] + [k / 8 for k in range(-4000, 4000)] + [math.nextafter(k / 1000, d) for k in range(5, 3000, 10) for d in (0, 9)]
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", exact_round2(F.col("v")).alias("r")).collect()
    assert [(r.v, r.r) for r in out if r.r != float(f"{r.v:.2f}")] == []
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "v double").select(exact_round2(F.col("v")).alias("r")).collect()
    assert odd[0].r is None and math.isnan(odd[1].r) and odd[2].r == float("inf")


def test_eligibility(spark):
    days = [dt.date(2023, 1, 2) + dt.timedelta(days=k) for k in range(70)] + [dt.date(2024, 1, k) for k in (2, 3, 4)]
    calendar = spark.createDataFrame([(x,) for x in [*days, days[0], None]], "day date")
    listed = spark.createDataFrame([(1, dt.date(2023, 1, 11)), (2, dt.date(2024, 1, 3)), (3, None), (4, dt.date(2030, 1, 1)), (5, dt.date(2023, 3, 20)), (6, dt.date(1990, 1, 1))], "code int, listed date")
    samples = [(c, x) for c in (1, 2, 3, 4, 5, 6, 7) for x in (days[0], days[68], days[69], *days[70:], dt.date(2023, 12, 31))]
    got = {tuple(r) for r in el.eligible(spark.createDataFrame(samples, "code int, day date"), calendar, listed, "code", "day", "listed").collect()}
    first = {1: 9, 2: 71, 5: 70, 6: 0}
    assert got == {(c, x) for c, x in samples if x in days and (c not in first or days.index(x) + 1 >= first[c] + 60)}
    assert el.eligible(spark.createDataFrame(samples, "code int, day date"), calendar, listed, "code", "day", "listed", 0).count() == len(samples)


def test_runs(spark):
    store = Store(spark, scratch(spark, "runs"), "run_id")
    made = lambda *v: spark.createDataFrame([*enumerate(v)], "layer int, mean double")
    a = save_run(store, {"k": 1, "name": "x"}, made(1.0, 2.0))
    b = save_run(store, {"k": 2, "name": "x"}, made(1.5, 2.5, 3.5))
    assert save_run(store, {"name": "x", "k": 1}, made(1.0, 4.0)) == a != b
    assert store.read().count() == 5
    got = sorted(map(tuple, compare_runs(store, a, b, ["layer"], "mean").collect()))
    assert got == [(0, 1.0, 1.5, 0.5), (1, 4.0, 2.5, -1.5), (2, None, 3.5, None)]
