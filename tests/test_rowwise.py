"""Scenes within the row, and windows by arrays, against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import scoring as sc
from barloom.operators import sequence as sq
from barloom.sources import fixtures as fx


def test_scenes_need_no_shuffle(spark):
    """Two scenes of a day, one that isn't listed, and a day without details; no exchange, no aggregate."""
    kind = "code int, day int, details array<struct<rule:string,scene:string,stage:string,score:double>>"
    rows = [(1, 1, [("a", "up", "trigger", 2.0), ("b", "up", "fail", -5.0), ("c", "down", "trigger", -3.0)]), (1, 2, [("a", "up", "trigger", 2.0), ("x", "other", "base", 1.0)]), (2, 1, [])]
    scenes = [sc.Scene("up", True, 1.0, 3.0, 6.0, 4.0), sc.Scene("down", False, 1.0, 2.0, 4.0, 3.0)]
    out = sc.scene_stages(spark.createDataFrame(rows, kind), scenes, "code", "day")
    got = sorted((r.code, r.day, r.scene, r.stage_score, r.risk_score, r.scene_stage) for r in out.collect())
    assert got == [(1, 1, "down", -3.0, 0.0, "trigger"), (1, 1, "up", 2.0, -5.0, "fail"), (1, 2, "other", 1.0, 0.0, None), (1, 2, "up", 2.0, 0.0, "observe")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "Sort" not in plan


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_plain(spark, seed):
    rng = random.Random(seed)
    days, rows, most = 40, 6, 2
    events = sorted({(k, rng.randrange(days), rng.choice("abc")) for k in range(4) for _ in range(25)})
    target = [("a", 0), ("b", 0), ("a", 3), ("b", 5), ("b", 5), ("z", 2)]
    want = {}
    for k in range(4):
        mine = [(x, r) for c, x, r in events if c == k]
        for s in range(days - rows + 1):
            near = [min((abs(x - s - o) for x, q in mine if q == r and s <= x < s + rows and abs(x - s - o) <= most), default=None) for r, o in target]
            gaps = [g for g in near if g is not None]
            own = sum(s <= x < s + rows for x, _ in mine)
            if gaps:
                want[k, s] = (len(gaps), sum(gaps), own, round(200.0 * sum(most + 1 - g for g in gaps) / (most + 1) / (own + len(target)), 9))
    ev = spark.createDataFrame(events, "code int, at int, rule string")
    out = sq.window_similarity(ev, spark.createDataFrame(target, "rule string, offset int"), days, rows, most, "code", "at", "rule")
    assert {(r.code, r.start): (r.matched, r.gap_sum, r.own, round(r.similarity, 9)) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.where(F.col("start") < 0).count() == 0


def test_tasks_grow_with_the_lines(spark, small, monkeypatch):
    """More lines than the tasks at hand should hold are dealt to more tasks, with the same bars."""
    want = sorted(map(tuple, fx.supplier_bars(spark, small).collect()))
    monkeypatch.setattr(fx, "TASK_ROWS", 200)
    bars = fx.supplier_bars(spark, small)
    assert bars.rdd.getNumPartitions() == fx.read(spark, small, "lineitem").count() // 200
    assert sorted(map(tuple, bars.collect())) == want


def test_days_are_dealt_by_rows(spark, small, monkeypatch):
    """More lines make more tasks of ranked days, not larger ones."""
    from barloom.queries import QUERIES
    from barloom.sources import fixtures

    monkeypatch.setattr(fixtures, "TASK_ROWS", 250)
    out = QUERIES["j02_contribution_join"](spark, small)
    n = spark.read.parquet(f"{small}/lineitem.parquet").count() // 250
    assert out.count() > 0 and f", {n}), REPARTITION_BY_NUM" in "".join(x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(day" in x)
