"""Rule metrics with counted zeros against the rows made one by one."""

from __future__ import annotations

import random
from statistics import mean

import pytest

from barloom.operators import layers as la


def ranks(values):
    order, out, i = sorted(range(len(values)), key=lambda k: (values[k], k)), [0.0] * len(values), 0
    while i < len(order):
        j = i
        while j < len(order) and values[order[j]] == values[order[i]]:
            j += 1
        for k in order[i:j]:
            out[k] = (i + 1 + j) / 2
        i = j
    return out


def spearman(x, y):
    a, b = ranks(x), ranks(y)
    ma, mb = mean(a), mean(b)
    va, vb = sum((p - ma) ** 2 for p in a), sum((q - mb) ** 2 for q in b)
    return sum((p - ma) * (q - mb) for p, q in zip(a, b, strict=True)) / (va * vb) ** 0.5 if va > 1e-12 and vb > 1e-12 else None


def halves(scores, values):
    if len(scores) < 2 or max(scores) == min(scores):
        return None
    order, half = sorted(range(len(scores)), key=lambda k: (scores[k], k)), len(scores) // 2
    return mean(values[k] for k in order[-half:]) - mean(values[k] for k in order[:half])


def close(a, b):
    return a is b if a is None or b is None else abs(a - b) < 1e-9


@pytest.mark.parametrize("share", [0.1, 0.5, 0.95])
def test_rule_points(spark, share):
    """Few and many hits, scores below, at and above 0, equal returns, days of one to twelve entities, rows without return."""
    rng = random.Random(int(share * 100))
    rows, hits = [], {}
    for day in range(60):
        for code in range(rng.randrange(1, 13)):
            got = {r: rng.choice([-2.0, -1.0, 0.0, 1.0, 1.0, 3.5]) for r in ("r1", "r2", "r3") if rng.random() < share}
            ahead = None if rng.random() < 0.05 else rng.choice([-1.5, -0.5, 0.0, 0.5, 1.25, 4.0])
            rows.append((code, day, [(r, "s", "base", v) for r, v in got.items()], ahead))
            if ahead is not None:
                hits.setdefault(day, []).append((ahead, got))
    table = spark.createDataFrame(rows, "code int, day int, details array<struct<rule:string,scene:string,stage:string,score:double>>, ahead double")
    out = {(r.rule, r.day): r for r in la.rule_points(table, ["r1", "r2", "r3", "never"], "ahead", "code", "day", 2).collect()}
    want = [(rule, day) for day, x in hits.items() if len(x) >= 2 for rule in ("r1", "r2", "r3", "never")]
    assert sorted(out) == sorted(want)
    for rule, day in want:
        r, values = out[rule, day], [a for a, _ in hits[day]]
        scores, mine = [g.get(rule, 0.0) for _, g in hits[day]], [a for a, g in hits[day] if rule in g]
        assert (r.n, r.hits) == (len(values), len(mine))
        assert close(r.avg_score, mean(scores)) and close(r["mean"], mean(mine) if mine else None)
        assert close(r.excess, mean(mine) - mean(values) if mine else None)
        assert close(r.spread, halves(scores, values)), (rule, day, scores, values)
        assert close(r.ic, spearman(scores, values))


def test_empty_universe(spark):
    table = spark.createDataFrame([], "code int, day int, details array<struct<rule:string,scene:string,stage:string,score:double>>, ahead double")
    assert la.rule_points(table, ["r1"], "ahead", "code", "day").count() == 0


def test_decay_ladder(spark):
    def series(rule, values):
        return [(rule, day, 1.0, v) for day, v in enumerate(values)]

    rng = random.Random(4)
    noise = [rng.uniform(-0.1, 0.1) for _ in range(40)]
    rows = series("fell", [3 + x for x in noise[:20]] + [1 + x for x in noise[20:]])
    rows += series("lost", noise[:20] + [-1.0, 0.9] * 10)
    rows += series("rose", [1 + x for x in noise[:20]] + [2 + x for x in noise[20:]])
    rows += series("weak", [-3 + x for x in noise[:20]] + [-2 + x for x in noise[20:]])
    rows += series("flat", [1.0] * 40) + series("short", [1.0] * 25)
    out = la.decay_status(spark.createDataFrame(rows, "rule string, day int, avg_score double, excess double"), "rule", "day", (20,))
    found = {r.rule: r.status for r in out.collect()}
    assert found == {"fell": "significant_decay", "lost": "decay", "rose": "improving", "weak": "weak", "flat": "stable", "short": "insufficient"}


def test_scores_stand_for_details(spark):
    """Scores in the order of the rules give what the details give; hits are counted by groups of one score, no row is made for each."""
    rng = random.Random(3)
    rows = []
    for day in range(20):
        for code in range(rng.randrange(1, 9)):
            scores = [rng.choice([None, 0.0, 1.0, -2.0]) for _ in range(2)]
            rows.append((code, day, [(f"r{i + 1}", "s", "base", v) for i, v in enumerate(scores) if v is not None], scores, rng.choice([-1.0, 0.5, 2.0])))
    table = spark.createDataFrame(rows, "code int, day int, details array<struct<rule:string,scene:string,stage:string,score:double>>, scores array<double>, ahead double")
    made = [la.rule_points(table.drop(c), ["r1", "r2"], "ahead", "code", "day", 2) for c in ("scores", "details")]
    a, b = (sorted(map(str, x.collect())) for x in made)
    assert a == b
    assert not any("Exchange" in x and "details" in x for x in made[0]._jdf.queryExecution().executedPlan().toString().split("\n"))


def test_residuals_need_no_shuffle_of_rows(spark):
    """A panel dealt by entity stays so: between its rows and the next residuals nothing but the daily means is shuffled."""
    from barloom.operators import backtest as bt

    rows = [(c, d, None if (c + d) % 5 == 0 else float((c * 7 + d * 3) % 11), "x" if c < 3 else None) for c in range(6) for d in range(12)]
    table = spark.createDataFrame(rows, "code int, day int, pct double, industry string").repartition(4, "code")
    out = bt.ahead_of_residuals(table, "code", "day", 0.5, 0.2, 3)
    got = {(r.code, r.day): r.ahead for r in out.collect()}
    known = {(c, d): (p, i) for c, d, p, i in rows if p is not None}
    res = {(c, d): p - 0.5 * mean(q for (_, e), (q, _) in known.items() if e == d) - 0.2 * mean(q for (_, e), (q, j) in known.items() if e == d and j == i) for (c, d), (p, i) in known.items()}
    for c, d, p, _ in rows:
        later = [res[c, e] for e in range(d + 1, 12) if (c, e) in res][:3]
        assert close(got[c, d], sum(later) if p is not None and len(later) == 3 else None)
    shuffles = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning(code" in x]
    assert len([x for x in shuffles if "REPARTITION" not in x]) == 0
