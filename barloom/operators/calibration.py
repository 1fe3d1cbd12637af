"""Calibration of a rule: the same condition under many scopes, each judged on the same cross-sections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import Series
from barloom.operators import scoring as sc
from barloom.operators.backtest import TINY, mean_std_t
from barloom.operators.layers import NOISE, rule_points
from barloom.sources.store import kept

@dataclass(frozen=True)
class Candidate:
    """A scope (last, any, each, consec, recent) over ``rows`` rows; consec needs a run of ``run``."""

    scope: str
    rows: int = 1
    run: int = 1

    @property
    def name(self) -> str:
        return f"consec-{self.run}-{self.rows}" if self.scope == "consec" else f"{self.scope}-{self.rows}"

    def score(self, s: Series, hit: Column, sign: float) -> sc.Scored:
        if self.scope == "each":
            return sc.each(s, hit, self.rows, sign)
        if self.scope == "recent":
            return sc.recent(s, hit, self.rows, table=[(i, i, sign * w) for i, w in enumerate(decay_points(self.rows))])
        found = {"last": lambda: hit, "any": lambda: sc.any_of(s, hit, self.rows), "consec": lambda: sc.consecutive(s, hit, self.rows, self.run)}[self.scope]()
        return sc.flat(found, sign)


def decay_points(rows: int) -> list[float]:
    """1 at the newest row, halved every (rows - 1) / 2 rows, one at least."""
    half_life = max((max(rows, 2) - 1) / 2, 1.0)
    return [0.5 ** (i / half_life) for i in range(rows)]


CANDIDATES = [Candidate("last"), *[Candidate(s, n) for s in ("any", "each") for n in (3, 5, 10)], *[Candidate("consec", n, k) for k in (2, 3) for n in (3, 5, 10)], *[Candidate("recent", n) for n in (3, 5, 10)]]


def candidate_details(s: Series, hit: Column, candidates: list[Candidate], sign: float) -> Column:
    """The candidates that trigger in a row with their scores, in the form of rule details: one pass for all."""
    found = [(c.name, c.score(s, hit, sign)) for c in candidates]
    return F.array_compact(F.array(*[F.when(x.triggered, F.struct(F.lit(n).alias("rule"), F.lit("").alias("scene"), F.lit("base").alias("stage"), x.score.cast("double").alias("score"))) for n, x in found]))


def candidate_scores(s: Series, hit: Column, candidates: list[Candidate], sign: float) -> Column:
    """The candidates' scores in their order, null where one doesn't trigger."""
    found = [c.score(s, hit, sign) for c in candidates]
    return F.array(*[F.when(x.triggered, x.score.cast("double")) for x in found])


def to_half(x: Column) -> Column:
    return F.round(x * 2) / 2


def calibrate(universe: DataFrame, candidates: list[Candidate], sign: float, ahead: str, key: str, day: str, least: int = 1, samples: int = 100, days: int = 20, z: float = 1.28, scale: float = 40.0) -> DataFrame:
    """A row per candidate: its samples, daily excess, conservative edge, stability, monotonicity, status and suggested points.

    ``universe`` has a row per entity and day with ``details`` from ``candidate_details`` or ``scores`` from ``candidate_scores``. The edge is the mean daily excess,
    in the direction ``sign``, less z standard errors; a candidate is insufficient under ``samples`` triggers or ``days``
    days, has no_edge where that isn't above 0, is unstable where one half of its days isn't, else reliable. Monotonicity
    is the share of score values, of those with 30 samples or more, whose mean return isn't below the one before. Points are
    ``scale`` times edge per daily standard deviation, weighted by stability and, for each and recent, monotonicity, in
    halves from 0 to 10, and per trigger divided by the mean score. Means of nothing are null. ``best`` marks the one to take.
    """
    names = [c.name for c in candidates]
    points = kept(rule_points(universe, names, ahead, key, day, least), "points")
    line, every = Window.partitionBy("rule").orderBy(day), Window.partitionBy("rule")
    p = points.where("excess is not null").withColumns({"_no": F.row_number().over(line), "_of": F.count(F.lit(1)).over(every)})
    early = F.col("_no") <= F.floor(F.col("_of") / 2)
    daily = p.groupBy("rule").agg(F.count(F.lit(1)).alias("_n"), F.avg("mean").alias("residual_mean"), F.avg("excess").alias("excess_mean"), F.stddev_samp("excess").alias("daily_std"), F.avg(F.when(early, F.col("excess"))).alias("early_mean"), F.avg(F.when(~early, F.col("excess"))).alias("late_mean"))
    ic = mean_std_t(points, "ic", "rule").select("rule", F.col("mean").alias("ic_mean"), F.col("t").alias("ic_t"))
    there = universe.where(F.col(ahead).isNotNull())
    if "scores" in universe.columns:
        hits = there.select(day, ahead, F.posexplode("scores").alias("_i", "score")).withColumn("rule", F.get(F.array(*map(F.lit, names)), F.col("_i")))
    else:
        hits = sc.rule_details(there, key, day, ahead)
    hits = hits.withColumn("_m", F.abs("score")).where(F.col("_m") > TINY)
    counted = kept(hits.groupBy("rule", day, "_m").agg(F.count(F.lit(1)).alias("n"), F.sum(ahead).alias("r")), "counted")  # hits are read once
    by_score = counted.groupBy("rule", "_m").agg(F.sum("n").alias("n"), (F.sum("r") / F.sum("n")).alias("r"))
    before = F.lag("_v").over(Window.partitionBy("rule").orderBy("_m"))
    steps = by_score.where("n >= 30").withColumn("_v", F.col("r") * sign).withColumn("_b", before)
    mono = steps.groupBy("rule").agg(F.try_divide(F.count_if(F.col("_v") + TINY >= F.col("_b")), F.count("_b")).alias("monotonicity"))
    seen = counted.groupBy("rule").agg(F.sum("n").alias("samples"), F.countDistinct(day).alias("days"), (F.sum(F.col("_m") * F.col("n")) / F.sum("n")).alias("multiplier"))
    g = universe.sparkSession.createDataFrame([(c.name, c.scope) for c in candidates], "rule string, scope string")
    for other in (daily, ic, mono, seen):
        g = g.join(other, "rule", "left")
    g = g.fillna(0, ["samples", "days"])
    edge = F.col("excess_mean") * sign - z * F.col("daily_std") / F.sqrt("_n")
    a, b = F.col("early_mean") * sign > NOISE, F.col("late_mean") * sign > NOISE
    both = F.col("early_mean").isNotNull() & F.col("late_mean").isNotNull()
    stable = F.when(both & a & b, 1.0).when(both & (a | b), 0.5).otherwise(0.0)
    shape = F.when(F.col("scope") == "each", F.greatest(F.lit(0.25), F.coalesce("monotonicity", F.lit(0.25)))).when(F.col("scope") == "recent", 0.5 + F.coalesce("monotonicity", F.lit(0.5)) * 0.5).otherwise(1.0)
    g = g.withColumns({"_edge": edge, "_stable": stable, "_shape": shape, "_enough": (F.col("samples") >= samples) & (F.col("days") >= days)})
    unit = F.when((F.col("_edge") > NOISE) & (F.col("daily_std") > TINY), F.col("_edge") / F.col("daily_std")).otherwise(0.0)
    support = F.when(F.col("ic_t") > 0, F.col("ic_t") / F.sqrt(F.greatest("_n", F.lit(1)))).otherwise(0.0)
    weight = F.col("_stable") * F.col("_shape")
    status = F.when(~F.col("_enough"), "insufficient").when(~F.coalesce(F.col("_edge") > NOISE, F.lit(False)), "no_edge").when(F.col("_stable") < 1, "unstable").otherwise("reliable")
    total = F.when(F.col("_enough"), to_half(F.least(F.lit(10.0), scale * unit * weight))).otherwise(0.0)
    g = g.withColumns({"edge": F.col("_edge") * sign, "status": status, "calibration_score": F.when(F.col("_enough"), (unit + support * 0.15) * weight).otherwise(0.0), "total_points": total * sign})
    each_ = F.when(F.col("multiplier") > TINY, to_half(F.least(F.lit(10.0), F.abs("total_points") / F.col("multiplier")))).otherwise(0.0)
    order = Window.orderBy(F.when(F.col("status") == "reliable", 0).when(F.col("status") == "unstable", 1).otherwise(2), F.desc("calibration_score"), "rule")  # a row per candidate
    g = g.withColumns({"points": each_ * sign, "best": (F.row_number().over(order) == 1) & F.col("status").isin("reliable", "unstable")})
    return g.select("rule", "samples", "days", "residual_mean", "excess_mean", "daily_std", "edge", "early_mean", "late_mean", "ic_mean", "ic_t", "monotonicity", "multiplier", "points", "total_points", "calibration_score", "status", "best")
