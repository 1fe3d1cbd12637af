"""Value series of a daily basket, and rounding as price vendors do it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rounding import exact_round2
from barloom.queries.market import RANKED, ranked
from barloom.sources.fixtures import BARS, supplier_bars

_DAILY = f"WITH {RANKED}, pr AS (SELECT *, lag(rank) OVER (PARTITION BY code ORDER BY day) AS before FROM rk), dr AS (SELECT day, year(day) AS y, avg(pct) / 100 AS r FROM pr WHERE before <= 5 AND pct IS NOT NULL GROUP BY day)"


def daily_returns(spark, d) -> DataFrame:
    """day, y and r: mean return of entities that were in the top five on their last day."""
    held = ranked(spark, d).withColumn("before", F.lag("rank").over(Window.partitionBy("code").orderBy("day"))).where("before <= 5 and pct is not null")
    return held.groupBy("day").agg((F.avg("pct") / 100).alias("r")).withColumn("y", F.year("day"))


def q10_drawdown(spark, d) -> DataFrame:
    """Largest fall of the year's value below its running peak, in percent; null if the value reaches 0."""
    w = Window.partitionBy("y").orderBy("day")
    nav = daily_returns(spark, d).withColumn("nav", F.when(F.min("r").over(w) > -1, F.exp(F.sum(F.log1p("r")).over(w))))
    fall = nav.withColumn("peak", F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return fall.groupBy("y").agg(F.when(F.count("nav") == F.count(F.lit(1)), F.round(F.max((F.col("peak") - F.col("nav")) / F.col("peak")) * 100, 5)).alias("drawdown"))


def q11_sharpe(spark, d) -> DataFrame:
    """Mean over sample standard deviation times the root of 252, by year."""
    g = daily_returns(spark, d).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    return g.select("y", "n", F.when((F.col("n") >= 2) & (F.col("s") > 1e-12), F.round(F.col("m") / F.col("s") * F.sqrt(F.lit(252.0)), 5)).alias("sharpe"))


def i03_exact_round(spark, d) -> DataFrame:
    """Two digits of the exact decimal expansion of a double, ties to even."""
    return supplier_bars(spark, d).select("code", "day", exact_round2(F.col("close")).alias("price"))


QUERIES = {"q10_drawdown": q10_drawdown, "q11_sharpe": q11_sharpe, "i03_exact_round": i03_exact_round}
ORACLE = {
    "q10_drawdown": f"{_DAILY}, nv AS (SELECT y, day, CASE WHEN min(r) OVER w > -1 THEN exp(sum(CASE WHEN r > -1 THEN ln(1 + r) END) OVER w) END AS nav FROM dr WINDOW w AS (PARTITION BY y ORDER BY day)), pk AS (SELECT *, max(nav) OVER (PARTITION BY y ORDER BY day) AS peak FROM nv) SELECT CAST(y AS INT) AS y, CASE WHEN count(nav) = count(*) THEN round(max((peak - nav) / peak) * 100, 5) END AS drawdown FROM pk GROUP BY y",
    "q11_sharpe": f"{_DAILY} SELECT CAST(y AS INT) AS y, count(*) AS n, CASE WHEN count(*) >= 2 AND stddev_samp(r) > 1e-12 THEN round(avg(r) / stddev_samp(r) * sqrt(252), 5) END AS sharpe FROM dr GROUP BY y",
    "i03_exact_round": f"WITH {BARS} SELECT code, day, CAST(printf('%.2f', close) AS DOUBLE) AS price FROM bars",
}
