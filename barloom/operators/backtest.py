"""Factor back-tests: residual and forward returns, rank correlations, layers, top series and decay.

Cross-sections are windows or groups by day, series are windows by entity; what is left per day is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def residual(bars: DataFrame, industry: DataFrame, key: str, day: str, beta_market: float, beta_industry: float) -> DataFrame:
    """pct less beta times the day's market mean and less beta times the day's industry mean; rows without pct go."""
    known = bars.where("pct is not null").join(industry.select(key, "industry"), key)
    return known.withColumn("residual", residual_of(day, beta_market, beta_industry))


def residual_of(day: str, beta_market: float, beta_industry: float) -> Column:
    """The residual of rows with pct and industry, null without pct."""
    market = F.avg("pct").over(Window.partitionBy(day))
    own = F.avg("pct").over(Window.partitionBy(day, "industry"))
    return F.col("pct") - beta_market * market - beta_industry * own


def forward(df: DataFrame, value: str, key: str, day: str, p: int) -> Column:
    """Sum of the next p values of the entity's own rows; null where there are fewer."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(1, p)
    return F.when(F.count(value).over(w) == p, F.sum(value).over(w))


def ahead_of_residuals(panel: DataFrame, key: str, day: str, beta_market: float, beta_industry: float, p: int) -> DataFrame:
    """``panel`` (pct, industry) with ``residual`` and ``ahead``, the sum of the entity's next ``p`` residuals; null where there are fewer.

    Rows without pct have neither and aren't among the next ones. The means of days and industries are grouped and come back
    as one row for each, so that a panel dealt by entity stays so and its rows are not shuffled.
    """
    own = panel.where("pct is not null").groupBy(F.col(day).alias("_day"), F.col("industry").alias("_industry")).agg(F.sum("pct").alias("_s"), F.count(F.lit(1)).alias("_k"))
    every = Window.partitionBy("_day")
    means = own.select("_day", "_industry", (beta_market * F.sum("_s").over(every) / F.sum("_k").over(every)).alias("_market"), (beta_industry * F.col("_s") / F.col("_k")).alias("_own"))
    out = panel.join(F.broadcast(means), (F.col(day) == F.col("_day")) & F.col("industry").eqNullSafe(F.col("_industry")), "left")
    out = out.withColumn("residual", F.col("pct") - F.col("_market") - F.col("_own")).drop(*means.columns)
    w = Window.partitionBy(key, F.col("pct").isNotNull()).orderBy(day).rowsBetween(1, p)
    return out.withColumn("ahead", F.when(F.col("pct").isNotNull() & (F.count("residual").over(w) == p), F.sum("residual").over(w)))


def average_rank(value: Column, *by: str) -> Column:
    """Ranks within ``by``, ties averaged; equal means equal to nine digits."""
    v = F.round(value, 9)
    return F.rank().over(Window.partitionBy(*by).orderBy(v)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, v)) - 1) / 2


def daily_ic(df: DataFrame, score: str, ahead: str, *by: str, least: int = 3) -> DataFrame:
    """Spearman correlation per group; null where one side doesn't vary. Groups under ``least`` rows go."""
    ranked = df.where(F.col(ahead).isNotNull()).withColumns({"_a": average_rank(F.col(score), *by), "_b": average_rank(F.col(ahead), *by)})
    flat = (F.var_pop("_a") <= TINY) | (F.var_pop("_b") <= TINY)
    g = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.when(~flat, F.try_divide(F.covar_pop("_a", "_b"), F.stddev_pop("_a") * F.stddev_pop("_b"))).alias("ic"))
    return g.where(F.col("n") >= least)


def spread(df: DataFrame, score: str, ahead: str, key: str, day: str) -> DataFrame:
    """Mean of the upper half less mean of the lower half by (score, entity); null if the score doesn't vary."""
    w, every = Window.partitionBy(day).orderBy(score, key), Window.partitionBy(day)
    r = df.where(F.col(ahead).isNotNull()).withColumns({"_n": F.row_number().over(w), "_m": F.count(F.lit(1)).over(every)})
    half = F.floor(F.col("_m") / 2)
    top, low = F.avg(F.when(F.col("_n") > F.col("_m") - half, F.col(ahead))), F.avg(F.when(F.col("_n") <= half, F.col(ahead)))
    return r.groupBy(day).agg(F.when((F.count(F.lit(1)) >= 2) & (F.max(score) - F.min(score) >= TINY), top - low).alias("spread"))


def mean_std_t(series: DataFrame, value: str, *by: str) -> DataFrame:
    """n, mean, sample standard deviation, mean / std and its t."""
    g = series.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    ratio = F.when(F.col("std") > TINY, F.col("mean") / F.col("std"))
    return g.withColumns({"ir": ratio, "t": ratio * F.sqrt("n")})


def newey_west(series: DataFrame, value: str, day: str, by: str, lags: int) -> DataFrame:
    """t of the mean with Bartlett weights over ``lags`` of each group's day series."""
    w, every = Window.partitionBy(by).orderBy(day), Window.partitionBy(by)
    c = series.where(F.col(value).isNotNull()).withColumn("_c", F.col(value) - F.avg(value).over(every))
    c = c.withColumns({f"_g{k}": F.col("_c") * (F.lag("_c", k).over(w) if k else F.col("_c")) for k in range(lags + 1)})
    g = c.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), *[F.coalesce(F.sum(f"_g{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(lags + 1)])
    most = F.least(F.lit(lags), F.col("n") - 1)
    variance = (F.col("_s0") + sum((F.when(most >= k, 2 * (1 - k / (most + 1)) * F.col(f"_s{k}")).otherwise(0.0) for k in range(1, lags + 1)), F.lit(0.0))) / F.col("n") / F.col("n")
    return g.select(by, "n", "mean", F.when(variance > TINY, F.col("mean") / F.sqrt(variance)).alias("t"))


def layer_by_count(score: str, rank: str, day: str, layers: int) -> Column:
    """floor(i * layers / n) in the order of score, then larger rank first."""
    w = Window.partitionBy(day).orderBy(F.asc(score), F.desc(rank))
    return F.floor((F.row_number().over(w) - 1) * layers / F.count(F.lit(1)).over(Window.partitionBy(day))).cast("int")


def layer_by_range(score: str, day: str, layers: int) -> Column:
    every = Window.partitionBy(day)
    low, span = F.min(score).over(every), F.max(score).over(every) - F.min(score).over(every)
    return F.when(span < TINY, 0).otherwise(F.least(F.floor(F.try_divide(F.col(score) - low, span) * layers), F.lit(layers - 1))).cast("int")


def layer_by_rank(rank: str, day: str, layers: int) -> Column:
    top = F.max(rank).over(Window.partitionBy(day))
    return F.floor(((top - F.col(rank) + 1) * layers - 1) / top).cast("int")


def layer_means(df: DataFrame, layer: Column, ahead: str, day: str) -> DataFrame:
    """Per layer the mean of its daily means, with days and samples."""
    daily = df.withColumn("layer", layer).where(F.col(ahead).isNotNull()).groupBy(day, "layer").agg(F.avg(ahead).alias("m"), F.count(F.lit(1)).alias("n"))
    return daily.groupBy("layer").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("samples"), F.round(F.avg("m"), 5).alias("mean"))


def top_series(df: DataFrame, sizes: tuple[int, ...], rank: str, ahead: str, day: str) -> DataFrame:
    """Daily mean of the best k of each day, for all k at once: a row counts for every k that reaches its rank."""
    ks = F.explode(F.filter(F.array(*[F.lit(k) for k in sizes]), lambda k: k >= F.col(rank)))
    return df.where((F.col(rank) <= max(sizes)) & F.col(ahead).isNotNull()).select(day, ahead, ks.alias("k")).groupBy("k", day).agg(F.avg(ahead).alias("m"))


def rule_days(universe: DataFrame, details: DataFrame, ahead: str, key: str, day: str, least: int) -> DataFrame:
    """Per rule and day: samples, mean score over the whole universe, mean of the triggered and their excess over the market.

    Untriggered entities score 0; they are counted from the day, not made as rows. ``details`` carries ``ahead``.
    """
    u = universe.where(F.col(ahead).isNotNull()).select(key, day, ahead)
    market = u.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.avg(ahead).alias("market")).where(F.col("n") >= least)
    hit = details.where(F.col(ahead).isNotNull()).groupBy("rule", day).agg(F.count(F.lit(1)).alias("hits"), F.sum("score").alias("s"), F.avg(ahead).alias("mean"))
    return hit.join(market, day).select("rule", day, "n", "hits", (F.col("s") / F.col("n")).alias("avg_score"), "mean", (F.col("mean") - F.col("market")).alias("excess"))


def decay(days: DataFrame, rule: str, day: str, windows: tuple[int, ...] = (20, 40, 60), least_prior: int = 10) -> DataFrame:
    """Recent against earlier directional excess of each rule: means, change and Welch's t.

    The direction is the sign of the rule's summed mean scores. All windows come from one numbering.
    """
    sign = F.when(F.sum("avg_score").over(Window.partitionBy(rule)) < 0, -1.0).otherwise(1.0)
    back = F.row_number().over(Window.partitionBy(rule).orderBy(F.desc(day)))
    r = days.select(rule, back.alias("back"), (F.col("excess") * sign).alias("v"))
    r = r.withColumn("span", F.explode(F.array(*[F.lit(k) for k in windows])))
    late = lambda f, yes: f(F.when((F.col("back") <= F.col("span")) if yes else (F.col("back") > F.col("span")), F.col("v")))
    g = r.groupBy(rule, "span").agg(late(F.count, True).alias("n1"), late(F.count, False).alias("n0"), late(F.avg, True).alias("recent"), late(F.avg, False).alias("prior"), late(F.var_samp, True).alias("v1"), late(F.var_samp, False).alias("v0"))
    error = F.sqrt(F.col("v1") / F.col("n1") + F.col("v0") / F.col("n0"))
    return g.where(F.col("n0") >= least_prior).select(rule, "span", F.col("n0").alias("prior_days"), F.round("recent", 5).alias("recent"), F.round("prior", 5).alias("prior"), F.when(error > TINY, F.round((F.col("recent") - F.col("prior")) / error, 4)).alias("t"))
