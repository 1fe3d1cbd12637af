"""Checks of rules and rankings: profit and loss, calibration of scopes, kernel grids, layers by group, value series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.semantics import ieee_log

EPS = 1e-12


def profit_loss_ratio(value: Column) -> Column:
    """Sum of gains over the sum of losses' sizes; values within EPS of 0 count for neither, null without losses."""
    gain, loss = F.sum(F.when(value > EPS, value)), F.sum(F.when(value < -EPS, -value))
    return F.try_divide(F.coalesce(gain, F.lit(0.0)), loss)


def finite(value: Column) -> Column:
    """Not null, NaN or infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def attach(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys``; the job fails if ``other`` has a key twice."""
    rest = [c for c in other.columns if c not in keys]
    once = other.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    checked = once.where(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("key occurs twice: "), F.concat_ws(",", *keys))).cast("boolean")).otherwise(True))
    return df.join(checked.drop("_n"), keys, "left")


def factor_residual(bars: DataFrame, index: DataFrame, concepts: DataFrame, industries: DataFrame, betas: tuple[float, float, float], key: str, day: str) -> DataFrame:
    """(key, day, residual): pct less beta times the index, concept and industry series of the day.

    ``bars`` has pct, concept and industry; ``index`` (day, pct); ``concepts`` and ``industries`` (day, name, pct). A factor
    is used if its beta is not 0. An empty name stands for the index; a name whose series lacks the day gives no row.
    """
    out = bars.where("pct is not null").join(index.select(day, F.col("pct").alias("_index")), day, "left")
    total, needed = F.lit(0.0), F.lit(True)
    if abs(betas[0]) > EPS:
        total, needed = total + betas[0] * F.col("_index"), needed & F.col("_index").isNotNull()
    for name, series, beta in (("concept", concepts, betas[1]), ("industry", industries, betas[2])):
        if abs(beta) <= EPS:
            continue
        side = series.select(F.col(day).alias(f"_{name}_day"), F.col("name").alias(f"_{name}_name"), F.col("pct").alias(f"_{name}"))
        out = out.join(side, (F.col(day) == F.col(f"_{name}_day")) & (F.col(name) == F.col(f"_{name}_name")), "left")
        value = F.when(F.coalesce(F.col(name), F.lit("")) == "", F.col("_index")).otherwise(F.col(f"_{name}"))
        total, needed = total + beta * value, needed & value.isNotNull()
    return out.where(needed).select(key, day, (F.col("pct") - total).alias("residual"))


def longest_run(df: DataFrame, hit: str, key: str, day: str) -> DataFrame:
    """Rows with ``streak``: hits in a row up to each row."""
    w = Window.partitionBy(key).orderBy(day)
    block = F.sum((~F.col(hit)).cast("int")).over(w)
    return df.withColumn("_block", block).withColumn("streak", F.sum(F.col(hit).cast("int")).over(Window.partitionBy(key, "_block").orderBy(day))).drop("_block")


def sampled(df: DataFrame, group: str, value: str, key: Column, n: int) -> DataFrame:
    """Per group the ``n`` largest gains, the ``n`` largest losses and ``n`` of all rows in the order of a hash of ``key``."""
    by = lambda *o: F.row_number().over(Window.partitionBy(group).orderBy(*o))
    v = F.col(value)
    ranked = df.withColumns({"_up": by(F.desc(value), key), "_down": by(F.asc(value), key), "_any": by(F.md5(key.cast("string").cast("binary")), key)})
    kinds = F.array_compact(F.array(F.when((F.col("_up") <= n) & (v > 0), "gain"), F.when((F.col("_down") <= n) & (v < 0), "loss"), F.when(F.col("_any") <= n, "any")))
    return ranked.where((F.least("_up", "_down", "_any") <= n)).withColumn("kind", F.explode(kinds)).drop("_up", "_down", "_any")


def conservative_edge(value: Column) -> Column:
    """Mean less 1.28 standard errors."""
    return F.avg(value) - 1.28 * F.stddev_samp(value) / F.sqrt(F.count(value))


# The grid of smoothing kernels.
WINDOWS = (2, 3, 5, 10, 15, 20, 30)
DECAYS = (0.25, 0.5, 0.7, 0.85, 1.0)
HYBRID_WINDOWS = (10, 20, 30)
LONG_SHARES = (0.1, 0.2, 0.3, 0.5)


def kernel_grid() -> list[tuple[str, list[float]]]:
    """Raw scores, geometric kernels and mixes of a flat long part with 1, 0.7, 0.49 on the latest days; weights sum to 1."""
    grid = [("raw", [1.0])]
    for n in WINDOWS:
        for d in DECAYS:
            parts = [d**i for i in range(n)]
            grid.append((f"geometric-{n}-{d}", [p / sum(parts) for p in parts]))
    for n in HYBRID_WINDOWS:
        for share in LONG_SHARES:
            late = [1.0, 0.7, 0.49] + [0.0] * (n - 3)
            grid.append((f"hybrid-{n}-{share}", [share / n + (1 - share) * x / sum(late) for x in late]))
    return grid


def kernel_tops(scores: DataFrame, grid: list[tuple[str, list[float]]], key: str, day: str, score: str, k: int) -> DataFrame:
    """(kernel, day_no, key): the best ``k`` of each day by every kernel. One pass: an array of the latest scores meets an array of kernels."""
    longest = max(len(w) for _, w in grid)
    days = scores.select(day).distinct().withColumn("day_no", F.row_number().over(Window.orderBy(day)))  # one row per day
    w = Window.partitionBy(key).orderBy("day_no")
    late = F.reverse(F.collect_list(F.struct("day_no", F.col(score).alias("s"))).over(w.rowsBetween(-(longest - 1), 0)))
    kernels = F.array(*[F.struct(F.lit(name).alias("kernel"), F.array(*map(F.lit, weights)).alias("weights")) for name, weights in grid])
    rows = scores.join(days, day).select(key, "day_no", late.alias("late")).select(key, "day_no", "late", F.inline(kernels))
    n = F.size("weights")
    whole = rows.where((F.size("late") >= n) & (F.try_element_at("late", n)["day_no"] == F.col("day_no") - n + 1))
    smooth = F.aggregate(F.zip_with(F.slice("late", F.lit(1), n), "weights", lambda a, b: a.s * b), F.lit(0.0), lambda a, x: a + x)
    best = whole.select("kernel", "day_no", key, smooth.alias("smooth"))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("kernel", "day_no").orderBy(F.desc(F.round("smooth", 9)), F.asc(key))))
    return best.where(F.col("_r") <= k).select("kernel", "day_no", key)


def net_value(days: DataFrame, day: str, value: str) -> Column:
    """Product of 1 + value up to each day; 0 from a value of -1 on, NaN from one below."""
    log = F.when(F.col(value) > -1, F.log1p(value)).otherwise(ieee_log(1 + F.col(value)))
    return F.exp(F.sum(log).over(Window.partitionBy(F.lit(0)).orderBy(day)))
