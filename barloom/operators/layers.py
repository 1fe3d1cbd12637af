"""Back-test metrics of rules, ranks and scenes over whole cross-sections: rank correlation, spread, layers, decay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.backtest import TINY, average_rank, daily_ic, mean_std_t, newey_west
from barloom.operators.backtest import spread as half_spread
from barloom.sources.store import kept

#: Places of scene states in their order; states not listed, and none, count as observe.
STATE_RANK = {"fail": 0, "observe": 1, "trigger": 2, "confirm": 3}

#: Means and changes of returns up to this are 0: a sum of doubles depends on the order of its rows.
NOISE = 1e-9


def rule_points(universe: DataFrame, rules: list[str], ahead: str, key: str, day: str, least: int = 1) -> DataFrame:
    """A row per rule and day of at least ``least`` entities: n, hits, avg_score, mean, excess, spread and ic.

    ``universe`` has a row per entity and day with ``details`` (the triggered rules), or with ``scores``, one for each of ``rules``,
    null where it isn't triggered; an entity that a rule doesn't list scores 0 in it. ``spread`` is the mean of the upper half less that of the lower half by (score, entity), ``ic`` the
    Spearman correlation of score and return; both are null where nothing varies. Scores are equal to nine digits.
    Rows without ``ahead`` don't count; a day without hits has null mean, excess, spread and ic.

    Hits are summed by rule, day and score, never sorted or shuffled one by one; a day's zeros are what its sums lack. Ranks
    follow from the sizes of these groups, and so do the halves but for the group in the middle, which they share: its
    entities up to the middle are summed for all rules at once, over the day's entities in their order.
    """
    every = Window.partitionBy(day)
    if "scores" in universe.columns:
        scores = F.col("scores")
    else:
        mine = lambda r: F.filter("details", lambda d: d["rule"] == r)
        scores = F.transform(F.array(*map(F.lit, rules)), lambda r: F.get(F.transform(mine(r), lambda d: F.coalesce(d["score"], F.lit(0.0))), F.lit(0)))
    u = universe.where(F.col(ahead).isNotNull()).select(key, day, ahead, scores.alias("_s"))
    u = u.withColumns({"_n": F.count(F.lit(1)).over(every), "_ry": average_rank(F.col(ahead), day)}).where(F.col("_n") >= least)
    u = kept(u.withColumn("_v", F.transform("_s", lambda x: F.round(x, 9) + 0.0)), "universe")

    n = F.col("_n")
    days = u.groupBy(day).agg(F.first("_n").alias("_n"), F.avg(ahead).alias("_market"), F.sum(ahead).alias("_all"), F.sum(F.col("_ry") * F.col("_ry")).alias("yy"))
    hits = u.select(day, ahead, "_ry", F.posexplode(F.arrays_zip("_s", "_v")).alias("_r", "_x")).select(day, ahead, "_ry", "_r", "_x._s", "_x._v").where("_v is not null")
    g = hits.groupBy(day, "_r", "_v").agg(F.count(F.lit(1)).alias("c"), F.sum(ahead).alias("a"), F.sum("_ry").alias("y"), F.sum("_s").alias("s"))
    part = lambda v, c, a, y, hits, s, h: F.struct(*[x.cast(t).alias(k) for k, t, x in zip(("v", "c", "a", "y", "hits", "s", "h"), ("double", "long", "double", "double", "long", "double", "double"), (v, c, a, y, hits, s, h), strict=True)])
    zero, c, a, y = F.lit(0), F.col("c"), F.col("a"), F.col("y")
    other = F.array(part(F.col("_v"), c, a, y, c, F.col("s"), a), part(zero, -c, -a, -y, zero, zero, zero))
    parts = g.select(day, "_r", F.inline(F.when(F.col("_v") != 0, other).otherwise(F.array(part(zero, zero, zero, zero, c, F.col("s"), a)))))
    whole = days.withColumn("_r", F.explode(F.array(*map(F.lit, range(len(rules)))))).select(day, "_r", F.inline(F.array(part(zero, n, F.col("_all"), n * (n + 1) / 2, zero, zero, zero))))
    groups = whole.unionByName(parts).groupBy(day, "_r", "v").agg(*[F.sum(k).alias(k) for k in ("c", "a", "y", "hits", "s", "h")]).where("c > 0")
    line, all_ = Window.partitionBy(day, "_r").orderBy("v"), Window.partitionBy(day, "_r")
    groups = groups.withColumns({"_n": F.sum("c").over(all_), "_b": F.sum("c").over(line.rowsBetween(Window.unboundedPreceding, 0)) - c})
    half, before = F.floor(n / 2), F.col("_b")
    rank, middle = before + (c + 1) / 2, (before <= half) & (half < before + c)
    of = lambda yes, x: F.coalesce(F.sum(F.when(yes, x)), F.lit(0.0))
    per = groups.groupBy(day, "_r").agg(
        F.sum("hits").alias("hits"), F.sum("s").alias("s"), F.sum("h").alias("h"), F.sum(c * rank * rank).alias("xx"), F.sum(rank * y).alias("xy"), F.min("v").alias("least"), F.max("v").alias("most"),
        of(before + c <= half, a).alias("low"), of(before > half, a).alias("high"), F.max(F.when(middle, F.col("v"))).alias("v"), F.max(F.when(middle, half - before)).alias("m"), F.max(F.when(middle, a)).alias("a"),
    )
    per = kept(per, "rules")

    # the middle groups' entities up to the middle: a running count for each rule
    cuts = per.groupBy(day).agg(F.array_sort(F.collect_list(F.struct("_r", "v", "m"))).alias("_cuts"))  # a row a day
    limits = F.zip_with("_v", "_cuts", lambda v, at: F.when(F.coalesce(v, F.lit(0.0)) == at["v"], at["m"].cast("int")))
    running = Window.partitionBy(day).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    seen = u.select(key, day, ahead, "_n", "_v").repartition(day).join(F.broadcast(cuts), day).select(key, day, ahead, (n % 2).alias("_odd"), limits.alias("_m"))
    seen = seen.select(key, day, ahead, "_odd", *[F.get("_m", F.lit(i)).alias(f"_m{i}") for i in range(len(rules))])
    seen = seen.select(day, ahead, "_odd", *[f"_m{i}" for i in range(len(rules))], *[F.count(f"_m{i}").over(running).alias(f"_c{i}") for i in range(len(rules))])
    until = lambda i, more: of(F.col(f"_m{i}").isNotNull() & (F.col(f"_c{i}") <= F.col(f"_m{i}") + more), F.col(ahead))
    sums = seen.groupBy(day).agg(F.array(*[F.struct(until(i, 0).alias("p1"), until(i, F.col("_odd")).alias("p2")) for i in range(len(rules))]).alias("_p"))
    sums = sums.select(F.col(day).alias("_day"), F.posexplode("_p").alias("_rule", "_p")).select("_day", "_rule", "_p.*")

    out = days.select(day, "_n", "_market", "yy").join(per, day).join(sums, (F.col(day) == F.col("_day")) & (F.col("_r") == F.col("_rule")))
    hit, centre = F.col("hits") > 0, n * (n + 1) * (n + 1) / 4
    spread = (F.col("high") + F.col("a") - F.col("p2") - F.col("low") - F.col("p1")) / half
    xx, yy, xy = F.col("xx") - centre, F.col("yy") - centre, F.col("xy") - centre
    ic = F.when(hit & (xx > TINY) & (yy > TINY), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), xy / F.sqrt(xx) / F.sqrt(yy))))
    mean = F.when(hit, F.col("h") / F.col("hits"))
    return out.select(
        F.get(F.array(*map(F.lit, rules)), F.col("_r")).alias("rule"), day, n.alias("n"), "hits", (F.col("s") / n).alias("avg_score"), mean.alias("mean"), (mean - F.col("_market")).alias("excess"),
        F.when(hit & (n >= 2) & (F.col("most") - F.col("least") >= TINY), spread).alias("spread"), ic.alias("ic"),
    )


def summary(points: DataFrame, by: str, day: str, lags: int | None = None) -> DataFrame:
    """Per ``by``: days, spread_mean, ic_mean, ic_std, icir and ic_t, the plain t or the one with Bartlett weights over ``lags``."""
    g = points.groupBy(by).agg(F.count(F.lit(1)).alias("days"), F.avg("spread").alias("spread_mean"))
    ic = mean_std_t(points, "ic", by).select(F.col(by).alias("_a"), F.col("mean").alias("ic_mean"), F.col("std").alias("ic_std"), F.col("ir").alias("icir"), F.col("t").alias("ic_t"))
    out = g.join(ic, F.col(by) == F.col("_a"), "left").drop("_a")
    if lags is None:
        return out
    t = newey_west(points, "ic", day, by, lags).select(F.col(by).alias("_b"), F.col("t").alias("ic_t"))
    return out.drop("ic_t").join(t, F.col(by) == F.col("_b"), "left").drop("_b")


def rank_points(universe: DataFrame, score: str, ahead: str, key: str, day: str, least: int = 2) -> DataFrame:
    """Per day: n, spread and ic of a score; ``summary`` condenses them."""
    ic = daily_ic(universe, score, ahead, day, least=least)
    return ic.join(half_spread(universe, score, ahead, key, day), day).select(day, "n", "spread", "ic")


def rank_layers(universe: DataFrame, layer: Column, score: str, ahead: str, change: str, day: str) -> DataFrame:
    """Per layer: days, samples, means of the daily mean score and return, and the mean ``change`` over its samples."""
    daily = universe.withColumn("layer", layer).groupBy(day, "layer").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("s"), F.avg(ahead).alias("m"), F.sum(change).alias("c"), F.count(change).alias("k"))
    return daily.groupBy("layer").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("samples"), F.avg("s").alias("avg_score"), F.avg("m").alias("mean"), F.try_divide(F.sum("c"), F.sum("k")).alias("er_change"))


def scene_points(states: DataFrame, ahead: str, day: str, least: int = 2) -> DataFrame:
    """Per scene and day: n, the mean return of its highest state less that of its lowest (null with one state), and ic of the states' places.

    Only rows of the scene count. Null and other states have the place of observe and come after it by name.
    """
    name = F.coalesce("scene_stage", F.lit("unknown"))
    place = F.coalesce(F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv])[name], F.lit(STATE_RANK["observe"]))
    rows = states.where(F.col(ahead).isNotNull()).withColumns({"_name": name, "_place": place})
    ic = daily_ic(rows, "_place", ahead, "scene", day, least=least)
    means = rows.groupBy("scene", day, "_place", "_name").agg(F.avg(ahead).alias("m"))
    order = F.struct("_place", "_name")
    ends = means.groupBy("scene", day).agg(F.when(F.count(F.lit(1)) >= 2, F.max_by("m", order) - F.min_by("m", order)).alias("spread"))
    return ic.join(ends, ["scene", day]).select("scene", day, "n", "spread", "ic")


def decay_status(points: DataFrame, rule: str, day: str, windows: tuple[int, ...] = (20, 40, 60), least_prior: int = 10) -> DataFrame:
    """Recent against earlier directional excess of every rule and window, with Welch's t and a status.

    The direction is the sign of the rule's summed mean scores. A window with too few recent or earlier days is insufficient;
    else a fall is significant_decay (t at most -2), decay (recent mean below 0) or weakening, and what doesn't fall is
    weak (recent mean below 0), improving or stable.
    """
    sign = F.when(F.sum("avg_score").over(Window.partitionBy(rule)) < 0, -1.0).otherwise(1.0)
    r = points.withColumn("v", F.col("excess") * sign).where("v is not null")
    r = r.select(rule, "v", F.row_number().over(Window.partitionBy(rule).orderBy(F.desc(day))).alias("back"))
    r = r.withColumn("span", F.explode(F.array(*map(F.lit, windows))))
    late, early = (F.when(F.col("back") <= F.col("span"), F.col("v")), F.when(F.col("back") > F.col("span"), F.col("v")))
    g = r.groupBy(rule, "span").agg(F.count(late).alias("recent_days"), F.count(early).alias("prior_days"), F.avg(late).alias("a1"), F.avg(early).alias("a0"), F.var_samp(late).alias("v1"), F.var_samp(early).alias("v0"))
    enough = (F.col("recent_days") == F.col("span")) & (F.col("prior_days") >= least_prior)
    error = F.sqrt(F.col("v1") / F.col("recent_days") + F.col("v0") / F.col("prior_days"))
    change = F.col("a1") - F.col("a0")
    g = g.select(rule, "span", "recent_days", "prior_days", *[F.when(enough, x).alias(c) for c, x in (("recent", F.col("a1")), ("prior", F.col("a0")), ("change", change), ("t", F.when(error > TINY, change / error)))])
    falls, low = F.col("change") < -NOISE, F.col("recent") < -NOISE
    status = F.when(F.col("change").isNull(), "insufficient").when(falls & (F.col("t") <= -2), "significant_decay").when(falls & low, "decay").when(falls, "weakening").when(low, "weak").when(F.col("change") > NOISE, "improving").otherwise("stable")
    return g.withColumn("status", status)
