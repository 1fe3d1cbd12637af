"""Panel operators: latest rows, tails up to a day, forward factors, boards, similarity and interval statistics.

All of them are plans over key-partitioned windows, joins on keys and partial aggregates; dimensions join as they are and
Spark broadcasts them where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str, day: str, n: int = 1) -> DataFrame:
    """The last ``n`` rows of each key with ``back`` (1: newest)."""
    w = Window.partitionBy(key).orderBy(F.desc(day))
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def tail_until(df: DataFrame, ends: DataFrame, key: str, day: str, end: str, n: int) -> DataFrame:
    """The last ``n`` rows of each key that are not after the key's own end."""
    return newest(df.join(ends, key).where(F.col(day) <= F.col(end)), key, day, n)


def next_known(value: Column, key: str, day: str) -> Column:
    """A missing value takes the next later one of its key."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(day).rowsBetween(0, Window.unboundedFollowing))


def forward_adjusted(price: Column, factor: Column, key: str, day: str) -> Column:
    """price * factor / last factor of the key."""
    last = F.last(factor).over(Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return price * factor / last


def histogram_bucket(x: Column) -> Column:
    """Seven return buckets with upper ends -10, -5, -2, 2, 5, 10."""
    out = F.when(x.isNull(), None)
    for i, end in enumerate((-10, -5, -2, 2, 5, 10)):
        out = out.when(x <= end, i)
    return out.otherwise(6)


def board_performance(bars: DataFrame, members: DataFrame, key: str, day: str, board: str) -> DataFrame:
    """Mean pct of each board and day, weighted by market value; members without a positive value don't count."""
    joined = bars.join(members, key).where("pct is not null and market_value > 0")
    value = F.sum(F.col("pct") * F.col("market_value")) / F.sum("market_value")
    return joined.groupBy(day, board).agg(F.round(value, 3).alias("performance"))


def cosine_to_boards(bars: DataFrame, boards: DataFrame, members: DataFrame, key: str, day: str, board: str, least: int = 20) -> DataFrame:
    """Per entity its most similar board: cosine of the daily series over at least ``least`` common days; ties by name.

    A row a day and board goes to every task, so that an entity's rows meet its boards where they are: bars dealt by ``key``
    are neither shuffled nor sorted again once they are repeated for the boards.
    """
    at = F.broadcast(boards.select(F.col(day).alias("_day"), F.col(board).alias("_board"), "performance"))
    mine = bars.where("pct is not null").select(key, day, "pct").join(members, key).join(at, (F.col(day) == F.col("_day")) & (F.col(board) == F.col("_board")))
    norms = F.sqrt(F.sum(F.col("pct") * F.col("pct"))) * F.sqrt(F.sum(F.col("performance") * F.col("performance")))
    g = mine.groupBy(key, board).agg(F.count(F.lit(1)).alias("days"), F.sum(F.col("pct") * F.col("performance")).alias("dot"), norms.alias("norms")).where((F.col("days") >= least) & (F.col("norms") > 0))
    g = g.withColumn("similarity", F.round(F.col("dot") / F.col("norms"), 6))
    return newest_by(g, key, F.desc("similarity"), F.asc(board)).select(key, board, "days", "similarity")


def newest_by(df: DataFrame, key: str, *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def sequence_similarity(events: DataFrame, target: Column, key: str, day: str, rule: str, most_gap: int) -> DataFrame:
    """Similarity of each entity's trigger sequence with the target's: 200 * sum of best event scores / (both counts).

    A target event meets the same rule's events at most ``most_gap`` days away; the score is (most_gap + 1 - gap) /
    (most_gap + 1). Events are joined on (rule, day) after one side is spread over the days it may meet, so that the
    band join is an equi join.
    """
    mine = events.where(target).select(F.col(rule).alias("r"), F.col(day).alias("at"))
    spread = mine.select("r", "at", F.explode(F.sequence(F.lit(-most_gap), F.lit(most_gap))).alias("off")).select("r", "at", F.date_add("at", F.col("off")).alias("d"), F.abs("off").alias("gap"))
    met = events.where(~target).join(spread, (F.col(rule) == F.col("r")) & (F.col(day) == F.col("d")))
    best = met.groupBy(key, "r", "at").agg(F.min("gap").alias("gap"))
    points = best.groupBy(key).agg(F.sum(F.lit(most_gap + 1) - F.col("gap")).alias("points"), F.count(F.lit(1)).alias("matched"))
    own = events.where(~target).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    many = mine.agg(F.count(F.lit(1)).alias("wanted"))  # one row
    out = own.join(points, key).crossJoin(F.broadcast(many))
    return out.select(key, "matched", F.round(200.0 * F.col("points") / (most_gap + 1) / (F.col("n") + F.col("wanted")), 6).alias("similarity"))


def best_interval(df: DataFrame, key: str, day: str, close: str, rows: int) -> DataFrame:
    """Per key the largest gain over ``rows`` consecutive rows, the earliest on ties."""
    w = Window.partitionBy(key).orderBy(day)
    first, start = F.lag(close, rows - 1).over(w), F.lag(day, rows - 1).over(w)
    gains = df.select(key, F.col(day).alias("stop"), start.alias("start"), F.when(first > 0, F.round((F.col(close) / first - 1) * 100, 6)).alias("gain")).where("gain is not null")
    return newest_by(gains, key, F.desc("gain"), F.asc("start"))


def rule_overlap(details: DataFrame, key: str, day: str, rule: str, total: DataFrame) -> DataFrame:
    """Pairs of rules that trigger together: both, Jaccard share and lift n * N / (a * b).

    Rules of one row meet in one array, so no pair of rows is made.
    """
    per = details.groupBy(key, day).agg(F.array_sort(F.collect_set(rule)).alias("rules"))
    pairs = per.select(F.explode("rules").alias("a"), "rules").select("a", F.explode("rules").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    single = details.groupBy(rule).agg(F.count(F.lit(1)).alias("n"))
    out = pairs.join(single.select(F.col(rule).alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col(rule).alias("b"), F.col("n").alias("nb")), "b")
    n = total.agg(F.count(F.lit(1)).alias("rows"))  # one row
    out = out.crossJoin(F.broadcast(n))
    return out.select("a", "b", "both", F.round(F.col("both") / (F.col("na") + F.col("nb") - F.col("both")), 6).alias("jaccard"), F.round(F.col("both") * F.col("rows") / (F.col("na") * F.col("nb")), 6).alias("lift"))


def stock_similarity(stocks: DataFrame, concepts: DataFrame, target: int, key: str = "code") -> DataFrame:
    """Likeness to a target: 40 for its share of concepts, 40 for the industry; with the weight that could be reached."""
    wanted = concepts.where(F.col(key) == target).select("concept")
    size = wanted.agg(F.count(F.lit(1)).alias("wanted"))
    shared = concepts.join(F.broadcast(wanted), "concept").groupBy(key).agg(F.count(F.lit(1)).alias("shared"))
    field = stocks.where(F.col(key) == target).select(F.col("industry").alias("field"))
    out = stocks.where(F.col(key) != target).join(shared, key, "left").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(field))
    part = F.when(F.col("wanted") > 0, 40.0 * F.coalesce("shared", F.lit(0)) / F.col("wanted")).otherwise(0.0)
    return out.select(key, F.round(part + F.when(F.col("industry") == F.col("field"), 40.0).otherwise(0.0), 6).alias("likeness"), (F.when(F.col("wanted") > 0, 40).otherwise(0) + 40).alias("attainable"))


def continuity(expected: DataFrame, found: DataFrame, day: str) -> DataFrame:
    """Days that are expected and missing, and found but not expected."""
    a, b = expected.select(day).distinct(), found.select(day).distinct()
    return a.join(b, day, "left_anti").select(day, F.lit("missing").alias("state")).unionByName(b.join(a, day, "left_anti").select(day, F.lit("unexpected").alias("state")))


def what_if(bars: DataFrame, key: str, day: str, pct: float) -> DataFrame:
    """The bars and one supposed next row per key, ``pct`` percent above its last close."""
    last = newest(bars, key, day).select(key, F.date_add(day, 1).alias(day), (F.col("close") * (1 + pct / 100)).alias("close"), F.lit(True).alias("supposed"))
    return bars.select(key, day, "close", F.lit(False).alias("supposed")).unionByName(last)
