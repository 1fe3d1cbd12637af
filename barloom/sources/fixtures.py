"""Panel views over the test tables: what stands for bars, series, dimensions and seats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.semantics import div


#: Lines that one task groups, sorts and scores.
TASK_ROWS = 300_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dealt(df: DataFrame, rows: int, by: str) -> DataFrame:
    """``df`` dealt by a column, to a task for every TASK_ROWS of ``rows``.

    A task's sorts hold its rows: more rows make more tasks, not larger ones, which merging small shuffle blocks would.
    """
    tasks = rows // TASK_ROWS
    return df.repartition(tasks, by) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(by)


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, i, y, x, p, c): events of each user in order; x has nulls, p is a period by row, c a condition."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("i"), F.col("value").alias("y"), "event_type")
    p = F.when(F.col("i") % 13 != 0, (F.col("i") % 7).cast("double"))
    return e.select("u", "i", "y", F.when(F.col("i") % 11 != 0, F.col("y")).alias("x"), p.alias("p"), (F.col("y") > 50).alias("c"))


EVENT_SERIES = "s AS (SELECT user_id AS u, event_id AS i, value AS y, CASE WHEN event_id % 11 <> 0 THEN value END AS x, CASE WHEN event_id % 13 <> 0 THEN CAST(event_id % 7 AS DOUBLE) END AS p, value > 50 AS c FROM events)"


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars per supplier: code, day, low, high, volume, amount, turnover, close, pre_close, pct."""
    # sums of cents are exact, as those of decimals are, and stay in longs
    dec = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) / 100
    # dealt by code first, so that the grouping and every window by code that follows need no further shuffle
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("day"), "l_extendedprice", "l_quantity", "l_discount")
    lines = dealt(lines, lines.count(), "code")
    g = lines.groupBy("code", "day").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), dec("l_quantity").alias("volume"), dec("l_extendedprice").alias("amount"), (F.max("l_discount") * 100).alias("turnover"))
    g = g.withColumn("close", div(F.col("amount"), F.col("volume")))
    g = g.withColumn("pre_close", F.lag("close").over(Window.partitionBy("code").orderBy("day")))
    return g.withColumn("pct", F.when(F.col("pre_close") > 0, (F.col("close") / F.col("pre_close") - 1) * 100))


BARS = """g AS (SELECT l_suppkey AS code, CAST(l_shipdate AS DATE) AS day, min(l_extendedprice) AS low, max(l_extendedprice) AS high,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, max(l_discount) * 100 AS turnover
  FROM lineitem GROUP BY ALL),
g2 AS (SELECT *, CASE WHEN abs(volume) < 1e-12 THEN 0.0 ELSE amount / volume END AS close FROM g),
g3 AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY day) AS pre_close FROM g2),
bars AS MATERIALIZED (SELECT *, CASE WHEN pre_close > 0 THEN (close / pre_close - 1) * 100 END AS pct FROM g3)"""


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension: code, name, industry, area, market_value."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("n_name").alias("industry"), F.col("r_name").alias("area"), F.col("s_acctbal").alias("market_value"))


STOCKS = "stocks AS (SELECT s_suppkey AS code, s_name AS name, n_name AS industry, r_name AS area, s_acctbal AS market_value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-value dimension: code, concept (brands that a supplier ships)."""
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    return l.join(p, l.l_partkey == p.p_partkey).select(F.col("l_suppkey").alias("code"), F.col("p_brand").alias("concept")).distinct()


CONCEPTS = "concepts AS (SELECT DISTINCT l_suppkey AS code, p_brand AS concept FROM lineitem JOIN part ON l_partkey = p_partkey)"
