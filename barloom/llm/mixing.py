"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only.

Every row gets a 60-bit hash. Tokens are summed by source and hash bucket; running sums over the buckets show in which
bucket each source's remaining budget ends, and only that bucket is split again, until it holds one hash value. A row is
then in or out by one comparison with its source's threshold: nothing is sorted but bucket sums, and the same rows are
taken on every run and for every partitioning. Thresholds are nested: a larger budget keeps all rows of a smaller one.
Rows equal in all keys have one hash. Where a budget ends among them, their numbers in a written table are a second hash
that is refined in the same way, so that as many of these copies are taken as the budget allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm._tables import drop, saved

HASH_BITS = 60
LEVEL_BITS = 12
#: Sources up to which the thresholds are sent to every task; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 10_000

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0. Blanks become spaces, and a word begins wherever a space is followed by none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(*keys: Column) -> Column:
    """60 bits of the MD5 of the keys; null keys count as empty."""
    joined = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(joined), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(per_source: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Target of each source: by weight, at most ``max_epochs`` times its size, the excess shared again by weight.

    ``per_source`` has source and source_size. Sources in code-point order, null last, take the weights in turn. The
    fixed point is found at once: in the order of size per weight the capped sources are a prefix, and the water level
    behind that prefix is the highest one that fits under the next cap. These windows run
    over one row per source.
    """
    every = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    out = per_source.withColumn("w", F.element_at(cycle, at.cast("int"))).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    out = out.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("w").over(every))
    up_to = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("cap_before", F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))).withColumn("w_before", F.coalesce(F.sum("w").over(up_to), F.lit(0.0)))
    out = out.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
    level = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every)
    return out.withColumn("the_level", level).select("source", "source_size", F.when(F.col("the_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("the_level") * F.col("w"))).alias("target"))


def thresholds(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each source the hash below which its rows get one more repeat, so that their tokens come nearest to ``rest``.

    ``rows`` has source, h, size; ``plan`` has source, rest. Returns source, below (rows with h < below are in) and, where
    the budget ends among several rows of one hash, copies (their number, else 0), edge (that hash) and left (what they may take).
    """
    zero = F.lit(0).cast("long")
    bounds = saved(plan.select("source", "rest", zero.alias("lo"), zero.alias("sum_before"), F.lit(False).alias("single"), zero.alias("copies"), zero.alias("edge")), "mix-bounds")
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        span = 1 << (shift + LEVEL_BITS)
        open_ = bounds.where(~F.col("single")).select(F.col("source").alias("s"), "lo", "rest", "sum_before")
        inside = rows.join(open_, rows.source.eqNullSafe(open_.s) & (F.col("h") >= F.col("lo")) & (F.col("h") < F.col("lo") + span))
        bucket = inside.withColumn("b", F.shiftright("h", shift)).groupBy("source", "rest", "sum_before", "b").agg(F.sum("size").alias("tokens"), F.min("h").alias("h_min"), F.max("h").alias("h_max"), F.count(F.lit(1)).alias("n"))
        run = F.sum("tokens").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
        bucket = bucket.withColumn("before", F.col("sum_before") + F.coalesce(run, F.lit(0)))
        # the bucket in which the budget ends: the first whose tokens reach past it
        ends = bucket.where(F.col("before") + F.col("tokens") > F.col("rest")).groupBy("source", "rest").agg(F.min_by(F.struct(F.col("b"), F.col("before"), F.col("tokens"), F.col("h_min"), F.col("h_max"), F.col("n")), "b").alias("e"))
        one = F.col("e.h_min") == F.col("e.h_max")
        copies = F.when(one & (F.col("e.n") > 1), F.col("e.n")).otherwise(0)
        # a last row comes in if that brings the sum nearer to the budget
        take = (copies == 0) & ((F.col("e.before") + F.col("e.tokens") - F.col("rest")) < (F.col("rest") - F.col("e.before")))
        ends = ends.select("source", "rest", F.when(one, F.col("e.h_min") + take.cast("long")).otherwise(F.shiftleft(F.col("e.b"), shift)).alias("lo"), F.col("e.before").alias("sum_before"), one.alias("single"), copies.alias("copies"), F.col("e.h_min").alias("edge"))
        new = saved(bounds.where("single").unionByName(ends), "mix-bounds")
        drop(bounds)
        bounds = new
        if bounds.where(~F.col("single")).isEmpty():
            break
    return bounds.select("source", F.col("lo").alias("below"), "copies", "edge", (F.col("rest") - F.col("sum_before")).alias("left"))


def mixing_plan(rows: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """One row per source: s, source_size, target, whole (full repeats), below (hashes that get one more), copies, edge and left (see ``thresholds``)."""
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(per_source, weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = saved(plan.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    below = thresholds(rows, plan.where("rest > 0"))
    plan = plan.join(below.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("below", "copies", "edge", "left")])
    return F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan


def hashed_rows(docs: DataFrame, source: str, text: str, keys: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    return saved(docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), row_hash(*[F.col(k) for k in keys]).alias("h")), "mix-rows")


def with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (source, h, size and others) with their source's plan and repeats, how often each is in the mix.

    Copies among which a budget ends are written with a number each; those with numbers below a threshold get one more.
    """
    out = rows.join(plan, rows.source.eqNullSafe(F.col("s")))
    more = F.col("whole") + (F.col("h") < F.col("below")).cast("long")
    if plan.where("copies > 0").isEmpty():
        return out.withColumn("repeats", more)
    tied = (F.col("copies") > 0) & (F.col("h") == F.col("edge"))
    ties = saved(out.where(tied).withColumn("number", F.monotonically_increasing_id()), "mix-ties")
    budgets = plan.where("copies > 0").select(F.col("s").alias("source"), F.col("left").alias("rest"))
    ends = thresholds(ties.select("source", F.col("number").alias("h"), "size"), budgets).select(F.col("source").alias("t"), F.col("below").alias("number_below"))
    ties = ties.join(ends, ties.source.eqNullSafe(F.col("t")), "left")
    ties = ties.withColumn("repeats", F.col("whole") + F.coalesce(F.col("number") < F.col("number_below"), F.lit(False)).cast("long"))
    return out.where(~tied).withColumn("repeats", more).unionByName(ties.drop("number", "t", "number_below"))


def mix_sources(docs: DataFrame, source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id", "text"), weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Repeats of every row so that each source's tokens come near its share of the whole.

    Returns the ``keep`` columns and size, source_size, target, repeats (how often the row is in the mix) and taken
    (size * repeats). A null source is a source of its own; null or empty texts have size 0. Where a budget ends among
    rows equal in all ``keys``, as many of them are taken as it allows, which ones is not defined. A source is repeated whole as often as its target allows and the rest is drawn by hash;
    an empty table gives no rows.
    """
    rows = hashed_rows(docs, source, text, keys, keep)
    out = with_repeats(rows, mixing_plan(rows, weights, max_epochs))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_documents(docs: DataFrame, source: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id", "text"), weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_epochs: int = 3) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it. Sources without any word are kept once."""
    plan = mixing_plan(hashed_rows(docs, source, text, keys, ()), weights, max_epochs)
    names = docs.columns
    own = dict(zip(names, (f"c{i}" for i in range(len(names))), strict=True))  # so that no column of ``docs`` has a name of the plan
    rows = docs.toDF(*own.values())
    rows = rows.withColumns({"source": F.col(own[source]).cast("string"), "size": word_count(F.col(own[text])), "h": row_hash(*[F.col(own[k]) for k in keys])})
    repeats = F.when(F.col("source_size") == 0, 1).otherwise(F.col("repeats"))
    return with_repeats(rows, plan).withColumn("_times", F.explode(F.array_repeat(F.lit(0), repeats.cast("int")))).select(*own.values()).toDF(*names)


def op1_mixing_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), chr(31), coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size * 3 AS DOUBLE) AS cap FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS all_w,
             coalesce(sum(cap) OVER o, 0.0) AS cap_before, coalesce(sum(w) OVER o, 0.0) AS w_before
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - cap_before) / (all_w - w_before) AS level FROM c),
t AS (SELECT source, source_size,
             least(cap, coalesce(max(CASE WHEN level * w <= cap THEN level END) OVER (), 1e300) * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source),
i AS (SELECT *, (rest > 0 AND (before + size <= rest OR (before <= rest AND before + size - rest < rest - before))) AS more FROM q)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN more THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM i
"""
