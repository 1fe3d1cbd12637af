"""Joins, aggregates, page queries and transforms over the bars, scores and dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.series import Series
from barloom.operators import panel as op
from barloom.operators import scoring as sc
from barloom.queries.scoring import _RULES, details, stages, total_panel
from barloom.sources.fixtures import BARS, CONCEPTS, STOCKS, concepts, dealt, read, stocks, supplier_bars
from barloom.sources.store import kept

QUERIES: dict = {}
ORACLE: dict = {}
RANKED = f"{_RULES}, rk AS MATERIALIZED (SELECT code, day, close, pct, j, total, CAST(row_number() OVER (PARTITION BY day ORDER BY total DESC, j ASC NULLS LAST, code) AS INT) AS rank FROM tot)"


def by_code():
    return Window.partitionBy("code").orderBy("day")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def ranked(spark, d):
    return sc.rank_days(total_panel(spark, d), "code", "day", "total", "j")


def ranked_whole(spark, d):
    """``ranked`` for queries that take every row with its details: days are dealt by the number of lines."""
    return sc.rank_days(dealt(total_panel(spark, d), read(spark, d, "lineitem").count(), "day"), "code", "day", "total", "j")


@query(f"WITH {RANKED} SELECT d.code, d.day, d.rule, d.score, rk.rank, max(rk.rank) OVER (PARTITION BY d.day) AS max_rank FROM d JOIN rk ON d.code = rk.code AND d.day = rk.day")
def j02_contribution_join(spark, d):
    joined = sc.rule_details(ranked_whole(spark, d), "code", "day", "rank")
    return joined.select("code", "day", "rule", "score", "rank", F.max("rank").over(Window.partitionBy("day")).alias("max_rank"))


@query(f"WITH {RANKED}, mq AS (SELECT day, max(rank) AS top FROM rk GROUP BY day) SELECT rule, round(sum(score * (top + 1 - rank) / top), 4) AS total, round(sum(score * (top + 1 - rank) / top) / count(DISTINCT d.day), 4) AS per_day, round(avg(score * (top + 1 - rank) / top), 4) AS per_trigger FROM d JOIN rk ON d.code = rk.code AND d.day = rk.day JOIN mq ON d.day = mq.day GROUP BY rule")
def b19_contribution(spark, d):
    full = ranked_whole(spark, d).withColumn("top", F.max("rank").over(Window.partitionBy("day")))
    value = F.col("score") * (F.col("top") + 1 - F.col("rank")) / F.col("top")
    g = sc.rule_details(full, "code", "day", "rank", "top").withColumn("v", value)
    per = g.groupBy("rule", "day").agg(F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")).groupBy("rule").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("days"), F.sum("n").alias("n"))
    return per.select("rule", F.round("s", 4).alias("total"), F.round(F.col("s") / F.col("days"), 4).alias("per_day"), F.round(F.col("s") / F.col("n"), 4).alias("per_trigger"))


@query(f"WITH {_RULES}, a AS (SELECT day, count(*) AS n FROM d GROUP BY day), o AS (SELECT CAST(sum(n) AS BIGINT) AS total, max(n) AS most FROM a) SELECT day, n, total, most, round(100.0 * n / total, 6) AS share FROM a CROSS JOIN o")
def j05_cross_overall(spark, d):
    daily = details(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    overall = daily.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    return daily.crossJoin(F.broadcast(overall)).select("day", "n", "total", "most", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("share"))


@query(f"WITH {BARS}, v(code, label) AS (VALUES (1, 'a'), (3, 'b'), (7, 'c')) SELECT CAST(bars.code AS BIGINT) AS code, label, day, round(close, 6) AS close FROM bars JOIN v ON bars.code = v.code")
def j06_values(spark, d):
    wanted = spark.createDataFrame([(1, "a"), (3, "b"), (7, "c")], "code long, label string")
    return supplier_bars(spark, d).join(F.broadcast(wanted), "code").select("code", "label", "day", F.round("close", 6).alias("close"))


@query(f"WITH {BARS} SELECT code, max(day) AS day, round(arg_max(close, day), 6) AS close FROM bars GROUP BY code")
def j07_latest_row(spark, d):
    return supplier_bars(spark, d).groupBy("code").agg(F.max("day").alias("day"), F.round(F.max_by("close", "day"), 6).alias("close"))


_ENDS = "e AS (SELECT code, max(day) - CAST(30 * (code % 5) AS INT) AS stop FROM bars GROUP BY code)"


@query(f"WITH {BARS}, {_ENDS} SELECT code, day, CAST(back AS INT) AS back FROM (SELECT bars.code, day, row_number() OVER (PARTITION BY bars.code ORDER BY day DESC) AS back FROM bars JOIN e ON bars.code = e.code AND day <= stop) WHERE back <= 5")
def j09_tail_nonequi(spark, d):
    bars = supplier_bars(spark, d)
    ends = bars.groupBy("code").agg(F.max("day").alias("stop")).withColumn("stop", F.date_sub("stop", (F.col("code") % 5 * 30).cast("int")))
    return op.tail_until(bars, ends, "code", "day", "stop", 5).select("code", "day", "back")


_FACTOR = "CASE WHEN dayofyear(day) % 7 = 0 THEN 1 + code * 0.01 END"


@query(f"WITH {BARS} SELECT code, day, round(first_value({_FACTOR} IGNORE NULLS) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6)::DOUBLE AS factor FROM bars")
def j10_asof_factor(spark, d):
    f = F.when(F.dayofyear("day") % 7 == 0, (1 + F.col("code") * 0.01).cast("double"))
    return supplier_bars(spark, d).select("code", "day", F.round(op.next_known(f, "code", "day"), 6).alias("factor"))


@query(f"""WITH {_RULES}, ev AS (SELECT code, day, rule FROM d ), t AS (SELECT rule, day FROM ev WHERE code = 1),
b AS (SELECT ev.code, t.rule, t.day, min(abs(ev.day - t.day)) AS gap FROM ev JOIN t ON ev.rule = t.rule AND abs(ev.day - t.day) <= 2 WHERE ev.code <> 1 GROUP BY ALL),
p AS (SELECT code, sum(3 - gap) AS points, count(*) AS matched FROM b GROUP BY code), n AS (SELECT code, count(*) AS n FROM ev WHERE code <> 1 GROUP BY code)
SELECT p.code, matched, round(200.0 * points / 3 / (n + (SELECT count(*) FROM t)), 6)::DOUBLE AS similarity FROM p JOIN n ON p.code = n.code""")
def j17_band_join(spark, d):
    ev = details(spark, d).select("code", "day", "rule")
    return op.sequence_similarity(ev, F.col("code") == 1, "code", "day", "rule", 2)


_HELD = "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 50"


@query(f"SELECT s_suppkey AS code, s_name AS name FROM supplier WHERE s_suppkey IN ({_HELD})")
def j18_semi(spark, d):
    return read(spark, d, "supplier").join(read(spark, d, "lineitem").where("l_quantity >= 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def j18_anti(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(f"WITH {BARS} SELECT day, count(*) FILTER (pct > 0) AS up, count(*) FILTER (pct < 0) AS down, count(*) FILTER (pct IS NULL) AS unknown, CAST(sum(CASE WHEN pct > 5 THEN volume ELSE 0 END) AS DOUBLE) AS strong FROM bars GROUP BY day")
def a02_conditional(spark, d):
    return supplier_bars(spark, d).groupBy("day").agg(F.count_if(F.col("pct") > 0).alias("up"), F.count_if(F.col("pct") < 0).alias("down"), F.count_if(F.col("pct").isNull()).alias("unknown"), F.sum(F.when(F.col("pct") > 5, F.col("volume")).otherwise(0.0)).alias("strong"))


@query("SELECT c_mktsegment AS seat, count(*) FILTER (o_orderstatus = 'O') AS buys, count(*) FILTER (o_orderstatus = 'F') AS sells, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O') AS DOUBLE) AS bought FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def a03_filter(spark, d):
    seats = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    side = F.col("o_orderstatus")
    return seats.groupBy(F.col("c_mktsegment").alias("seat")).agg(F.count_if(side == "O").alias("buys"), F.count_if(side == "F").alias("sells"), F.sum(F.when(side == "O", F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("bought"))


@query("SELECT l_suppkey AS code, count(DISTINCT (CAST(l_shipdate AS DATE), l_returnflag)) AS pairs FROM lineitem GROUP BY l_suppkey")
def a04_distinct_pair(spark, d):
    return read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.countDistinct(F.to_date("l_shipdate"), "l_returnflag").alias("pairs"))


@query(f"WITH {BARS} SELECT day, round(quantile_cont(pct, 0.5), 6) AS median, round(quantile_cont(close, 0.5), 6) AS median_close FROM bars GROUP BY day")
def a05_median(spark, d):
    return supplier_bars(spark, d).groupBy("day").agg(F.round(F.percentile("pct", 0.5), 6).alias("median"), F.round(F.percentile("close", 0.5), 6).alias("median_close"))


@query(f"WITH {CONCEPTS} SELECT code, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts FROM concepts GROUP BY code")
def a06_string_agg(spark, d):
    return concepts(spark, d).groupBy("code").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"))


@query(f"WITH {_RULES}, a AS (SELECT day, code, count(*) AS n, sum(score) AS s FROM d GROUP BY ALL), b AS (SELECT day, count(*) AS codes, avg(n) AS per_code, avg(s) AS score FROM a GROUP BY day) SELECT count(*) AS days, round(avg(codes), 6) AS codes, round(avg(per_code), 6) AS per_code, round(avg(score), 6) AS score FROM b")
def a07_two_level(spark, d):
    a = details(spark, d).groupBy("day", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    b = a.groupBy("day").agg(F.count(F.lit(1)).alias("codes"), F.avg("n").alias("per_code"), F.avg("s").alias("score"))
    return b.agg(F.count(F.lit(1)).alias("days"), *[F.round(F.avg(c), 6).alias(c) for c in ("codes", "per_code", "score")])


_BOARD = f"{BARS}, {STOCKS}, {CONCEPTS}, mem AS (SELECT c.code, concept, market_value FROM concepts c JOIN stocks s ON c.code = s.code), bp AS (SELECT day, concept, round(sum(pct * market_value) / sum(market_value), 3) AS performance FROM bars JOIN mem ON bars.code = mem.code WHERE pct IS NOT NULL AND market_value > 0 GROUP BY ALL)"


def members(spark, d):
    return concepts(spark, d).join(stocks(spark, d), "code").select("code", "concept", "market_value")


@query(f"WITH {_BOARD} SELECT * FROM bp")
def a08_weighted_board(spark, d):
    return op.board_performance(supplier_bars(spark, d), members(spark, d), "code", "day", "concept")


@query(f"WITH {BARS} SELECT CASE WHEN pct <= -10 THEN 0 WHEN pct <= -5 THEN 1 WHEN pct <= -2 THEN 2 WHEN pct <= 2 THEN 3 WHEN pct <= 5 THEN 4 WHEN pct <= 10 THEN 5 ELSE 6 END AS bucket, count(*) AS n FROM bars WHERE pct IS NOT NULL GROUP BY bucket")
def a13_histogram(spark, d):
    return supplier_bars(spark, d).where("pct is not null").groupBy(op.histogram_bucket(F.col("pct")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_BOARD}, gq AS (SELECT mem.code, mem.concept, count(*) AS days, round(sum(pct * performance) / (sqrt(sum(pct * pct)) * sqrt(sum(performance * performance))), 6) AS similarity FROM mem JOIN bars ON bars.code = mem.code AND pct IS NOT NULL JOIN bp ON bp.day = bars.day AND bp.concept = mem.concept GROUP BY ALL HAVING count(*) >= 20) SELECT code, concept, days, similarity FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY similarity DESC, concept) AS n FROM gq) WHERE n = 1")
def a17_cosine(spark, d):
    bars, mem = supplier_bars(spark, d), kept(members(spark, d), "members")
    return op.cosine_to_boards(bars, op.board_performance(bars, mem, "code", "day", "concept"), mem.select("code", "concept"), "code", "day", "concept")


@query(f"WITH {_RULES}, p AS (SELECT x.rule AS a, y.rule AS b, count(*) AS n FROM d x JOIN d y ON x.code = y.code AND x.day = y.day AND x.rule < y.rule GROUP BY ALL), s AS (SELECT rule, count(*) AS n FROM d GROUP BY rule) SELECT p.a, p.b, p.n AS both, round(p.n / (x.n + y.n - p.n), 6) AS jaccard, round(p.n * (SELECT count(*) FROM tot) / (x.n * y.n), 6) AS lift FROM p JOIN s x ON p.a = x.rule JOIN s y ON p.b = y.rule")
def a18_rule_overlap(spark, d):
    return op.rule_overlap(details(spark, d), "code", "day", "rule", supplier_bars(spark, d).select("code", "day"))


@query(f"WITH {BARS} SELECT code, day, CAST(n AS INT) AS back, round(close, 6) AS close FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM bars) WHERE n <= 3")
def n02_latest(spark, d):
    return op.newest(supplier_bars(spark, d), "code", "day", 3).select("code", "day", "back", F.round("close", 6).alias("close"))


@query(f"WITH {BARS} SELECT code, day, round(lag(close, 1) OVER w, 6) AS l1, round(lag(close, 2) OVER w, 6) AS l2, round(lag(close, 5) OVER w, 6) AS l5 FROM bars WINDOW w AS (PARTITION BY code ORDER BY day)")
def n04_lags(spark, d):
    return supplier_bars(spark, d).select("code", "day", *[F.round(F.lag("close", k).over(by_code()), 6).alias(f"l{k}") for k in (1, 2, 5)])


@query(f"WITH {BARS} SELECT code, day, CASE WHEN count(pct) OVER w = 5 THEN round(sum(pct) OVER w, 5) END AS ahead FROM bars WINDOW w AS (PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)")
def n05_forward_frame(spark, d):
    w = by_code().rowsBetween(1, 5)
    return supplier_bars(spark, d).select("code", "day", F.when(F.count("pct").over(w) == 5, F.round(F.sum("pct").over(w), 5)).alias("ahead"))


@query(f"WITH {RANKED} SELECT day, code, rank FROM rk WHERE rank <= 3")
def n07_topk_group(spark, d):
    return ranked(spark, d).where("rank <= 3").select("day", "code", "rank")


@query(f"WITH {_RULES} SELECT code, day, 'rule' AS kind, rule AS name, score, CAST(NULL AS VARCHAR) AS scene_stage FROM d UNION ALL SELECT code, day, 'scene', scene, NULL, scene_stage FROM st WHERE scene_stage IS NOT NULL")
def t06_union_padded(spark, d):
    rules = details(spark, d).select("code", "day", F.lit("rule").alias("kind"), F.col("rule").alias("name"), "score")
    scenes = stages(spark, d).where("scene_stage is not null").select("code", "day", F.lit("scene").alias("kind"), F.col("scene").alias("name"), "scene_stage")
    return rules.unionByName(scenes, allowMissingColumns=True)


@query(f"WITH {RANKED}, {STOCKS}, n AS (SELECT *, lag(rank) OVER w AS rank_before, lead(close) OVER w AS next_close FROM rk WINDOW w AS (PARTITION BY code ORDER BY day)) SELECT n.code, name, industry, day, rank, CAST(rank_before AS INT) AS rank_before, round(total, 6) AS total, CASE WHEN close > 0 THEN round((next_close / close - 1) * 100, 6) END AS after FROM n JOIN stocks ON n.code = stocks.code WHERE rank <= 10")
def g01_overview(spark, d):
    n = ranked(spark, d).withColumns({"rank_before": F.lag("rank").over(by_code()), "next_close": F.lead("close").over(by_code())}).where("rank <= 10")
    after = F.when(F.col("close") > 0, F.round((F.col("next_close") / F.col("close") - 1) * 100, 6))
    return n.join(stocks(spark, d), "code").select("code", "name", "industry", "day", "rank", "rank_before", F.round("total", 6).alias("total"), after.alias("after"))


_SR = "CAST(row_number() OVER (PARTITION BY st.day, scene ORDER BY CASE scene_stage WHEN 'confirm' THEN 3 WHEN 'trigger' THEN 2 WHEN 'observe' THEN 1 WHEN 'fail' THEN 0 ELSE -1 END DESC, confirm_strength DESC, confirm_strength - risk_intensity DESC, abs(stage_score) - abs(risk_score) DESC, total DESC, st.code) AS INT)"


@query(f"WITH {_RULES}, sr AS (SELECT st.code, st.day, scene, scene_stage, total, {_SR} AS scene_rank FROM st JOIN tot ON st.code = tot.code AND st.day = tot.day) SELECT * FROM sr WHERE scene_rank <= 5")
def g02_scene_overview(spark, d):
    return sc.rank_scenes(stages(spark, d), "code", "day").where("scene_rank <= 5").select("code", "day", "scene", "scene_stage", "total", "scene_rank")


@query(f"WITH {_RULES}, gq AS (SELECT day, rule, count(*) AS n, sum(score) AS s, quantile_cont(score, 0.5) AS median FROM d WHERE abs(score) > 1e-12 GROUP BY ALL) SELECT day, rule, n, round(s, 6) AS total, round(median, 6) AS median, round(100.0 * n / sum(n) OVER (PARTITION BY day), 6) AS share FROM gq")
def g03_heatmap(spark, d):
    g = details(spark, d).where("abs(score) > 1e-12").groupBy("day", "rule").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.percentile("score", 0.5).alias("median"))
    return g.select("day", "rule", "n", F.round("s", 6).alias("total"), F.round("median", 6).alias("median"), F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("day")), 6).alias("share"))


@query(f"WITH {_RULES}, gq AS (SELECT day, scene, coalesce(scene_stage, 'none') AS stage, count(*) AS n FROM st GROUP BY ALL) SELECT day, scene, stage, n, round(n / sum(n) OVER (PARTITION BY day, scene), 6) AS ratio FROM gq")
def g04_stage_ratio(spark, d):
    g = stages(spark, d).groupBy("day", "scene", F.coalesce("scene_stage", F.lit("none")).alias("stage")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("day", "scene")), 6))


@query(f"WITH {RANKED}, dx AS MATERIALIZED (SELECT code, day, rule, score FROM d) SELECT dx.day, dx.code, dx.score, rank FROM dx JOIN rk ON dx.code = rk.code AND dx.day = rk.day WHERE rule = 'joined' AND abs(score) > 1e-12")
def g05_triggered(spark, d):
    every = sc.rule_details(ranked_whole(spark, d), "code", "day", "rank")
    return every.where((F.col("rule") == "joined") & (F.abs("score") > 1e-12)).select("day", "code", "score", "rank")


@query(f"WITH {_BOARD}, n AS (SELECT concept, count(*) AS members FROM concepts GROUP BY concept) SELECT bp.concept, members, round(avg(performance), 6) AS mean FROM bp JOIN n ON bp.concept = n.concept WHERE members >= 2 GROUP BY ALL")
def g07b_concept_interval(spark, d):
    n = concepts(spark, d).groupBy("concept").agg(F.count(F.lit(1)).alias("members")).where("members >= 2")
    return a08_weighted_board(spark, d).groupBy("concept").agg(F.round(F.avg("performance"), 6).alias("mean")).join(n, "concept").select("concept", "members", "mean")


@query(f"WITH {BARS}, {STOCKS}, a AS (SELECT code, avg(pct) AS p FROM bars WHERE pct IS NOT NULL GROUP BY code) SELECT industry, count(*) AS members, round(avg(p), 6) AS mean FROM a JOIN stocks ON a.code = stocks.code GROUP BY industry")
def g07c_industry(spark, d):
    a = supplier_bars(spark, d).where("pct is not null").groupBy("code").agg(F.avg("pct").alias("p"))
    return a.join(stocks(spark, d), "code").groupBy("industry").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg("p"), 6).alias("mean"))


@query(f"WITH {BARS}, gq AS (SELECT code, round((arg_max(close, day) / arg_min(close, day) - 1) * 100, 6) AS gain, count(*) AS n FROM bars WHERE close > 0 GROUP BY code) SELECT code, gain, n FROM gq ORDER BY gain DESC, code LIMIT 20")
def g07d_gain(spark, d):
    g = supplier_bars(spark, d).where("close > 0").groupBy("code").agg(F.round((F.max_by("close", "day") / F.min_by("close", "day") - 1) * 100, 6).alias("gain"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("gain"), "code").limit(20)


@query(f"WITH {BARS}, gq AS (SELECT code, day AS stop, lag(day, 2) OVER w AS start, CASE WHEN lag(close, 2) OVER w > 0 THEN round((close / lag(close, 2) OVER w - 1) * 100, 6) END AS gain FROM bars WINDOW w AS (PARTITION BY code ORDER BY day)) SELECT code, stop, start, gain FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY gain DESC, start) AS n FROM gq WHERE gain IS NOT NULL) WHERE n = 1")
def g07e_sub_interval(spark, d):
    return op.best_interval(supplier_bars(spark, d), "code", "day", "close", 3)


_NET = "CAST(sum(CAST(CASE WHEN pct > 0 THEN amount WHEN pct < 0 THEN -amount ELSE 0 END AS DECIMAL(18,2))) AS DOUBLE)"


@query(f"WITH {BARS}, {CONCEPTS}, gq AS (SELECT concept, {_NET} AS net FROM bars JOIN concepts ON bars.code = concepts.code GROUP BY concept) SELECT concept, net, CASE WHEN net > 0 THEN 'in' ELSE 'out' END AS flow FROM gq WHERE net <> 0")
def g07h_money_flow(spark, d):
    net = F.when(F.col("pct") > 0, F.col("amount")).when(F.col("pct") < 0, -F.col("amount")).otherwise(0.0)
    g = supplier_bars(spark, d).join(concepts(spark, d), "code").groupBy("concept").agg(F.sum(net.cast("decimal(18,2)")).cast("double").alias("net")).where("net <> 0")
    return g.withColumn("flow", F.when(F.col("net") > 0, "in").otherwise("out"))


@query(f"WITH {RANKED} SELECT code, day, rank, count(*) OVER (PARTITION BY day) AS of FROM rk")
def g10b_rank_history(spark, d):
    return ranked(spark, d).select("code", "day", "rank", F.count(F.lit(1)).over(Window.partitionBy("day")).alias("of"))


@query(f"WITH {_RULES}, ax AS (SELECT day, row_number() OVER (ORDER BY day) AS no FROM (SELECT DISTINCT day FROM tot)), hq AS (SELECT code, rule, max(day) AS last_hit FROM d GROUP BY ALL) SELECT code, rule, last_hit, CAST((SELECT max(no) FROM ax) - no AS INT) AS lag FROM hq JOIN ax ON ax.day = last_hit")
def g10d_last_hit_lag(spark, d):
    days = total_panel(spark, d).select("day").distinct()
    axis = days.withColumn("lag", F.row_number().over(Window.orderBy(F.desc("day"))) - 1)  # one row per day
    hits = details(spark, d).groupBy("code", "rule").agg(F.max("day").alias("day"))
    return hits.join(axis, "day").select("code", "rule", F.col("day").alias("last_hit"), "lag")


@query("SELECT c_mktsegment AS seat, count(*) AS rows, count(DISTINCT (CAST(o_orderdate AS DATE), o_orderpriority)) AS listings, count(DISTINCT o_custkey) AS stocks, round(avg(o_totalprice), 4) AS mean, max(CAST(o_orderdate AS DATE)) AS last_day FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def g11c_seat_stats(spark, d):
    seats = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).withColumn("day", F.to_date("o_orderdate"))
    return seats.groupBy(F.col("c_mktsegment").alias("seat")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("day", "o_orderpriority").alias("listings"), F.countDistinct("o_custkey").alias("stocks"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.max("day").alias("last_day"))


@query("WITH a AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem), b AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, 'missing' AS state FROM a WHERE day NOT IN (SELECT day FROM b) UNION ALL SELECT day, 'unexpected' FROM b WHERE day NOT IN (SELECT day FROM a)")
def g15_continuity(spark, d):
    return op.continuity(read(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day")), read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")), "day")


@query(f"WITH {BARS} SELECT code, count(*) AS rows, round((arg_max(close, day) / arg_min(close, day) - 1) * 100, 6) AS change, round(sum(turnover), 4) AS turnover, max(high) AS high, min(low) AS low, round((max(high) / min(low) - 1) * 100, 6) AS amplitude FROM bars GROUP BY code")
def g19_interval(spark, d):
    return supplier_bars(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("rows"), F.round((F.max_by("close", "day") / F.min_by("close", "day") - 1) * 100, 6).alias("change"), F.round(F.sum("turnover"), 4).alias("turnover"), F.max("high").alias("high"), F.min("low").alias("low"), F.round((F.max("high") / F.min("low") - 1) * 100, 6).alias("amplitude"))


@query("SELECT p_partkey, CASE WHEN upper(p_type) LIKE '%ECONOMY%' THEN 'special' WHEN p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%' THEN 'growth' WHEN p_brand LIKE 'Brand#3%' OR p_brand LIKE 'Brand#4%' THEN 'main' ELSE 'other' END AS board FROM part")
def p03_board(spark, d):
    brand = F.col("p_brand")
    first = lambda *a: F.coalesce(F.substring(brand, 1, 7).isin(*[f"Brand#{x}" for x in a]), F.lit(False))
    return read(spark, d, "part").select("p_partkey", F.when(F.contains(F.upper("p_type"), F.lit("ECONOMY")), "special").when(first(1, 2), "growth").when(first(3, 4), "main").otherwise("other").alias("board"))


@query(f"WITH {BARS}, c AS (SELECT day, row_number() OVER (ORDER BY day) AS no FROM (SELECT DISTINCT day FROM bars)), f AS (SELECT code, min(day) AS listed FROM bars GROUP BY code) SELECT b.code, b.day FROM bars b JOIN f ON b.code = f.code JOIN c x ON x.day = b.day JOIN c y ON y.day = f.listed WHERE x.no + 1 >= y.no + 60")
def p07_eligibility(spark, d):
    bars = supplier_bars(spark, d).select("code", "day")
    axis = bars.select("day").distinct().withColumn("no", F.row_number().over(Window.orderBy("day")))  # one row per day
    numbered = bars.join(axis, "day")
    return numbered.withColumn("listed", F.min("no").over(Window.partitionBy("code"))).where(F.col("no") + 1 >= F.col("listed") + 60).select("code", "day")


_CF = "(1 + sqrt(dayofyear(day) % 5 + 10) / 10)"


@query(f"WITH {BARS} SELECT code, day, round(low * {_CF} / last_value({_CF}) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS qfq, round(low * {_CF}, 4) AS hfq FROM bars")
def i01_qfq(spark, d):
    f = (1 + F.sqrt(F.dayofyear("day") % 5 + 10) / 10).cast("double")
    return supplier_bars(spark, d).select("code", "day", F.round(op.forward_adjusted(F.col("low"), f, "code", "day"), 4).alias("qfq"), F.round(F.col("low") * f, 4).alias("hfq"))


@query(f"WITH {BARS}, a AS (SELECT code, day, lag(close) OVER (PARTITION BY code ORDER BY day) AS before, CASE WHEN code % 4 = 0 AND dayofyear(day) = 100 THEN pre_close + 1 ELSE pre_close END AS stated FROM bars) SELECT code, count(*) AS checked, count(*) FILTER (abs(before - stated) >= 0.001) AS broken, bool_or(abs(before - stated) >= 0.001) AS repair FROM a WHERE before IS NOT NULL GROUP BY code")
def m06_continuity_audit(spark, d):
    """Entities whose stated previous close isn't the stored one have to be loaded again as a whole."""
    stated = F.when((F.col("code") % 4 == 0) & (F.dayofyear("day") == 100), F.col("pre_close") + 1).otherwise(F.col("pre_close"))
    a = supplier_bars(spark, d).select("code", F.lag("close").over(by_code()).alias("before"), stated.alias("stated")).where("before is not null")
    off = F.abs(F.col("before") - F.col("stated")) >= 0.001
    return a.groupBy("code").agg(F.count(F.lit(1)).alias("checked"), F.count_if(off).alias("broken"), F.max(off).alias("repair"))


@query(f"WITH {BARS}, l AS (SELECT code, max(day) + 1 AS day, arg_max(close, day) * 1.05 AS close, true AS supposed FROM bars GROUP BY code), u AS (SELECT code, day, close, false AS supposed FROM bars UNION ALL SELECT * FROM l), m AS (SELECT *, avg(close) OVER w AS ma, count(*) OVER w AS n FROM u WINDOW w AS (PARTITION BY code ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT code, day, round(ln(close), 5) AS level, n = 5 AND close > ma + 1e-12 AS hit FROM m WHERE supposed")
def r26_what_if(spark, d):
    s = Series("code", "day")
    rows = op.what_if(supplier_bars(spark, d), "code", "day", 5.0)
    return rows.withColumn("ma", s.mean(F.col("close"), 5)).where("supposed").select("code", "day", F.round(F.log("close"), 5).alias("level"), F.coalesce(F.col("close") > F.col("ma") + 1e-12, F.lit(False)).alias("hit"))


@query(f"WITH {STOCKS}, {CONCEPTS}, w AS (SELECT concept FROM concepts WHERE code = 1), s AS (SELECT code, count(*) AS shared FROM concepts WHERE concept IN (SELECT concept FROM w) GROUP BY code) SELECT stocks.code, round(40.0 * coalesce(shared, 0) / (SELECT count(*) FROM w) + CASE WHEN industry = (SELECT industry FROM stocks WHERE code = 1) THEN 40 ELSE 0 END, 6)::DOUBLE AS likeness, 80 AS attainable FROM stocks LEFT JOIN s ON stocks.code = s.code WHERE stocks.code <> 1")
def b28_stock_similarity(spark, d):
    return op.stock_similarity(stocks(spark, d), concepts(spark, d), 1)


_SPEED = "min(value) OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)"


@query(f"SELECT event_id, user_id, CASE WHEN {_SPEED} > 0 THEN round((value / {_SPEED} - 1) * 100, 6) END AS speed FROM events")
def m09_speed(spark, d):
    e = read(spark, d, "events").withColumn("s", F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))  # nearest second
    low = F.min("value").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 0))
    return e.select("event_id", "user_id", F.when(low > 0, F.round((F.col("value") / low - 1) * 100, 6)).alias("speed"))


_CUM = "sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id)"


@query(f"WITH c AS (SELECT event_id, user_id, ts, CAST({_CUM} AS DOUBLE) AS cum FROM events) SELECT event_id, user_id, round(cum - coalesce(lag(cum) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id), 0), 4) AS delta FROM c")
def m04_minute_delta(spark, d):
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("event_id")
    c = read(spark, d, "events").withColumn("cum", F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double"))
    return c.select("event_id", "user_id", F.round(F.col("cum") - F.coalesce(F.lag("cum").over(w), F.lit(0.0)), 4).alias("delta"))
