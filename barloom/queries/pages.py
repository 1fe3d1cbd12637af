"""Page queries: picks, boards, contributors, details, seats, watch lists and data status."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import panel as op
from barloom.operators import scoring as sc
from barloom.operators import validation as va
from barloom.queries.market import _BOARD, RANKED, by_code, members, ranked
from barloom.queries.scoring import _RULES, PANEL, details, panel, stages, total_panel
from barloom.sources.fixtures import BARS, CONCEPTS, STOCKS, concepts, read, stocks, supplier_bars

QUERIES: dict = {}
ORACLE: dict = {}
REFERENCE = "1998-06-30"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def until(df):
    """Rows up to the reference day."""
    return df.where(F.col("day") <= F.lit(REFERENCE).cast("date"))


def last_days(df, n: int):
    """The last n distinct days up to the reference day, oldest first."""
    return until(df.select("day")).distinct().orderBy(F.desc("day")).limit(n).orderBy("day")


_LAST = f"SELECT DISTINCT day FROM bars WHERE day <= DATE '{REFERENCE}' ORDER BY day DESC LIMIT"


@query(f"WITH {BARS}, l AS ({_LAST} 20) SELECT day FROM l")
def g07a_last_dates(spark, d):
    return last_days(supplier_bars(spark, d), 20)


@query(f"WITH {_BOARD}, ip AS (SELECT day, industry, avg(pct) AS mean FROM bars JOIN stocks ON bars.code = stocks.code WHERE pct IS NOT NULL GROUP BY ALL), a AS (SELECT day, 'concept' AS kind, concept AS name, performance AS value FROM bp UNION ALL SELECT day, 'industry', industry, round(mean, 3) FROM ip) SELECT day, kind, name, value FROM (SELECT *, row_number() OVER (PARTITION BY day, kind ORDER BY value DESC, name) AS n FROM a) WHERE n <= 5")
def g07f_daily_tops(spark, d):
    bars = supplier_bars(spark, d)
    c = op.board_performance(bars, members(spark, d), "code", "day", "concept").select("day", F.lit("concept").alias("kind"), F.col("concept").alias("name"), F.col("performance").alias("value"))
    i = bars.where("pct is not null").join(stocks(spark, d), "code").groupBy("day", F.col("industry").alias("name")).agg(F.round(F.avg("pct"), 3).alias("value")).withColumn("kind", F.lit("industry"))
    w = Window.partitionBy("day", "kind").orderBy(F.desc("value"), "name")
    return c.unionByName(i).withColumn("n", F.row_number().over(w)).where("n <= 5").drop("n")


@query(f"WITH {BARS}, l AS ({_LAST} 6), t AS (SELECT code, day, pct, close, lag(close, 2) OVER w AS c3, lag(close, 4) OVER w AS c5 FROM bars WHERE day IN (SELECT day FROM l) WINDOW w AS (PARTITION BY code ORDER BY day)) SELECT code, round(pct, 5) AS pct, CASE WHEN c3 > 0 THEN round((close / c3 - 1) * 100, 5) END AS gain3, CASE WHEN c5 > 0 THEN round((close / c5 - 1) * 100, 5) END AS gain5 FROM t WHERE day = (SELECT max(day) FROM l) AND pct IS NOT NULL ORDER BY t.pct DESC, code LIMIT 20")
def g07g_daily_gain(spark, d):
    bars = supplier_bars(spark, d)
    days = last_days(bars, 6)
    newest = days.agg(F.max("day").alias("newest"))  # one row
    gain = lambda k: F.when(F.lag("close", k).over(by_code()) > 0, F.round((F.col("close") / F.lag("close", k).over(by_code()) - 1) * 100, 5))
    t = bars.join(F.broadcast(days), "day", "left_semi").withColumns({"gain3": gain(2), "gain5": gain(4)})
    t = t.join(F.broadcast(newest), F.col("day") == F.col("newest")).where("pct is not null").orderBy(F.desc("pct"), "code").limit(20)
    return t.select("code", F.round("pct", 5).alias("pct"), "gain3", "gain5")


@query(f"WITH {BARS}, {STOCKS}, {CONCEPTS}, m AS (SELECT code FROM concepts WHERE concept = 'Brand#11') SELECT b.code, name, round(avg(pct), 6) AS mean, count(*) AS days FROM bars b JOIN m ON b.code = m.code JOIN stocks ON stocks.code = b.code WHERE pct IS NOT NULL GROUP BY ALL ORDER BY mean DESC, b.code LIMIT 100")
def g08_contributors(spark, d):
    mine = concepts(spark, d).where("concept = 'Brand#11'").select("code")
    g = supplier_bars(spark, d).where("pct is not null").join(mine, "code").groupBy("code").agg(F.round(F.avg("pct"), 6).alias("mean"), F.count(F.lit(1)).alias("days"))
    return g.join(stocks(spark, d), "code").select("code", "name", "mean", "days").orderBy(F.desc("mean"), "code").limit(100)


@query("SELECT p_partkey FROM part WHERE p_type <> 'ECONOMY' AND (p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%')")
def p04_board_filter(spark, d):
    """The special board is left out, one board is asked for."""
    growth = F.substring("p_brand", 1, 7).isin("Brand#1", "Brand#2")
    return read(spark, d, "part").where((F.col("p_type") != "ECONOMY") & growth).select("p_partkey")


@query(f"WITH {STOCKS} SELECT code, CASE WHEN market_value < 500 THEN 'small' WHEN market_value < 2000 THEN 'middle' ELSE 'large' END AS size, market_value BETWEEN 0 AND 5000 AS within FROM stocks WHERE market_value IS NOT NULL")
def p05_market_value(spark, d):
    """Groups are half-open, bounds include both ends."""
    v = F.col("market_value")
    return stocks(spark, d).where(v.isNotNull()).select("code", F.when(v < 500, "small").when(v < 2000, "middle").otherwise("large").alias("size"), v.between(0, 5000).alias("within"))


_PARTS = "pc AS (SELECT o_custkey AS code, list(DISTINCT p_brand) AS brands FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def brand_lists(spark, d):
    """Customers with the list of brands that they bought."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    bought = lines.join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return bought.groupBy(F.col("o_custkey").alias("code")).agg(F.collect_set("p_brand").alias("brands"))


@query(f"WITH {_PARTS} SELECT code FROM pc WHERE list_has_any(brands, ['Brand#11', 'Brand#12']) AND list_has_all(brands, ['Brand#5']) AND NOT list_has_any(brands, ['Brand#3'])")
def p06_concept_filter(spark, d):
    """One of some brands, all of others, none of the excluded."""
    given = lambda *a: F.array(*map(F.lit, a))
    keep = F.arrays_overlap("brands", given("Brand#11", "Brand#12")) & (F.size(F.array_except(given("Brand#5"), "brands")) == 0) & ~F.arrays_overlap("brands", given("Brand#3"))
    return brand_lists(spark, d).where(keep).select("code")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE isfinite(CASE WHEN l_linenumber % 3 = 0 THEN 'NaN'::DOUBLE WHEN l_linenumber % 5 = 0 THEN 'Infinity'::DOUBLE WHEN l_linenumber % 7 = 0 THEN NULL ELSE l_tax END)")
def p08_finite(spark, d):
    n = F.col("l_linenumber")
    x = F.when(n % 3 == 0, float("nan")).when(n % 5 == 0, float("inf")).when(n % 7 == 0, None).otherwise(F.col("l_tax"))
    return read(spark, d, "lineitem").where(va.finite(x)).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END) AS INT) AS level FROM orders")
def p10_try_cast(spark, d):
    part = F.substring("o_orderpriority", F.lit(1), F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(3))
    return read(spark, d, "orders").select("o_orderkey", part.try_cast("int").alias("level"))


@query("SELECT o_orderkey, word FROM (SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS word FROM orders)")
def j20_explode_list(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.explode(F.split("o_orderpriority", "-")).alias("word"))


@query(f"WITH {_RULES}, b AS (SELECT code, day, turnover FROM bars WHERE volume > 20) SELECT tot.code, tot.day, total, turnover, CAST(row_number() OVER (PARTITION BY tot.day ORDER BY total DESC, turnover ASC NULLS LAST, tot.code) AS INT) AS rank FROM tot LEFT JOIN b ON tot.code = b.code AND tot.day = b.day")
def j01_tie_join(spark, d):
    ties = supplier_bars(spark, d).where("volume > 20").select("code", "day", "turnover")
    joined = total_panel(spark, d).select("code", "day", "total").join(ties, ["code", "day"], "left")
    return sc.rank_days(joined, "code", "day", "total", "turnover")


@query("SELECT l_orderkey, l_linenumber, o_orderpriority AS priority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus AND year(l_shipdate) = year(o_orderdate)")
def j04_three_keys(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"), F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("priority"))
    l = read(spark, d, "lineitem").withColumn("y", F.year("l_shipdate"))
    return l.join(o, ["l_orderkey", "l_linestatus", "y"], "left").select("l_orderkey", "l_linenumber", "priority")


@query(f"WITH {_RULES}, t AS (SELECT scene FROM st WHERE code = 1 AND day = (SELECT max(day) FROM st WHERE code = 1 AND scene_stage IS NOT NULL) AND scene_stage IS NOT NULL) SELECT code, day, count(*) AS shared FROM st WHERE scene_stage IS NOT NULL AND code <> 1 AND scene IN (SELECT scene FROM t) GROUP BY ALL")
def j08_shared_scenes(spark, d):
    st = stages(spark, d).where("scene_stage is not null").select("code", "day", "scene")
    mine = st.where("code = 1")
    target = mine.join(mine.agg(F.max("day").alias("day")), "day").select("scene").distinct()
    return st.where("code <> 1").join(F.broadcast(target), "scene", "left_semi").groupBy("code", "day").agg(F.count(F.lit(1)).alias("shared"))


_INDEX = "ix AS (SELECT day, avg(pct) AS ip FROM bars WHERE code <= 3 AND pct IS NOT NULL GROUP BY day)"


def index_series(bars):
    """The mean of three entities stands for an index."""
    return bars.where("code <= 3 and pct is not null").groupBy("day").agg(F.avg("pct").alias("pct"))


@query(f"WITH {BARS}, {_INDEX} SELECT code, bars.day, round(pct, 5) AS pct, round(ip, 5) AS index_pct FROM bars LEFT JOIN ix ON bars.day = ix.day")
def j11_index_join(spark, d):
    bars = supplier_bars(spark, d)
    return bars.join(index_series(bars).withColumnRenamed("pct", "ip"), "day", "left").select("code", "day", F.round("pct", 5).alias("pct"), F.round("ip", 5).alias("index_pct"))


@query(f"WITH {BARS}, {STOCKS} SELECT bars.code, day, industry FROM bars LEFT JOIN stocks ON bars.code = stocks.code")
def j13_attach(spark, d):
    return va.attach(supplier_bars(spark, d), stocks(spark, d).select("code", "industry"), ["code"]).select("code", "day", "industry")


_FACTORS = f"{BARS}, {STOCKS}, {_INDEX}, cs AS (SELECT day, 'C' || (code % 4) AS name, avg(pct) AS cp FROM bars WHERE pct IS NOT NULL AND code % 4 < 3 GROUP BY ALL), ns AS (SELECT day, industry AS name, avg(pct) AS np FROM bars JOIN stocks ON bars.code = stocks.code WHERE pct IS NOT NULL GROUP BY ALL), sb AS (SELECT bars.code, day, pct, CASE WHEN bars.code % 5 = 0 THEN '' ELSE 'C' || (bars.code % 4) END AS concept, industry FROM bars JOIN stocks ON bars.code = stocks.code WHERE pct IS NOT NULL)"


@query(f"WITH {_FACTORS}, j AS (SELECT sb.*, ip, CASE WHEN concept = '' THEN ip ELSE cp END AS c, np FROM sb LEFT JOIN ix ON sb.day = ix.day LEFT JOIN cs ON cs.day = sb.day AND cs.name = concept LEFT JOIN ns ON ns.day = sb.day AND ns.name = industry) SELECT code, day, round(pct - (0.5 * ip + 0.1 * c + 0.2 * np), 5) AS residual FROM j WHERE ip IS NOT NULL AND c IS NOT NULL AND np IS NOT NULL")
def j14_factor_join(spark, d):
    """One concept has no series, so its members have no residual; an empty concept stands for the index."""
    known = supplier_bars(spark, d).where("pct is not null").join(stocks(spark, d).select("code", "industry"), "code")
    name = F.concat(F.lit("C"), (F.col("code") % 4).cast("string"))
    board = known.where("code % 4 < 3").groupBy("day", name.alias("name")).agg(F.avg("pct").alias("pct"))
    field = known.groupBy("day", F.col("industry").alias("name")).agg(F.avg("pct").alias("pct"))
    rows = known.withColumn("concept", F.when(F.col("code") % 5 == 0, "").otherwise(name))
    out = va.factor_residual(rows, index_series(known), board, field, (0.5, 0.1, 0.2), "code", "day")
    return out.select("code", "day", F.round("residual", 5).alias("residual"))


@query(f"WITH {PANEL}, {STOCKS} SELECT h.code, name, count(*) FILTER (b) AS hits, max(day) FILTER (b) AS last_hit FROM h JOIN stocks ON h.code = stocks.code WHERE market_value BETWEEN 0 AND 8000 AND industry <> 'CHINA' GROUP BY ALL HAVING bool_or(b)")
def g09_pick(spark, d):
    """Entities whose condition held anywhere in the range, inside bounds of value and board."""
    chosen = stocks(spark, d).where(F.col("market_value").between(0, 8000) & (F.col("industry") != "CHINA")).select("code", "name")
    g = panel(spark, d).groupBy("code").agg(F.count_if("b").alias("hits"), F.max(F.when(F.col("b"), F.col("day"))).alias("last_hit")).where("hits > 0")
    return g.join(chosen, "code").select("code", "name", "hits", "last_hit")


@query(f"WITH {RANKED} SELECT code, day, round(ln(close), 5) AS level, round(total, 5) AS total, rank FROM rk WHERE code = 1 ORDER BY day DESC LIMIT 30")
def g10a_detail(spark, d):
    mine = ranked(spark, d).where("code = 1").orderBy(F.desc("day")).limit(30)
    return mine.select("code", "day", F.round(F.log("close"), 5).alias("level"), F.round("total", 5).alias("total"), "rank")


@query(f"WITH {_RULES}, meta(rule, scene) AS (VALUES ('above', 'trend'), ('crossed', 'trend'), ('joined', 'trend'), ('hot', 'heat'), ('broken', 'trend')), dx AS MATERIALIZED (SELECT code, day, rule, score FROM d), tx AS MATERIALIZED (SELECT code, day FROM tot), t AS (SELECT rule, score FROM dx WHERE code = 1 AND day = (SELECT max(day) FROM tx WHERE code = 1)) SELECT meta.rule, meta.scene, t.rule IS NOT NULL AS triggered, coalesce(score, 0) AS score FROM meta LEFT JOIN t ON meta.rule = t.rule")
def g10e_triggered_split(spark, d):
    known = spark.createDataFrame([("above", "trend"), ("crossed", "trend"), ("joined", "trend"), ("hot", "heat"), ("broken", "trend")], "rule string, scene string")
    last = op.newest(total_panel(spark, d).where("code = 1"), "code", "day")
    hit = sc.rule_details(last, "code", "day").select("rule", "score", F.lit(True).alias("hit"))
    return known.join(hit, "rule", "left").select("rule", "scene", F.coalesce("hit", F.lit(False)).alias("triggered"), F.coalesce("score", F.lit(0.0)).alias("score"))


@query("WITH o AS (SELECT o_orderkey, c_mktsegment AS seat, o_orderstatus AS side, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey) SELECT * FROM o WHERE day = (SELECT max(day) FROM o WHERE day <= DATE '1998-06-30')")
def g11a_seat_day(spark, d):
    """Seats of the latest day that has any, up to the reference day."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("seat"), F.col("o_orderstatus").alias("side"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("day"))
    newest = until(read(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"))).agg(F.max("day").alias("day"))
    return o.join(F.broadcast(newest), "day").select("o_orderkey", "seat", "side", "amount", "day")


@query("SELECT code, o_orderkey, day, n FROM (SELECT o_custkey AS code, o_orderkey, CAST(o_orderdate AS DATE) AS day, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 5")
def g11b_seat_history(spark, d):
    w = Window.partitionBy("code").orderBy(F.desc("day"), "o_orderkey")
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("code"), "o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("code")), "r": F.row_number().over(w)}).where("r <= 5").drop("r")


@query(f"WITH {RANKED}, w(code, since) AS (VALUES (1, DATE '1997-03-01'), (2, DATE '1996-08-15'), (5, DATE '1998-01-01')), f AS (SELECT w.code, since, (SELECT arg_max(close, day) FROM bars b WHERE b.code = w.code AND day <= since) AS base FROM w), l AS (SELECT code, day, close, rank, lag(close, 3) OVER (PARTITION BY code ORDER BY day) AS c3, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM rk) SELECT CAST(f.code AS BIGINT) AS code, since, rank, CASE WHEN c3 > 0 THEN round((close / c3 - 1) * 100, 5) END AS three_days, CASE WHEN base > 0 THEN round((close / base - 1) * 100, 5) END AS since_watch FROM f JOIN l ON l.code = f.code AND n = 1")
def g12_watch_list(spark, d):
    """Return over three rows, and since the last row on or before the watch day."""
    watch = F.broadcast(spark.createDataFrame([(1, "1997-03-01"), (2, "1996-08-15"), (5, "1998-01-01")], "code long, since string").withColumn("since", F.to_date("since")))
    rows = ranked(spark, d).join(watch, "code")
    base = F.max_by("close", F.when(F.col("day") <= F.col("since"), F.col("day")))
    c3 = F.lag("close", 3).over(by_code())
    g = rows.withColumn("c3", c3).groupBy("code", "since").agg(base.alias("base"), F.max_by(F.struct("close", "c3", "rank"), "day").alias("l"))
    up = lambda a, b: F.when(b > 0, F.round((a / b - 1) * 100, 5))
    return g.select("code", "since", F.col("l.rank").alias("rank"), up(F.col("l.close"), F.col("l.c3")).alias("three_days"), up(F.col("l.close"), F.col("base")).alias("since_watch"))


@query(f"WITH {RANKED} SELECT code, day, rank, round(total, 5) AS total FROM (SELECT *, dense_rank() OVER (ORDER BY day DESC) AS n FROM rk) WHERE n = 1 AND total >= 50 ORDER BY rank LIMIT 30")
def g14a_monitor_total(spark, d):
    rows = ranked(spark, d)
    newest = rows.agg(F.max("day").alias("day"))
    return rows.join(F.broadcast(newest), "day").where("total >= 50").orderBy("rank").limit(30).select("code", "day", "rank", F.round("total", 5).alias("total"))


_SR = "row_number() OVER (PARTITION BY st.day, scene ORDER BY CASE scene_stage WHEN 'confirm' THEN 3 WHEN 'trigger' THEN 2 WHEN 'observe' THEN 1 WHEN 'fail' THEN 0 ELSE -1 END DESC, confirm_strength DESC, confirm_strength - risk_intensity DESC, abs(stage_score) - abs(risk_score) DESC, total DESC, st.code)"


@query(f"WITH {_RULES}, s AS (SELECT st.code, st.day, scene, {_SR} AS r FROM st JOIN tot ON st.code = tot.code AND st.day = tot.day) SELECT code, day, scene, CAST(r AS INT) AS scene_rank FROM s WHERE day = (SELECT max(day) FROM s) AND r <= 10")
def g14b_monitor_scenes(spark, d):
    """All scenes: the limit holds for each."""
    s = sc.rank_scenes(stages(spark, d), "code", "day")
    return s.join(F.broadcast(stages(spark, d).agg(F.max("day").alias("day"))), "day").where("scene_rank <= 10").select("code", "day", "scene", "scene_rank")




@query(f"WITH {_RULES}, t(scene, stage, tag) AS (VALUES ('trend', 'confirm', 'trend-confirm'), ('trend', 'all', 'trend'), ('heat', 'all', 'heat')) SELECT code, day, st.scene, coalesce(a.tag, b.tag, 'total') AS template FROM st LEFT JOIN t a ON a.scene = st.scene AND a.stage = scene_stage LEFT JOIN t b ON b.scene = st.scene AND b.stage = 'all'")
def g14c_template(spark, d):
    """A template of the scene's stage, else the scene's, else the one for totals."""
    t = F.broadcast(spark.createDataFrame([("trend", "confirm", "trend-confirm"), ("trend", "all", "trend"), ("heat", "all", "heat")], "scene string, stage string, tag string"))
    a = t.select("scene", F.col("stage").alias("scene_stage"), F.col("tag").alias("own"))
    b = t.where("stage = 'all'").select("scene", F.col("tag").alias("general"))
    return stages(spark, d).join(a, ["scene", "scene_stage"], "left").join(b, "scene", "left").select("code", "day", "scene", F.coalesce("own", "general", F.lit("total")).alias("template"))


@query(f"WITH {RANKED}, q AS (SELECT code, max(day) AS day FROM rk GROUP BY code) SELECT rk.code, CASE WHEN rk.code % 6 = 0 THEN 'no quote' WHEN close IS NULL OR close <= 0 THEN 'invalid' WHEN total >= 52 THEN 'hit' ELSE 'miss' END AS tag FROM rk JOIN q ON rk.code = q.code AND rk.day = q.day")
def g14d_template_tag(spark, d):
    last = op.newest(total_panel(spark, d), "code", "day")
    c = F.col("close")
    return last.select("code", F.when(F.col("code") % 6 == 0, "no quote").when(c.isNull() | (c <= 0), "invalid").when(F.col("total") >= 52, "hit").otherwise("miss").alias("tag"))


@query(f"WITH {RANKED}, l AS (SELECT code, day, rank, lag(close, 5) OVER (PARTITION BY code ORDER BY day) AS base, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM rk) SELECT code, day, rank, round(ln(base), 5) AS base FROM l WHERE n = 1")
def g14e_rank_context(spark, d):
    rows = ranked(spark, d).withColumn("base", F.lag("close", 5).over(by_code()))
    return op.newest(rows, "code", "day").select("code", "day", "rank", F.round(F.log("base"), 5).alias("base"))


@query(f"WITH {BARS}, b AS (SELECT code, min(day) AS first, max(day) AS last, count(*) AS rows FROM bars WHERE code % 9 <> 0 GROUP BY code), x AS (SELECT max(last) AS newest FROM b) SELECT s_suppkey AS code, first, last, coalesce(rows, 0) AS rows, CASE WHEN b.code IS NULL THEN 'load' WHEN last < newest - 30 THEN 'update' ELSE 'none' END AS action FROM supplier LEFT JOIN b ON b.code = s_suppkey CROSS JOIN x")
def g16_data_status(spark, d):
    """Range and rows of every expected entity and what is to be done."""
    b = supplier_bars(spark, d).where("code % 9 <> 0").groupBy("code").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count(F.lit(1)).alias("rows"))
    newest = b.agg(F.max("last").alias("newest"))
    out = read(spark, d, "supplier").select(F.col("s_suppkey").alias("code")).join(b, "code", "left").crossJoin(F.broadcast(newest))
    action = F.when(F.col("rows").isNull(), "load").when(F.col("last") < F.date_sub("newest", 30), "update").otherwise("none")
    return out.select("code", "first", "last", F.coalesce("rows", F.lit(0)).alias("rows"), action.alias("action"))


@query(f"WITH {_RULES}, c AS (SELECT rule, day, count(*) AS n FROM d GROUP BY ALL), a AS (SELECT rule, avg(n) AS mean FROM c GROUP BY rule) SELECT c.rule, count(*) FILTER (n > mean) AS above, arg_max(n, day) AS latest FROM c JOIN a ON a.rule = c.rule GROUP BY c.rule")
def g20_heatmap_summary(spark, d):
    c = details(spark, d).groupBy("rule", "day").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("mean", F.avg("n").over(Window.partitionBy("rule")))
    return c.groupBy("rule").agg(F.count_if(F.col("n") > F.col("mean")).alias("above"), F.max_by("n", "day").alias("latest"))


@query(f"WITH {BARS} SELECT code, day, round(ln(close), 5) AS level, CASE WHEN pct > 0 THEN 'red' WHEN pct < 0 THEN 'green' ELSE 'gray' END AS colour, CASE WHEN volume >= 100 THEN 'busy' END AS marker, printf('%d: %d', code, CAST(floor(volume) AS BIGINT)) AS tip FROM bars")
def g17_chart(spark, d):
    pct = F.col("pct")
    return supplier_bars(spark, d).select("code", "day", F.round(F.log("close"), 5).alias("level"), F.when(pct > 0, "red").when(pct < 0, "green").otherwise("gray").alias("colour"), F.when(F.col("volume") >= 100, "busy").alias("marker"), F.format_string("%d: %d", "code", F.floor("volume")).alias("tip"))


@query("SELECT s_suppkey AS code, s_name AS name, n_name AS industry, o.n AS shipped FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) o ON o.l_suppkey = s_suppkey")
def i04_list_snapshot(spark, d):
    """The stock list with its daily snapshot."""
    daily = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.count(F.lit(1)).alias("shipped"))
    return stocks(spark, d).join(daily, "code", "left").select("code", "name", "industry", "shipped")


@query(f"WITH {BARS}, f AS (SELECT code, min(day) AS listed FROM bars GROUP BY code) SELECT code, greatest(listed, DATE '1995-03-01') AS start, DATE '1996-03-31' AS stop FROM f WHERE listed <= DATE '1996-03-31'")
def i05_task_plan(spark, d):
    """Tasks begin at the first listed day; entities not listed yet have none."""
    f = supplier_bars(spark, d).groupBy("code").agg(F.min("day").alias("listed"))
    date = lambda x: F.lit(x).cast("date")
    return f.where(F.col("listed") <= date("1996-03-31")).select("code", F.greatest("listed", date("1995-03-01")).alias("start"), date("1996-03-31").alias("stop"))
