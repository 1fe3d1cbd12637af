"""Validation queries: layers by group, top series by year, scene spreads, grids, calibration, kernels and feature lift."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import semantics as m
from barloom.functions.series import Series, efficiency_ratio
from barloom.operators import backtest as bt
from barloom.operators import scoring as sc
from barloom.operators import validation as va
from barloom.queries.backtest import _FW, universe
from barloom.queries.market import by_code
from barloom.queries.scoring import _RULES, EVENT_SCORES, PANEL, S, SCENES, details, event_scores, panel, rules
from barloom.queries.series import ORACLE as SERIES_SQL
from barloom.queries.state import _DAILY, daily_returns
from barloom.sources.fixtures import BARS, STOCKS, stocks, supplier_bars

QUERIES: dict = {}
ORACLE: dict = {}
B = Series("code", "day")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _nw(table: str, by: str, value: str, lags: int, order: str = "day") -> str:
    """CTEs nw_c to nw: by, n, mean and t of the mean with Bartlett weights."""
    g = ", ".join(f"c * lag(c, {k}) OVER (PARTITION BY {by} ORDER BY {order}) AS g{k}" for k in range(1, lags + 1))
    s = ", ".join(f"coalesce(sum(g{k}), 0) AS s{k}" for k in range(1, lags + 1))
    v = " + ".join(f"CASE WHEN k >= {k} THEN 2 * (1 - {k} / (k + 1.0)) * s{k} ELSE 0 END" for k in range(1, lags + 1))
    return f"nw_c AS (SELECT *, {value} - avg({value}) OVER (PARTITION BY {by}) AS c FROM {table} WHERE {value} IS NOT NULL), nw_l AS (SELECT *, c * c AS g0, {g} FROM nw_c), nw_s AS (SELECT {by}, count(*) AS n, avg({value}) AS mean, sum(g0) AS s0, {s}, least({lags}, count(*) - 1) AS k FROM nw_l GROUP BY {by}), nw AS (SELECT {by}, n, mean, CASE WHEN (s0 + {v}) / n / n > 1e-12 THEN mean / sqrt((s0 + {v}) / n / n) END AS t FROM nw_s)"


@query(f"WITH {_RULES} SELECT rule, round(sum(score) FILTER (score > 1e-12) / -sum(score) FILTER (score < -1e-12), 6) AS ratio FROM (SELECT code % 5 AS rule, pct AS score FROM bars WHERE pct IS NOT NULL) GROUP BY rule")
def a11_profit_loss(spark, d):
    return supplier_bars(spark, d).where("pct is not null").groupBy((F.col("code") % 5).alias("rule")).agg(F.round(va.profit_loss_ratio(F.col("pct")), 6).alias("ratio"))


@query(f"WITH {_FW}, a AS (SELECT d.day, rule, score, avg(ahead) AS m, count(*) AS n FROM d JOIN u ON d.code = u.code AND d.day = u.day GROUP BY ALL) SELECT rule, score, count(*) AS days, CAST(sum(n) AS BIGINT) AS samples, round(avg(m), 5) AS mean FROM a GROUP BY rule, score")
def a14_by_score(spark, d):
    """Mean of daily means by exact score of a rule."""
    hit = sc.rule_details(universe(spark, d), "code", "day", "ahead")
    a = hit.groupBy("day", "rule", "score").agg(F.avg("ahead").alias("m"), F.count(F.lit(1)).alias("n"))
    return a.groupBy("rule", "score").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("samples"), F.round(F.avg("m"), 5).alias("mean"))


@query(f"WITH {_FW}, a AS (SELECT rule, year(d.day) AS year, count(*) AS points, avg(ahead) AS m FROM d JOIN u ON d.code = u.code AND d.day = u.day GROUP BY ALL) SELECT CAST(year AS INT) AS year, CAST(sum(points) AS BIGINT) AS points, round(sum(m * points) / sum(points), 5) AS mean FROM a GROUP BY year")
def a15_weighted(spark, d):
    """Means of rules weighted by their number of points."""
    hit = sc.rule_details(universe(spark, d), "code", "day", "ahead")
    a = hit.groupBy("rule", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("points"), F.avg("ahead").alias("m"))
    return a.groupBy("year").agg(F.sum("points").alias("points"), F.round(F.sum(F.col("m") * F.col("points")) / F.sum("points"), 5).alias("mean"))


@query(f"WITH {PANEL}, z AS (SELECT code, day, a, sum(CASE WHEN a THEN 0 ELSE 1 END) OVER (PARTITION BY code ORDER BY day) AS block FROM h) SELECT code, day, CAST(sum(CAST(a AS INT)) OVER (PARTITION BY code, block ORDER BY day) AS BIGINT) AS streak FROM z")
def a19_streak(spark, d):
    return va.longest_run(panel(spark, d), "a", "code", "day").select("code", "day", "streak")


@query(f"WITH {BARS} SELECT code, day, day >= DATE '1997-01-01' AS after, CAST(row_number() OVER (PARTITION BY code, day >= DATE '1997-01-01' ORDER BY CASE WHEN day >= DATE '1997-01-01' THEN epoch(day) ELSE -epoch(day) END) AS INT) AS n FROM bars")
def n03_before_after(spark, d):
    """Rows numbered away from a start on both sides of it."""
    after = F.col("day") >= F.lit("1997-01-01").cast("date")
    no = F.unix_date("day")
    w = Window.partitionBy("code", "after").orderBy(F.when(F.col("after"), no).otherwise(-no))
    return supplier_bars(spark, d).select("code", "day", after.alias("after")).withColumn("n", F.row_number().over(w))


@query(f"WITH {BARS}, x AS (SELECT code, day, pct, row_number() OVER (PARTITION BY code ORDER BY pct DESC, day) AS up, row_number() OVER (PARTITION BY code ORDER BY pct, day) AS down, row_number() OVER (PARTITION BY code ORDER BY md5(CAST(day AS VARCHAR)), day) AS av FROM bars WHERE pct IS NOT NULL) SELECT code, day, 'gain' AS kind FROM x WHERE up <= 3 AND pct > 0 UNION ALL SELECT code, day, 'loss' FROM x WHERE down <= 3 AND pct < 0 UNION ALL SELECT code, day, 'any' FROM x WHERE av <= 3")
def t05_group_sample(spark, d):
    return va.sampled(supplier_bars(spark, d).where("pct is not null"), "code", "pct", F.col("day"), 3).select("code", "day", "kind")


@query(f"WITH e AS ({SERIES_SQL['ind_er20']}) SELECT code, day, round(lead(er, 5) OVER (PARTITION BY code ORDER BY day) - er, 6) AS change FROM e")
def b04_er_change(spark, d):
    e = supplier_bars(spark, d).select("code", "day", F.round(efficiency_ratio(B, F.col("close")), 6).alias("er"))
    return e.select("code", "day", F.round(F.lead("er", 5).over(by_code()) - F.col("er"), 6).alias("change"))


_LC = "CAST((row_number() OVER (PARTITION BY day{by} ORDER BY total, rank DESC) - 1) * 5 // count(*) OVER (PARTITION BY day{by}) AS INT)"


@query(f"WITH {_FW}, la AS (SELECT day, {_LC.format(by='')} AS layer, ahead FROM u), dm AS (SELECT day, layer, avg(ahead) AS m, count(*) AS n FROM la GROUP BY ALL), {_nw('dm', 'layer', 'm', 2)} SELECT nw.layer, nw.n AS days, (SELECT CAST(sum(dm.n) AS BIGINT) FROM dm WHERE dm.layer = nw.layer) AS samples, round(mean, 5) AS mean, round(t, 4) AS t FROM nw")
def b14_layer_summary(spark, d):
    """Mean of daily layer means, samples and the t of the mean with two lags."""
    u = universe(spark, d).withColumn("layer", bt.layer_by_count("total", "rank", "day", 5))
    daily = u.groupBy("day", "layer").agg(F.avg("ahead").alias("m"), F.count(F.lit(1)).alias("n"))
    t = bt.newey_west(daily, "m", "day", "layer", 2)
    return t.join(daily.groupBy("layer").agg(F.sum("n").alias("samples")), "layer").select("layer", F.col("n").alias("days"), "samples", F.round("mean", 5).alias("mean"), F.round("t", 4).alias("t"))


@query(f"WITH {_FW}, ts AS (SELECT k * 10000 + year(day) AS ky, day, avg(ahead) AS m FROM u JOIN (VALUES (1), (5), (20), (100)) x(k) ON rank <= k GROUP BY ALL), {_nw('ts', 'ky', 'm', 2)}, o AS (SELECT ky, quantile_cont(m, 0.5) AS median, count(*) FILTER (m > 0) / count(*) AS positive, stddev_samp(m) AS std FROM ts GROUP BY ky) SELECT CAST(nw.ky // 10000 AS INT) AS k, CAST(nw.ky % 10000 AS INT) AS year, n AS days, round(mean, 5) AS mean, round(median, 5) AS median, round(positive, 6) AS positive, round(std, 5) AS std, round(t, 4) AS t FROM nw JOIN o ON nw.ky = o.ky")
def b15_topk_years(spark, d):
    s = bt.top_series(universe(spark, d), (1, 5, 20, 100), "rank", "ahead", "day").withColumn("ky", F.col("k") * 10000 + F.year("day"))
    o = s.groupBy("ky").agg(F.percentile("m", 0.5).alias("median"), (F.count_if(F.col("m") > 0) / F.count(F.lit(1))).alias("positive"), F.stddev_samp("m").alias("std"))
    out = bt.newey_west(s, "m", "day", "ky", 2).join(o, "ky")
    return out.select(F.floor(F.col("ky") / 10000).cast("int").alias("k"), (F.col("ky") % 10000).cast("int").alias("year"), F.col("n").alias("days"), *[F.round(c, 5).alias(c) for c in ("mean", "median", "std")], F.round("positive", 6).alias("positive"), F.round("t", 4).alias("t"))


_SIZE = "CASE WHEN market_value < 500 THEN 'small' WHEN market_value < 2000 THEN 'middle' ELSE 'large' END"


@query(f"WITH {_FW}, us AS (SELECT u.*, {_SIZE} AS size FROM u JOIN stocks ON u.code = stocks.code), la AS (SELECT day, size, {_LC.format(by=', size')} AS layer, ahead FROM us), dm AS (SELECT day, size, layer, avg(ahead) AS m, count(*) AS n FROM la GROUP BY ALL) SELECT size, layer, count(*) AS days, CAST(sum(n) AS BIGINT) AS samples, round(avg(m), 5) AS mean FROM dm GROUP BY ALL")
def b16_value_groups(spark, d):
    """Layers within groups of market value."""
    v = F.col("market_value")
    u = universe(spark, d).withColumn("size", F.when(v < 500, "small").when(v < 2000, "middle").otherwise("large"))
    w = Window.partitionBy("day", "size")
    layer = F.floor((F.row_number().over(w.orderBy(F.asc("total"), F.desc("rank"))) - 1) * 5 / F.count(F.lit(1)).over(w)).cast("int")
    daily = u.withColumn("layer", layer).groupBy("day", "size", "layer").agg(F.avg("ahead").alias("m"), F.count(F.lit(1)).alias("n"))
    return daily.groupBy("size", "layer").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("samples"), F.round(F.avg("m"), 5).alias("mean"))


_STATE = "CASE scene_stage WHEN 'fail' THEN 0 WHEN 'trigger' THEN 2 WHEN 'confirm' THEN 3 ELSE 1 END"


@query(f"WITH {_FW}, s AS (SELECT st.day, scene, {_STATE} AS state, ahead FROM st JOIN u ON st.code = u.code AND st.day = u.day), e AS (SELECT day, scene, max(state) AS hi, min(state) AS lo FROM s GROUP BY ALL), sp AS (SELECT s.day, s.scene, CASE WHEN max(hi) > min(lo) THEN avg(ahead) FILTER (state = hi) - avg(ahead) FILTER (state = lo) END AS spread FROM s JOIN e ON s.day = e.day AND s.scene = e.scene GROUP BY ALL) SELECT scene, count(spread) AS days, round(avg(spread), 5) AS spread FROM sp GROUP BY scene")
def b17_scene_spread(spark, d):
    """Mean ahead in a day's highest state less that in its lowest."""
    found = sc.scene_stages(universe(spark, d), SCENES, "code", "day", "ahead")
    stage = F.col("scene_stage")
    s = found.withColumn("state", F.when(stage == "fail", 0).when(stage == "trigger", 2).when(stage == "confirm", 3).otherwise(1))
    by_state = s.groupBy("day", "scene", "state").agg(F.avg("ahead").alias("m"))
    sp = by_state.groupBy("day", "scene").agg(F.when(F.max("state") > F.min("state"), F.max_by("m", "state") - F.min_by("m", "state")).alias("spread"))
    return sp.groupBy("scene").agg(F.count("spread").alias("days"), F.round(F.avg("spread"), 5).alias("spread"))


GRID = [(n, level) for n in (5, 10, 20) for level in (7, 8, 9)]
_A3 = "CASE WHEN count(pct) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) = 3 THEN sum(pct) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) END AS ahead"
_MEANS = ", ".join(f"CASE WHEN count(*) OVER m{n} = {n} THEN avg(close) OVER m{n} END AS m{n}" for n in (5, 10, 20))
_MWIN = ", ".join(f"m{n} AS (PARTITION BY code ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 10, 20))


@query(f"WITH {BARS}, x AS (SELECT code, day, close, turnover, {_A3}, {_MEANS} FROM bars WINDOW {_MWIN}), gg AS (" + " UNION ALL ".join(f"SELECT '{n}-{v}' AS combo, ahead FROM x WHERE close > m{n} + 1e-12 AND turnover >= {v} - 1e-12" for n, v in GRID) + ") SELECT combo, count(*) AS hits, count(ahead) AS samples, round(avg(ahead), 5) AS mean, round(count(*) FILTER (ahead > 0) / count(ahead), 6) AS won FROM gg GROUP BY combo")
def b22_parameter_grid(spark, d):
    """All combinations of a parameter grid over one pass: an array of the combinations that hold is exploded."""
    bars = supplier_bars(spark, d)
    ahead = bt.forward(bars, "pct", "code", "day", 3)
    means = {f"m{n}": B.mean(F.col("close"), n) for n in (5, 10, 20)}
    holds = F.array_compact(F.array(*[F.when(m.both(m.gt(F.col("close"), F.col(f"m{n}")), m.ge(F.col("turnover"), v)), F.lit(f"{n}-{v}")) for n, v in GRID]))
    g = bars.withColumns({"ahead": ahead, **means}).select("ahead", F.explode(holds).alias("combo"))
    return g.groupBy("combo").agg(F.count(F.lit(1)).alias("hits"), F.count("ahead").alias("samples"), F.round(F.avg("ahead"), 5).alias("mean"), F.round(F.count_if(F.col("ahead") > 0) / F.count("ahead"), 6).alias("won"))


@query(f"WITH {_RULES}, p(rule, points) AS (VALUES ('above', 0.0), ('crossed', 5.0), ('joined', 0.0), ('hot', -2.0), ('broken', -4.0)), z AS (SELECT code, day, d.rule, score * (code % 2) AS score, points FROM d JOIN p ON p.rule = d.rule) SELECT code, day, rule, CAST(CASE WHEN abs(score) > 1e-12 THEN score WHEN points > 0 THEN 1 WHEN points < 0 THEN -1 ELSE 1 END AS DOUBLE) AS score FROM z")
def b23_normalised(spark, d):
    """A trigger worth 0 counts as the sign of its rule's points, or 1."""
    p = F.broadcast(spark.createDataFrame([("above", 0.0), ("crossed", 5.0), ("joined", 0.0), ("hot", -2.0), ("broken", -4.0)], "rule string, points double"))
    z = details(spark, d).join(p, "rule").withColumn("score", F.col("score") * (F.col("code") % 2))
    sign = F.when(F.col("points") < 0, -1.0).otherwise(1.0)
    return z.select("code", "day", "rule", F.when(F.abs("score") > 1e-12, F.col("score")).otherwise(sign).alias("score"))


_SCOPES = [("last", 1, 1), *[("any", n, 1) for n in (3, 5, 10)], *[("consec", n, k) for k in (2, 3) for n in (3, 5, 10)]]
_RUN = {k: f"(count(*) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} AND bool_and(a) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW))" for k in (2, 3)}


def _scope_sql(scope: str, n: int, k: int) -> str:
    rows = n - k if scope == "consec" else n - 1
    value = {"any": "a", "consec": f"r{k}"}.get(scope)
    hit = f"bool_or({value}) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN {rows} PRECEDING AND CURRENT ROW)" if value else "a"
    return f"SELECT '{scope}-{n}-{k}' AS scope, day, ahead, {hit} AS hit FROM y"


@query(f"WITH {PANEL}, y AS (SELECT *, {_A3}, {_RUN[2]} AS r2, {_RUN[3]} AS r3 FROM h), gg AS (" + " UNION ALL ".join(_scope_sql(*x) for x in _SCOPES) + "), f AS (SELECT scope, year(day) < 1997 AS early, ahead FROM gg WHERE hit AND ahead IS NOT NULL) SELECT scope, count(*) AS n, round(avg(ahead), 5) AS mean, round(avg(ahead) - 1.28 * stddev_samp(ahead) / sqrt(count(*)), 5) AS edge, round(avg(ahead) FILTER (early), 5) AS first_half, round(avg(ahead) FILTER (NOT early), 5) AS second_half FROM f GROUP BY scope")
def b24_calibration(spark, d):
    """Candidate scopes of one condition: mean, conservative edge and both halves of the time."""
    p = panel(spark, d)
    hits = []
    for scope, n, k in _SCOPES:
        a = F.col("a")
        hit = a if scope == "last" else sc.any_of(S, a, n) if scope == "any" else sc.consecutive(S, a, n, k)
        hits.append(F.when(hit, F.lit(f"{scope}-{n}-{k}")))
    rows = p.withColumns({"ahead": bt.forward(p, "pct", "code", "day", 3), "scopes": F.array(*hits)}).where("ahead is not null")
    rows = rows.select("day", "ahead", F.explode(F.array_compact("scopes")).alias("scope"))
    early = F.year("day") < 1997
    half = lambda c: F.round(F.avg(F.when(c, F.col("ahead"))), 5)
    return rows.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ahead"), 5).alias("mean"), F.round(va.conservative_edge(F.col("ahead")), 5).alias("edge"), half(early).alias("first_half"), half(~early).alias("second_half"))


_KV = ", ".join(f"('{name}', {len(w)}, [{', '.join(map(repr, w))}])" for name, w in va.kernel_grid())


@query(f"""WITH {EVENT_SCORES}, ax AS (SELECT day, row_number() OVER (ORDER BY day) AS no FROM (SELECT DISTINCT day FROM sc)), n AS (SELECT code, day, score, no, 100 * ln(lead(score) OVER (PARTITION BY code ORDER BY day) / score) AS ahead FROM sc JOIN ax USING (day)),
kn(kernel, w, weights) AS (VALUES {_KV}), z AS (SELECT kernel, x.code, x.no, sum(y.score * weights[x.no - y.no + 1]) AS smooth, count(*) AS c, any_value(w) AS w FROM n x JOIN kn ON true JOIN n y ON y.code = x.code AND y.no BETWEEN x.no - w + 1 AND x.no GROUP BY kernel, x.code, x.no),
r AS (SELECT kernel, code, no, row_number() OVER (PARTITION BY kernel, no ORDER BY round(smooth, 9) DESC, code) AS r FROM z WHERE c = w), t AS (SELECT kernel, r.no, avg(ahead) AS m FROM r JOIN n ON n.code = r.code AND n.no = r.no WHERE r <= 5 AND ahead IS NOT NULL GROUP BY kernel, r.no),
e AS (SELECT t.*, t.m - raw.m AS delta, t.no <= floor(0.7 * (SELECT max(no) FROM ax)) AS train, t.no > floor(0.7 * (SELECT max(no) FROM ax)) + 1 AS test FROM t LEFT JOIN t raw ON raw.kernel = 'raw' AND raw.no = t.no)
SELECT kernel, count(*) AS days, round(avg(m) FILTER (train), 3) AS train_mean, round(avg(m) FILTER (test), 3) AS test_mean, round(avg(delta), 3) AS delta, round(CASE WHEN stddev_samp(delta) > 1e-9 THEN avg(delta) / stddev_samp(delta) * sqrt(count(delta)) END, 3) AS delta_t FROM e GROUP BY kernel""")
def b25_all_kernels(spark, d):
    """48 kernels: means before and after a chronological split with a gap of one day, and the paired difference to raw."""
    scores = event_scores(spark, d)
    axis = scores.select("day").distinct().withColumn("day_no", F.row_number().over(Window.orderBy("day")))  # one row per day
    ahead = scores.join(axis, "day").select("code", "day_no", (100 * m.ieee_log(m.ieee_div(F.lead("score").over(Window.partitionBy("code").orderBy("day")), F.col("score")))).alias("ahead"))
    best = va.kernel_tops(scores, va.kernel_grid(), "code", "day", "score", 5).join(ahead.where("ahead is not null"), ["code", "day_no"])
    t = best.groupBy("kernel", "day_no").agg(F.avg("ahead").alias("m"))
    raw = F.max(F.when(F.col("kernel") == "raw", F.col("m"))).over(Window.partitionBy("day_no"))
    cut = axis.agg(F.floor(F.max("day_no") * 0.7).alias("cut"))
    e = t.withColumn("delta", F.col("m") - raw).crossJoin(F.broadcast(cut))
    side = lambda c: F.round(F.avg(F.when(c, F.col("m"))), 3)
    std = F.stddev_samp("delta")
    return e.groupBy("kernel").agg(F.count(F.lit(1)).alias("days"), side(F.col("day_no") <= F.col("cut")).alias("train_mean"), side(F.col("day_no") > F.col("cut") + 1).alias("test_mean"), F.round(F.avg("delta"), 3).alias("delta"), F.round(F.when(std > 1e-9, F.avg("delta") / std * F.sqrt(F.count("delta"))), 3).alias("delta_t"))


@query(f"WITH {_RULES}, wn AS (SELECT code, day FROM (SELECT code, day, row_number() OVER (PARTITION BY day ORDER BY pct DESC, code) AS n FROM bars WHERE pct IS NOT NULL) WHERE n <= 20), b AS (SELECT rule, count(*) AS n FROM d JOIN bars ON bars.code = d.code AND bars.day = d.day WHERE pct IS NOT NULL GROUP BY rule), c AS (SELECT rule, count(*) AS n FROM d JOIN wn ON wn.code = d.code AND wn.day = d.day GROUP BY rule), k AS (SELECT (SELECT count(*) FROM wn) AS winners, (SELECT count(*) FROM bars WHERE pct IS NOT NULL) AS everything) SELECT b.rule, coalesce(c.n, 0) AS captured, round(coalesce(c.n, 0) / winners, 6) AS capture, round((coalesce(c.n, 0) / winners) / (b.n / everything), 5) AS lift FROM b LEFT JOIN c ON b.rule = c.rule CROSS JOIN k")
def b30_feature_lift(spark, d):
    """How often each rule held for the day's best 20, against how often it held at all."""
    days = sc.score_panel(panel(spark, d), rules(), ("code", "day", "pct")).where("pct is not null")
    w = Window.partitionBy("day").orderBy(F.desc("pct"), "code")
    days = days.withColumn("won", F.row_number().over(w) <= 20)
    k = days.agg(F.count_if("won").alias("winners"), F.count(F.lit(1)).alias("everything"))
    hit = sc.rule_details(days, "code", "day", "won").groupBy("rule").agg(F.count_if("won").alias("captured"), F.count(F.lit(1)).alias("n"))
    share = F.col("captured") / F.col("winners")
    return hit.crossJoin(F.broadcast(k)).select("rule", "captured", F.round(share, 6).alias("capture"), F.round(share / (F.col("n") / F.col("everything")), 5).alias("lift"))


@query(f"{_DAILY}, ix AS (SELECT day, avg(pct) / 100 AS i FROM bars WHERE pct IS NOT NULL GROUP BY day), j AS (SELECT ix.day, i, coalesce(r, 0) AS r FROM ix LEFT JOIN dr ON dr.day = ix.day) SELECT day, round(ln(exp(sum(ln(1 + r)) OVER (ORDER BY day))), 5) AS log_nav, round(ln(exp(sum(ln(1 + i)) OVER (ORDER BY day))), 5) AS log_index FROM j")
def q09_relative_nav(spark, d):
    """Values of the basket and of the index on the index's days; days without a position return 0. A value of 0 has minus infinity."""
    index = supplier_bars(spark, d).where("pct is not null").groupBy("day").agg((F.avg("pct") / 100).alias("i"))
    j = index.join(daily_returns(spark, d).select("day", "r"), "day", "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    return j.select("day", F.round(m.ieee_log(va.net_value(j, "day", "r")), 5).alias("log_nav"), F.round(m.ieee_log(va.net_value(j, "day", "i")), 5).alias("log_index"))


@query(f"WITH {BARS}, {STOCKS}, n AS (SELECT code, count(*) AS n FROM (SELECT code, lag(close, 2) OVER (PARTITION BY code ORDER BY day) AS c3, close FROM bars) WHERE c3 > 0 AND close > c3 GROUP BY code) SELECT industry, CAST(sum(n) AS BIGINT) AS rises, count(*) AS members FROM n JOIN stocks ON n.code = stocks.code GROUP BY industry")
def b30_industry_rises(spark, d):
    """Intervals of three rows that rose, by industry."""
    rows = supplier_bars(spark, d).select("code", "close", F.lag("close", 2).over(by_code()).alias("c3")).where("c3 > 0 and close > c3")
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(stocks(spark, d), "code").groupBy("industry").agg(F.sum("n").alias("rises"), F.count(F.lit(1)).alias("members"))
