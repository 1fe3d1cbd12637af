"""Back-test queries over the scored bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import scoring as sc
from barloom.queries.market import RANKED
from barloom.queries.scoring import EVENT_SCORES, SCENES, event_scores, total_panel
from barloom.sources.fixtures import STOCKS, stocks, supplier_bars

QUERIES: dict = {}
ORACLE: dict = {}

_RES = f"{RANKED}, {STOCKS}, re AS (SELECT bars.code, day, pct, pct - 0.5 * avg(pct) OVER (PARTITION BY day) - 0.2 * avg(pct) OVER (PARTITION BY day, industry) AS residual FROM bars JOIN stocks ON bars.code = stocks.code WHERE pct IS NOT NULL)"
_FW = f"{_RES}, fw AS (SELECT *, CASE WHEN count(residual) OVER w = 3 THEN sum(residual) OVER w END AS ahead FROM re WINDOW w AS (PARTITION BY code ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)), u AS (SELECT rk.code, rk.day, total, rank, ahead FROM rk JOIN fw ON rk.code = fw.code AND rk.day = fw.day WHERE ahead IS NOT NULL)"
_AVG_RANK = "rank() OVER (PARTITION BY day ORDER BY round({v}, 9)) + (count(*) OVER (PARTITION BY day, round({v}, 9)) - 1) / 2"
_IC = f"{_FW}, rr AS (SELECT day, {_AVG_RANK.format(v='total')} AS ra, {_AVG_RANK.format(v='ahead')} AS rb FROM u), ic AS (SELECT day, count(*) AS n, CASE WHEN var_pop(ra) > 1e-12 AND var_pop(rb) > 1e-12 THEN corr(ra, rb) END AS ic FROM rr GROUP BY day HAVING count(*) >= 3)"
_RD = f"{_FW}, mk AS (SELECT day, count(*) AS n, avg(ahead) AS market FROM u GROUP BY day HAVING count(*) >= 2), rd AS (SELECT rule, d.day, n, count(*) AS hits, sum(score) / n AS avg_score, avg(ahead) AS mean, avg(ahead) - market AS excess FROM d JOIN u ON d.code = u.code AND d.day = u.day JOIN mk ON mk.day = d.day GROUP BY rule, d.day, n, market)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def residuals(spark, d):
    return bt.residual(supplier_bars(spark, d), stocks(spark, d), "code", "day", 0.5, 0.2)


def universe(spark, d):
    """code, day, total, rank, details, industry, market_value and the residual of the next three rows.

    One scored panel: residuals and the next rows by code, then ranks by day where they are used.
    """
    ahead = bt.ahead_of_residuals(total_panel(spark, d).join(stocks(spark, d).drop("name"), "code"), "code", "day", 0.5, 0.2, 3)
    return sc.rank_days(ahead, "code", "day", "total", "j").where("ahead is not null")


def rule_days(spark, d):
    u = universe(spark, d)
    return bt.rule_days(u, sc.rule_details(u, "code", "day", "ahead"), "ahead", "code", "day", 2)


@query(f"WITH {_RES} SELECT code, day, round(residual, 5) AS residual FROM re")
def b01_residual(spark, d):
    return residuals(spark, d).select("code", "day", F.round("residual", 5).alias("residual"))


@query(f"WITH {_FW} SELECT code, day, round(ahead, 5) AS ahead FROM fw WHERE ahead IS NOT NULL")
def b02_forward(spark, d):
    return universe(spark, d).select("code", "day", F.round("ahead", 5).alias("ahead"))


@query(f"WITH {_RD} SELECT rule, day, n, hits, round(avg_score, 5) AS avg_score, round(mean, 5) AS mean, round(excess, 5) AS excess FROM rd")
def b06_rule_day(spark, d):
    return rule_days(spark, d).select("rule", "day", "n", "hits", *[F.round(c, 5).alias(c) for c in ("avg_score", "mean", "excess")])


@query(f"WITH {_IC} SELECT day, n, round(ic, 6) AS ic FROM ic")
def b07_ic(spark, d):
    return bt.daily_ic(universe(spark, d), "total", "ahead", "day").select("day", "n", F.round("ic", 6).alias("ic"))


@query(f"WITH {_FW}, o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total, code) AS i, count(*) OVER (PARTITION BY day) AS m FROM u) SELECT day, CASE WHEN count(*) >= 2 AND max(total) - min(total) >= 1e-12 THEN round(avg(ahead) FILTER (i > m - m // 2) - avg(ahead) FILTER (i <= m // 2), 5) END AS spread FROM o GROUP BY day")
def b08_spread(spark, d):
    return bt.spread(universe(spark, d), "total", "ahead", "code", "day").select("day", F.round("spread", 5).alias("spread"))


@query(f"WITH {_IC}, q AS (SELECT year(day) AS year, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) AS std FROM ic WHERE ic IS NOT NULL GROUP BY ALL) SELECT CAST(year AS INT) AS year, n, round(mean, 5) AS mean, round(std, 5) AS std, round(CASE WHEN std > 1e-12 THEN mean / std END, 5) AS ir, round(CASE WHEN std > 1e-12 THEN mean / std * sqrt(n) END, 5) AS t FROM q")
def b09_icir(spark, d):
    ic = bt.daily_ic(universe(spark, d), "total", "ahead", "day").withColumn("year", F.year("day"))
    return bt.mean_std_t(ic, "ic", "year").select("year", "n", *[F.round(c, 5).alias(c) for c in ("mean", "std", "ir", "t")])


@query(f"WITH {_IC}, y AS (SELECT year(day) AS year, day, ic FROM ic WHERE ic IS NOT NULL), c AS (SELECT *, ic - avg(ic) OVER (PARTITION BY year) AS c FROM y), l AS (SELECT *, c * c AS g0, c * lag(c, 1) OVER w AS g1, c * lag(c, 2) OVER w AS g2 FROM c WINDOW w AS (PARTITION BY year ORDER BY day)), s AS (SELECT year, count(*) AS n, avg(ic) AS mean, sum(g0) AS s0, coalesce(sum(g1), 0) AS s1, coalesce(sum(g2), 0) AS s2, least(2, count(*) - 1) AS k FROM l GROUP BY year), v AS (SELECT *, (s0 + CASE WHEN k >= 1 THEN 2 * (1 - 1 / (k + 1)) * s1 ELSE 0 END + CASE WHEN k >= 2 THEN 2 * (1 - 2 / (k + 1)) * s2 ELSE 0 END) / n / n AS var FROM s) SELECT CAST(year AS INT) AS year, n, round(mean, 5) AS mean, CASE WHEN var > 1e-12 THEN round(mean / sqrt(var), 4) END AS t FROM v")
def b10_newey_west(spark, d):
    ic = bt.daily_ic(universe(spark, d), "total", "ahead", "day").withColumn("year", F.year("day"))
    return bt.newey_west(ic, "ic", "day", "year", 2).select("year", "n", F.round("mean", 5).alias("mean"), F.round("t", 4).alias("t"))


def _layers(expr: str) -> str:
    return f"WITH {_FW}, la AS (SELECT day, ahead, CAST({expr} AS INT) AS layer FROM u), dm AS (SELECT day, layer, avg(ahead) AS m, count(*) AS n FROM la GROUP BY ALL) SELECT layer, count(*) AS days, CAST(sum(n) AS BIGINT) AS samples, round(avg(m), 5) AS mean FROM dm GROUP BY layer"


@query(_layers("(row_number() OVER (PARTITION BY day ORDER BY total, rank DESC) - 1) * 5 // count(*) OVER (PARTITION BY day)"))
def b11_layers_count(spark, d):
    return bt.layer_means(universe(spark, d), bt.layer_by_count("total", "rank", "day", 5), "ahead", "day")


@query(_layers("CASE WHEN max(total) OVER (PARTITION BY day) - min(total) OVER (PARTITION BY day) < 1e-12 THEN 0 ELSE least(floor((total - min(total) OVER (PARTITION BY day)) / (max(total) OVER (PARTITION BY day) - min(total) OVER (PARTITION BY day)) * 5), 4) END"))
def b12_layers_range(spark, d):
    return bt.layer_means(universe(spark, d), bt.layer_by_range("total", "day", 5), "ahead", "day")


@query(_layers("((max(rank) OVER (PARTITION BY day) - rank + 1) * 5 - 1) // max(rank) OVER (PARTITION BY day)"))
def b13_layers_rank(spark, d):
    return bt.layer_means(universe(spark, d), bt.layer_by_rank("rank", "day", 5), "ahead", "day")


@query(f"WITH {_FW}, ts AS (SELECT k, day, avg(ahead) AS m FROM u JOIN (VALUES (1), (5), (20)) x(k) ON rank <= k GROUP BY ALL) SELECT k, count(*) AS days, round(avg(m), 5) AS mean, round(quantile_cont(m, 0.5), 5) AS median, round(count(*) FILTER (m > 0) / count(*), 6) AS positive, round(stddev_samp(m), 5) AS std FROM ts GROUP BY k")
def b15_topk(spark, d):
    s = bt.top_series(universe(spark, d), (1, 5, 20), "rank", "ahead", "day")
    return s.groupBy("k").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("m"), 5).alias("mean"), F.round(F.percentile("m", 0.5), 5).alias("median"), F.round(F.count_if(F.col("m") > 0) / F.count(F.lit(1)), 6).alias("positive"), F.round(F.stddev_samp("m"), 5).alias("std"))


@query(f"WITH {_FW}, sl AS (SELECT st.day, scene, coalesce(scene_stage, 'other') AS state, avg(ahead) AS m, count(*) AS n FROM st JOIN u ON st.code = u.code AND st.day = u.day GROUP BY ALL) SELECT scene, state, count(*) AS days, CAST(sum(n) AS BIGINT) AS samples, round(avg(m), 5) AS mean FROM sl GROUP BY ALL")
def b17_scene_layers(spark, d):
    found = sc.scene_stages(universe(spark, d), SCENES, "code", "day", "ahead")
    s = found.groupBy("day", "scene", F.coalesce("scene_stage", F.lit("other")).alias("state")).agg(F.avg("ahead").alias("m"), F.count(F.lit(1)).alias("n"))
    return s.groupBy("scene", "state").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("samples"), F.round(F.avg("m"), 5).alias("mean"))


@query(f"WITH {_RD}, dv AS (SELECT rule, excess * CASE WHEN sum(avg_score) OVER (PARTITION BY rule) < 0 THEN -1 ELSE 1 END AS v, row_number() OVER (PARTITION BY rule ORDER BY day DESC) AS back FROM rd), dg AS (SELECT rule, k AS span, count(*) FILTER (back <= k) AS n1, count(*) FILTER (back > k) AS n0, avg(v) FILTER (back <= k) AS a1, avg(v) FILTER (back > k) AS a0, var_samp(v) FILTER (back <= k) AS v1, var_samp(v) FILTER (back > k) AS v0 FROM dv CROSS JOIN (VALUES (20), (40), (60)) x(k) GROUP BY ALL) SELECT rule, span, n0 AS prior_days, round(a1, 5) AS recent, round(a0, 5) AS prior, CASE WHEN sqrt(v1 / n1 + v0 / n0) > 1e-12 THEN round((a1 - a0) / sqrt(v1 / n1 + v0 / n0), 4) END AS t FROM dg WHERE n0 >= 10")
def b20_decay(spark, d):
    return bt.decay(rule_days(spark, d), "rule", "day")


KERNELS = {f"exp{n}_{h}": (n, h) for n in (3, 5) for h in (1.0, 2.0)}


def _kernel_sql(name: str) -> str:
    n, h = KERNELS[name]
    k = sc.exponential_kernel(n, h)
    smooth = " + ".join(f"lag(score, {i}) OVER w * {v!r}" for i, v in enumerate(k))
    return f"SELECT '{name}' AS kernel, code, day, {smooth} AS smooth, lag(no, {n - 1}) OVER w AS oldest, no FROM x WINDOW w AS (PARTITION BY code ORDER BY no)"


@query(f"WITH {EVENT_SCORES}, ax AS (SELECT day, row_number() OVER (ORDER BY day) AS no FROM (SELECT DISTINCT day FROM sc)), x AS (SELECT sc.*, no FROM sc JOIN ax USING (day)), nx AS (SELECT code, day, lead(score) OVER (PARTITION BY code ORDER BY day) - score AS ahead FROM sc), kk AS ({' UNION ALL '.join(f'({_kernel_sql(n)})' for n in KERNELS)}), rk AS (SELECT kernel, code, day, row_number() OVER (PARTITION BY kernel, day ORDER BY smooth DESC, code) AS r FROM kk WHERE CASE kernel {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN oldest = no - {v[0] - 1}' for n, v in KERNELS.items())} END) SELECT kernel, count(*) AS samples, round(avg(ahead), 5) AS mean FROM rk JOIN nx ON rk.code = nx.code AND rk.day = nx.day WHERE r <= 5 AND ahead IS NOT NULL GROUP BY kernel")
def b25_kernel_grid(spark, d):
    """Mean change after the best five of each day, for every kernel of the grid."""
    from functools import reduce

    from pyspark.sql import Window

    scores = event_scores(spark, d)
    ahead = scores.select("code", "day", (F.lead("score").over(Window.partitionBy("code").orderBy("day")) - F.col("score")).alias("ahead"))
    grid = [sc.convolution_rank(scores, sc.exponential_kernel(n, h), "code", "day", "score").where("conv_rank <= 5").select(F.lit(name).alias("kernel"), "code", "day") for name, (n, h) in KERNELS.items()]
    best = reduce(lambda a, b: a.unionByName(b), grid).join(ahead.where("ahead is not null"), ["code", "day"])
    return best.groupBy("kernel").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("ahead"), 5).alias("mean"))
