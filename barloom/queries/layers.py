"""Whole back-tests of rules, ranks and scenes; the SQL makes the untriggered rows that the operators only count."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import calibration as ca
from barloom.operators import layers as la
from barloom.operators import scoring as sc
from barloom.queries.backtest import _FW, _IC, universe
from barloom.queries.scoring import SCENES, S, panel, rules
from barloom.queries.validation import _LC, _nw, b04_er_change
from barloom.queries.validation import ORACLE as VALIDATION_SQL
from barloom.sources.fixtures import stocks
from barloom.sources.store import kept

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df, *keys, **digits):
    """``keys`` and the other columns to so many digits, zero without a sign."""
    return df.select(*keys, *[(F.round(c, n) + 0.0).alias(c) for c, n in digits.items()])


RULE_NAMES = ["above", "crossed", "joined", "hot", "broken"]
_RR = "rank() OVER (PARTITION BY {by} ORDER BY round({v}, 9)) + (count(*) OVER (PARTITION BY {by}, round({v}, 9)) - 1) / 2"
_POINTS = f"""{_FW}, mk AS (SELECT day, count(*) AS n, avg(ahead) AS market FROM u GROUP BY day HAVING count(*) >= 2),
ur AS (SELECT x.rule, u.code, u.day, ahead, n, market, d.score AS hit, coalesce(d.score, 0) AS score FROM u JOIN mk ON mk.day = u.day
  CROSS JOIN (SELECT unnest({RULE_NAMES!r}) AS rule) x LEFT JOIN d ON d.rule = x.rule AND d.code = u.code AND d.day = u.day),
ux AS (SELECT *, {_RR.format(by='rule, day', v='score')} AS rx, {_RR.format(by='rule, day', v='ahead')} AS ry, row_number() OVER (PARTITION BY rule, day ORDER BY round(score, 9), code) AS o FROM ur),
pt AS (SELECT rule, day, n, count(hit) AS hits, sum(score) / n AS avg_score, avg(ahead) FILTER (hit IS NOT NULL) AS mean, avg(ahead) FILTER (hit IS NOT NULL) - market AS excess,
  CASE WHEN max(score) - min(score) >= 1e-12 THEN avg(ahead) FILTER (o > n - n // 2) - avg(ahead) FILTER (o <= n // 2) END AS spread,
  CASE WHEN var_pop(rx) > 1e-12 AND var_pop(ry) > 1e-12 THEN corr(rx, ry) END AS ic FROM ux GROUP BY rule, day, n, market)"""


def points(spark, d):
    assert [r.name for r in rules()] == RULE_NAMES
    return la.rule_points(universe(spark, d), RULE_NAMES, "ahead", "code", "day", 2)


@query(f"WITH {_POINTS} SELECT rule, day, n, hits, round(avg_score, 5) AS avg_score, round(mean, 5) AS mean, round(excess, 5) AS excess, round(spread, 5) AS spread, round(ic, 6) AS ic FROM pt")
def b06_rule_points(spark, d):
    """Every rule on every day, rank correlation and spread over the whole universe."""
    return rounded(points(spark, d), "rule", "day", "n", "hits", avg_score=5, mean=5, excess=5, spread=5, ic=6)


@query(f"WITH {_POINTS}, summed AS (SELECT rule, count(*) AS days, avg(spread) AS spread_mean, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(ic) AS k FROM pt GROUP BY rule) SELECT rule, days, round(spread_mean, 5) AS spread_mean, round(ic_mean, 5) AS ic_mean, round(ic_std, 5) AS ic_std, round(CASE WHEN ic_std > 1e-12 THEN ic_mean / ic_std END, 5) AS icir, round(CASE WHEN ic_std > 1e-12 THEN ic_mean / ic_std * sqrt(k) END, 4) AS ic_t FROM summed")
def b06_rule_summary(spark, d):
    return rounded(la.summary(kept(points(spark, d), "points"), "rule", "day"), "rule", "days", spread_mean=5, ic_mean=5, ic_std=5, icir=5, ic_t=4)


@query(f"WITH {_IC}, o AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY total, code) AS i, count(*) OVER (PARTITION BY day) AS m FROM u), sp AS (SELECT day, CASE WHEN count(*) >= 2 AND max(total) - min(total) >= 1e-12 THEN avg(ahead) FILTER (i > m - m // 2) - avg(ahead) FILTER (i <= m // 2) END AS spread FROM o GROUP BY day), pt AS (SELECT 'total' AS score, ic.day, ic, spread FROM ic JOIN sp ON sp.day = ic.day), {_nw('pt', 'score', 'ic', 2)} SELECT g.score, days, round(spread_mean, 5) AS spread_mean, round(ic_mean, 5) AS ic_mean, round(ic_std, 5) AS ic_std, round(ic_mean / ic_std, 5) AS icir, round(t, 4) AS ic_t FROM (SELECT score, count(*) AS days, avg(spread) AS spread_mean, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std FROM pt GROUP BY score) g JOIN nw ON nw.score = g.score")
def b14_rank_totals(spark, d):
    """The whole series of daily rank correlations and spreads of the total score."""
    daily = la.rank_points(universe(spark, d), "total", "ahead", "code", "day", 3).withColumn("score", F.lit("total"))
    return rounded(la.summary(daily, "score", "day", 2), "score", "days", spread_mean=5, ic_mean=5, ic_std=5, icir=5, ic_t=4)


@query(f"WITH {_FW}, er AS ({VALIDATION_SQL['b04_er_change']}), la AS (SELECT u.code, u.day, {_LC.format(by='')} AS layer, total, ahead FROM u), dm AS (SELECT la.day, layer, count(*) AS n, avg(total) AS s, avg(ahead) AS m, sum(change) AS c, count(change) AS k FROM la LEFT JOIN er ON er.code = la.code AND er.day = la.day GROUP BY ALL) SELECT layer, count(*) AS days, CAST(sum(n) AS BIGINT) AS samples, round(avg(s), 5) AS avg_score, round(avg(m), 5) AS mean, round(sum(c) / nullif(sum(k), 0), 5) AS er_change FROM dm GROUP BY layer")
def b14_rank_layers(spark, d):
    """Layers of the total score with their scores, returns and changes of the efficiency ratio."""
    u = universe(spark, d).join(b04_er_change(spark, d), ["code", "day"], "left")
    out = la.rank_layers(u, bt.layer_by_count("total", "rank", "day", 5), "total", "ahead", "change", "day")
    return rounded(out, "layer", "days", "samples", avg_score=5, mean=5, er_change=5)


_PLACE = "CASE coalesce(scene_stage, 'unknown') WHEN 'fail' THEN 0 WHEN 'trigger' THEN 2 WHEN 'confirm' THEN 3 ELSE 1 END"


@query(f"WITH {_FW}, sr AS (SELECT scene, u.day, ahead, coalesce(scene_stage, 'unknown') AS state, {_PLACE} AS place FROM st JOIN u ON st.code = u.code AND st.day = u.day), sx AS (SELECT *, {_RR.format(by='scene, day', v='place')} AS rx, {_RR.format(by='scene, day', v='ahead')} AS ry FROM sr), ic AS (SELECT scene, day, count(*) AS n, CASE WHEN var_pop(rx) > 1e-12 AND var_pop(ry) > 1e-12 THEN corr(rx, ry) END AS ic FROM sx GROUP BY ALL HAVING count(*) >= 2), ms AS (SELECT scene, day, state, place, avg(ahead) AS m FROM sr GROUP BY ALL), sp AS (SELECT scene, day, CASE WHEN count(*) >= 2 THEN arg_max(m, (place, state)) - arg_min(m, (place, state)) END AS spread FROM ms GROUP BY ALL) SELECT ic.scene, ic.day, n, round(spread, 5) AS spread, round(ic, 6) AS ic FROM ic JOIN sp ON sp.scene = ic.scene AND sp.day = ic.day")
def b17_scene_points(spark, d):
    found = sc.scene_stages(universe(spark, d), SCENES, "code", "day", "ahead")
    return rounded(la.scene_points(found, "ahead", "day"), "scene", "day", "n", spread=5, ic=6)


@query(f"WITH {_POINTS}, dv AS (SELECT rule, v, row_number() OVER (PARTITION BY rule ORDER BY day DESC) AS back FROM (SELECT rule, day, excess * CASE WHEN sum(avg_score) OVER (PARTITION BY rule) < 0 THEN -1 ELSE 1 END AS v FROM pt) WHERE v IS NOT NULL), dg AS (SELECT rule, k AS span, count(*) FILTER (back <= k) AS recent_days, count(*) FILTER (back > k) AS prior_days, avg(v) FILTER (back <= k) AS a1, avg(v) FILTER (back > k) AS a0, var_samp(v) FILTER (back <= k) AS v1, var_samp(v) FILTER (back > k) AS v0 FROM dv CROSS JOIN (VALUES (20), (40), (60), (100000)) x(k) GROUP BY ALL), ds AS (SELECT *, recent_days = span AND prior_days >= 10 AS ok, sqrt(v1 / recent_days + v0 / prior_days) AS e FROM dg), dt AS (SELECT rule, span, recent_days, prior_days, CASE WHEN ok THEN a1 END AS recent, CASE WHEN ok THEN a0 END AS prior, CASE WHEN ok THEN a1 - a0 END AS change, CASE WHEN ok AND e > 1e-12 THEN (a1 - a0) / e END AS t FROM ds) SELECT rule, span, recent_days, prior_days, round(recent, 5) AS recent, round(prior, 5) AS prior, round(change, 5) AS change, round(t, 4) AS t, CASE WHEN change IS NULL THEN 'insufficient' WHEN change < -1e-9 AND t <= -2 THEN 'significant_decay' WHEN change < -1e-9 AND recent < -1e-9 THEN 'decay' WHEN change < -1e-9 THEN 'weakening' WHEN recent < -1e-9 THEN 'weak' WHEN change > 1e-9 THEN 'improving' ELSE 'stable' END AS status FROM dt")
def b20_decay_status(spark, d):
    """Every window of every rule, those with too few days as well."""
    return rounded(la.decay_status(points(spark, d), "rule", "day", (20, 40, 60, 100_000)), "rule", "span", "recent_days", "prior_days", "status", recent=5, prior=5, change=5, t=4)


def _scope_sql(c) -> str:
    """Score of a candidate in every row of h, null where it doesn't trigger."""
    w = "OVER (PARTITION BY code ORDER BY day ROWS BETWEEN {} PRECEDING AND CURRENT ROW)".format
    run = f"(sum(CAST(a AS INT)) {w(c.run - 1)} = {c.run})"
    if c.scope == "each":
        return f"nullif(CAST(sum(CAST(a AS INT)) {w(c.rows - 1)} AS DOUBLE), 0)"
    if c.scope == "recent":
        return "CASE " + " ".join(f"WHEN coalesce(lag(a, {i}) OVER (PARTITION BY code ORDER BY day), false) THEN {p!r}" for i, p in enumerate(ca.decay_points(c.rows))) + " END"
    found = {"last": "a", "any": f"bool_or(a) {w(c.rows - 1)}", "consec": run}[c.scope]
    return f"CASE WHEN {found} THEN 1.0::DOUBLE END" if c.scope != "consec" else f"CASE WHEN bool_or(r{c.run}) {w(c.rows - c.run)} THEN 1.0::DOUBLE END"


_RUNS = ", ".join(f"sum(CAST(a AS INT)) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) = {k} AS r{k}" for k in (2, 3))
_CAND = " UNION ALL ".join(f"SELECT '{c.name}' AS rule, code, day, {_scope_sql(c)} AS score FROM hr" for c in ca.CANDIDATES)
_SCOPE_OF = "split_part(rule, '-', 1)"
_HALF = "round({} * 2) / 2"
_CALIBRATION = f"""{_FW}, hr AS (SELECT code, day, a, {_RUNS} FROM h), cd AS (SELECT * FROM ({_CAND}) WHERE score IS NOT NULL),
mk AS (SELECT day, count(*) AS n, avg(ahead) AS market FROM u GROUP BY day HAVING count(*) >= 2),
ur AS (SELECT x.rule, u.code, u.day, ahead, n, market, cd.score AS hit, coalesce(cd.score, 0) AS score FROM u JOIN mk ON mk.day = u.day CROSS JOIN (SELECT DISTINCT rule FROM cd) x LEFT JOIN cd ON cd.rule = x.rule AND cd.code = u.code AND cd.day = u.day),
ux AS (SELECT *, {_RR.format(by='rule, day', v='score')} AS rx, {_RR.format(by='rule, day', v='ahead')} AS ry FROM ur),
pt AS (SELECT rule, day, avg(ahead) FILTER (hit IS NOT NULL) AS mean, avg(ahead) FILTER (hit IS NOT NULL) - market AS excess, CASE WHEN var_pop(rx) > 1e-12 AND var_pop(ry) > 1e-12 THEN corr(rx, ry) END AS ic FROM ux GROUP BY rule, day, market),
pn AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY day) <= count(*) OVER (PARTITION BY rule) // 2 AS early FROM pt WHERE excess IS NOT NULL),
da AS (SELECT rule, count(*) AS nd, avg(mean) AS residual_mean, avg(excess) AS excess_mean, stddev_samp(excess) AS daily_std, avg(excess) FILTER (early) AS early_mean, avg(excess) FILTER (NOT early) AS late_mean FROM pn GROUP BY rule),
ii AS (SELECT rule, avg(ic) AS ic_mean, CASE WHEN stddev_samp(ic) > 1e-12 THEN avg(ic) / stddev_samp(ic) * sqrt(count(ic)) END AS ic_t FROM pt WHERE ic IS NOT NULL GROUP BY rule),
hh AS (SELECT cd.rule, cd.day, cd.score, ahead FROM cd JOIN u ON u.code = cd.code AND u.day = cd.day),
bs AS (SELECT rule, score, avg(ahead) AS r, lag(avg(ahead)) OVER (PARTITION BY rule ORDER BY score) AS b FROM hh GROUP BY rule, score HAVING count(*) >= 30),
mo AS (SELECT rule, count(*) FILTER (r + 1e-12 >= b) / nullif(count(b), 0) AS monotonicity FROM bs GROUP BY rule),
se AS (SELECT rule, count(*) AS samples, count(DISTINCT day) AS days, avg(score) AS multiplier FROM hh GROUP BY rule),
g5 AS (SELECT *, excess_mean - 1.28 * daily_std / sqrt(nd) AS edge, CASE WHEN early_mean > 1e-9 AND late_mean > 1e-9 THEN 1.0 WHEN early_mean > 1e-9 OR late_mean > 1e-9 THEN 0.5 ELSE 0.0 END * CASE {_SCOPE_OF} WHEN 'each' THEN greatest(0.25, coalesce(monotonicity, 0.25)) WHEN 'recent' THEN 0.5 + coalesce(monotonicity, 0.5) * 0.5 ELSE 1.0 END AS weight,
  early_mean > 1e-9 AND late_mean > 1e-9 AS stable, samples >= 100 AND days >= 20 AS enough FROM se LEFT JOIN da USING (rule) LEFT JOIN ii USING (rule) LEFT JOIN mo USING (rule)),
g6 AS (SELECT *, CASE WHEN edge > 1e-9 AND daily_std > 1e-12 THEN edge / daily_std ELSE 0 END AS unit FROM g5),
g7 AS (SELECT *, CASE WHEN NOT enough THEN 'insufficient' WHEN NOT coalesce(edge > 1e-9, false) THEN 'no_edge' WHEN NOT stable THEN 'unstable' ELSE 'reliable' END AS status,
  CASE WHEN enough THEN (unit + CASE WHEN ic_t > 0 THEN ic_t / sqrt(nd) ELSE 0 END * 0.15) * weight ELSE 0 END AS calibration_score, CASE WHEN enough THEN {_HALF.format('least(10.0, 40 * unit * weight)')} ELSE 0 END AS total_points FROM g6)
SELECT rule, samples, days, round(residual_mean, 5) AS residual_mean, round(excess_mean, 5) + 0.0 AS excess_mean, round(daily_std, 4) AS daily_std, round(edge, 5) + 0.0 AS edge, round(early_mean, 5) + 0.0 AS early_mean, round(late_mean, 5) + 0.0 AS late_mean, round(ic_mean, 5) AS ic_mean, round(ic_t, 4) AS ic_t, round(monotonicity, 6) AS monotonicity, round(multiplier, 6) AS multiplier,
  {_HALF.format('least(10.0, total_points / multiplier)')} AS points, total_points::DOUBLE AS total_points, round(calibration_score, 6) AS calibration_score, status,
  row_number() OVER (ORDER BY CASE status WHEN 'reliable' THEN 0 WHEN 'unstable' THEN 1 ELSE 2 END, calibration_score DESC, rule) = 1 AND status IN ('reliable', 'unstable') AS best FROM g7"""


@query(f"WITH {_CALIBRATION}")
def b24_all_scopes(spark, d):
    """Sixteen scopes of one condition, with suggested points and the one to take."""
    scopes = panel(spark, d).select("code", "day", "pct", ca.candidate_scores(S, F.col("a"), ca.CANDIDATES, 1.0).alias("scores"))
    ahead = bt.ahead_of_residuals(scopes.join(stocks(spark, d).select("code", "industry"), "code"), "code", "day", 0.5, 0.2, 3)
    u = kept(ahead.where("ahead is not null").select("code", "day", "ahead", "scores"), "scopes")
    out = ca.calibrate(u, ca.CANDIDATES, 1.0, "ahead", "code", "day", 2)
    return rounded(out, "rule", "samples", "days", "status", "best", "points", "total_points", residual_mean=5, excess_mean=5, daily_std=4, edge=5, early_mean=5, late_mean=5, ic_mean=5, ic_t=4, monotonicity=6, multiplier=6, calibration_score=6)
