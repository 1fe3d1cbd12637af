"""Scoring and ranking queries over the supplier bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import semantics as m
from barloom.functions.series import Series
from barloom.operators import scoring as sc
from barloom.sources.fixtures import BARS, supplier_bars

S = Series("code", "day")
W = "OVER (PARTITION BY code ORDER BY day)"
TABLE = [(0, 0, 5.0), (1, 2, 3.0), (3, 4, 1.0)]
SCENES = [sc.Scene("trend", True, 1.0, 3.0, 6.0, 4.0), sc.Scene("heat", False, 1.0, 2.0, 4.0, 3.0)]


def panel(spark, sf_dir):
    """code, day, close and three conditions: above its 5-day mean, crossing its 10-day mean, high turnover."""
    bars = supplier_bars(spark, sf_dir)
    close = F.col("close")
    return bars.select("code", "day", "close", "pct", F.col("turnover").alias("j"), m.gt(close, S.mean(close, 5)).alias("a"), S.cross(close, S.mean(close, 10)).alias("b"), m.ge(F.col("turnover"), 8).alias("t"))


PANEL = f"""{BARS},
m AS (SELECT code, day, close, pct, turnover AS j, CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 END AS m5, CASE WHEN count(*) OVER w10 = 10 THEN avg(close) OVER w10 END AS m10
      FROM bars WINDOW w5 AS (PARTITION BY code ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w10 AS (PARTITION BY code ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
h AS (SELECT code, day, close, pct, j, coalesce(close > m5 + 1e-12, false) AS a, coalesce(close > m10 AND lag(close) {W} <= lag(m10) {W}, false) AS b, coalesce(j >= 8 - 1e-12, false) AS t, row_number() {W} AS n FROM m)"""


def _win(v: str, n: int) -> str:
    return f"list({v}) OVER (PARTITION BY code ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _rule(make):
    def query(spark, sf_dir):
        r = make(*map(F.col, "abt"))
        return panel(spark, sf_dir).select("code", "day", F.round(r.score, 6).alias("score"), r.triggered.alias("triggered"))

    return query


def _sql(score: str, triggered: str, extra: str = "") -> str:
    return f"WITH {PANEL}{extra} SELECT code, day, CAST({score} AS DOUBLE) AS score, {triggered} AS triggered FROM "


_PTS = "CASE WHEN {d} = 0 THEN 5 WHEN {d} BETWEEN 1 AND 2 THEN 3 WHEN {d} BETWEEN 3 AND 4 THEN 1 ELSE 0 END"
_L5 = f"(SELECT *, {_win('b', 5)} AS l FROM h)"
_HITS = "CAST(a AS INT) + CAST(b AS INT) + CAST(t AS INT)"
_BASE = "CASE {h} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 5 END"
_BONUS = "CASE WHEN t THEN 2 ELSE 0 END"
BY_HITS = [0.0, 1.0, 3.0, 5.0]
_C = f"(SELECT *, {_HITS} AS hits, {_BONUS} AS bonus FROM h)"
_SUM5 = f"CAST(sum({_BASE.format(h='hits')}) OVER c5 AS DOUBLE)"


def r11_total(spark, sf_dir):
    return total_panel(spark, sf_dir).select("code", "day", F.round("total", 6).alias("total"))


def conditions(a, b, t):
    return [(a, 0.0), (b, 0.0), (t, 2.0)]


def rules():
    a, b, t = map(F.col, "abt")
    return [
        sc.Rule("above", "trend", "base", sc.flat(a, 1.0)),
        sc.Rule("crossed", "trend", "trigger", sc.each(S, b, 5, table=TABLE, most=6.0)),
        sc.Rule("joined", "trend", "confirm", sc.combination(S, conditions(a, b, t), BY_HITS)),
        sc.Rule("hot", "heat", "trigger", sc.flat(sc.any_of(S, t, 3), -2.0)),
        sc.Rule("broken", "trend", "fail", sc.flat(~a & t, -4.0)),
    ]


def total_panel(spark, sf_dir):
    return sc.score_panel(panel(spark, sf_dir), rules(), ("code", "day", "close", "pct", "j"))


_EACH = f"least(list_sum(list_transform(range(0, 5), lambda d: CASE WHEN len(lb) > d AND lb[len(lb) - d] THEN {_PTS.format(d='d')} ELSE 0 END)), 6)"
_RULES = f"""{PANEL},
r AS (SELECT *, {_HITS} AS hits, {_win('b', 5)} AS lb, {_win('t', 3)} AS lt FROM h),
d AS MATERIALIZED (SELECT code, day, 'above' AS rule, 'trend' AS scene, 'base' AS stage, 1.0::DOUBLE AS score FROM r WHERE a
  UNION ALL SELECT code, day, 'crossed', 'trend', 'trigger', CAST({_EACH} AS DOUBLE) FROM r WHERE list_contains(lb, true)
  UNION ALL SELECT code, day, 'joined', 'trend', 'confirm', CAST({_BASE.format(h='hits')} + {_BONUS} AS DOUBLE) FROM r WHERE hits > 0
  UNION ALL SELECT code, day, 'hot', 'heat', 'trigger', -2.0 FROM r WHERE list_contains(lt, true)
  UNION ALL SELECT code, day, 'broken', 'trend', 'fail', -4.0 FROM r WHERE NOT a AND t),
tot AS MATERIALIZED (SELECT h.code, h.day, h.close, h.pct, h.j, 50 + coalesce(sum(score), 0) AS total FROM h LEFT JOIN d ON h.code = d.code AND h.day = d.day GROUP BY ALL),
gs AS (SELECT code, day, scene, coalesce(sum(score) FILTER (stage NOT IN ('risk', 'fail')), 0) AS stage_score, coalesce(sum(score) FILTER (stage IN ('risk', 'fail')), 0) AS risk_score,
      bool_or(stage = 'trigger') AS ht, bool_or(stage = 'confirm') AS hc, bool_or(stage = 'fail') AS hf FROM d GROUP BY ALL),
st AS (SELECT *, CASE WHEN scene = 'trend' THEN CASE WHEN hf AND risk_score <= -4 THEN 'fail' WHEN hc AND stage_score >= 6 THEN 'confirm' WHEN ht AND stage_score >= 3 THEN 'trigger' WHEN ht AND stage_score >= 1 THEN 'observe' END
      ELSE CASE WHEN hf AND risk_score >= 3 THEN 'fail' WHEN hc AND stage_score <= -4 THEN 'confirm' WHEN ht AND stage_score <= -2 THEN 'trigger' WHEN ht AND stage_score <= -1 THEN 'observe' END END AS scene_stage,
      abs(stage_score) / CASE WHEN scene = 'trend' THEN 6.0 ELSE 4.0 END AS confirm_strength, abs(risk_score) / CASE WHEN scene = 'trend' THEN 4.0 ELSE 3.0 END AS risk_intensity FROM gs)"""


def details(spark, sf_dir):
    return sc.rule_details(total_panel(spark, sf_dir), "code", "day")


def stages(spark, sf_dir):
    """Scene rows with the total of their scored row."""
    return sc.scene_stages(total_panel(spark, sf_dir), SCENES, "code", "day", "total")


def r12_details(spark, sf_dir):
    return details(spark, sf_dir)


def r13_scene_stage(spark, sf_dir):
    return stages(spark, sf_dir).select("code", "day", "scene", "stage_score", "risk_score", "scene_stage", F.round("confirm_strength", 6).alias("confirm_strength"), F.round("risk_intensity", 6).alias("risk_intensity"))


def r16_rank_tiebreak(spark, sf_dir):
    return sc.rank_days(total_panel(spark, sf_dir), "code", "day", "total", "j").select("code", "day", "total", "rank")


def r17_rank_plain(spark, sf_dir):
    return sc.rank_days(total_panel(spark, sf_dir), "code", "day", "total").select("code", "day", "rank")


def r18_scene_rank(spark, sf_dir):
    return sc.rank_scenes(stages(spark, sf_dir), "code", "day").select("code", "day", "scene", "scene_rank")


def event_scores(spark, sf_dir):
    """Score per user and day, for smoothing over consecutive days."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("user_id").alias("code"), F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("score"))


EVENT_SCORES = "sc AS (SELECT user_id AS code, CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS score FROM events GROUP BY ALL)"
K3 = [0.5, 0.3, 0.2]


def r20_convolution(spark, sf_dir):
    out = sc.convolution_rank(event_scores(spark, sf_dir), K3, "code", "day", "score")
    return out.select("code", "day", "score", F.round("smooth", 5).alias("smooth"), "raw_rank", "conv_rank", "change")


def r20_kernel_h30(spark, sf_dir):
    out = sc.convolution_rank(event_scores(spark, sf_dir), sc.kernel_h30(), "code", "day", "score")
    return out.select("code", "day", F.round("smooth", 4).alias("smooth"))


def r21_convolution_one_date(spark, sf_dir):
    out = sc.convolution_rank_on(event_scores(spark, sf_dir), [5.0, 3.0, 2.0], "code", "day", "score", F.lit("2024-01-20").cast("date"))
    return out.select("code", "day", "score", F.round("smooth", 5).alias("smooth"), "raw_rank", "conv_rank", "change")


_CONV = f"""{EVENT_SCORES},
ax AS (SELECT day, row_number() OVER (ORDER BY day) AS no FROM (SELECT DISTINCT day FROM sc)),
l AS (SELECT sc.*, no, score * 0.5 + lag(score, 1) OVER w * 0.3 + lag(score, 2) OVER w * 0.2 AS smooth, lag(no, 2) OVER w AS oldest FROM sc JOIN ax USING (day) WINDOW w AS (PARTITION BY code ORDER BY no)),
f AS (SELECT * FROM l WHERE oldest = no - 2),
k AS (SELECT code, day, score, smooth, row_number() OVER (PARTITION BY day ORDER BY score DESC, code) AS raw_rank, row_number() OVER (PARTITION BY day ORDER BY smooth DESC, code) AS conv_rank FROM f)"""

QUERIES = {
    "r01_last": _rule(lambda a, b, t: sc.flat(a, 2.0)),
    "r02_any": _rule(lambda a, b, t: sc.flat(sc.any_of(S, b, 4), 2.0)),
    "r03_consec": _rule(lambda a, b, t: sc.flat(sc.consecutive(S, a, 6, 3), 2.0)),
    "r04_each": _rule(lambda a, b, t: sc.each(S, b, 5, 2.0)),
    "r04_each_dist": _rule(lambda a, b, t: sc.each(S, b, 5, table=TABLE)),
    "r05_recent_dist": _rule(lambda a, b, t: sc.recent(S, b, 5, table=TABLE)),
    "r07_cap": _rule(lambda a, b, t: sc.each(S, a, 5, 2.0, most=5.0)),
    "r09_combo_last": _rule(lambda a, b, t: sc.combination(S, conditions(a, b, t), BY_HITS, total_cap=6.0)),
    "r10_combo_any": _rule(lambda a, b, t: sc.combination(S, conditions(a, b, t), BY_HITS, "ANY", 3)),
    "r10_combo_each": _rule(lambda a, b, t: sc.combination(S, conditions(a, b, t), BY_HITS, "EACH", 5, bonus_cap=4.0, total_cap=12.0)),
    "r11_total": r11_total,
    "r12_details": r12_details,
    "r13_scene_stage": r13_scene_stage,
    "r16_rank_tiebreak": r16_rank_tiebreak,
    "r17_rank_plain": r17_rank_plain,
    "r18_scene_rank": r18_scene_rank,
    "r20_convolution": r20_convolution,
    "r21_convolution_one_date": r21_convolution_one_date,
    "r20_kernel_h30": r20_kernel_h30,
    "r10_combo_consec": _rule(lambda a, b, t: sc.combination(S, conditions(a, b, t), BY_HITS, "CONSEC", 5, 2)),
}
_WEIGHT = "CASE scene_stage WHEN 'confirm' THEN 3 WHEN 'trigger' THEN 2 WHEN 'observe' THEN 1 WHEN 'fail' THEN 0 ELSE -1 END"
ORACLE = {
    "r01_last": _sql("CASE WHEN a THEN 2 ELSE 0 END", "a") + "h",
    "r02_any": _sql("CASE WHEN list_contains(l, true) THEN 2 ELSE 0 END", "list_contains(l, true)") + f"(SELECT *, {_win('b', 4)} AS l FROM h)",
    "r03_consec": _sql("CASE WHEN r THEN 2 ELSE 0 END", "r") + f"(SELECT *, list_contains({_win('q', 4)}, true) AS r FROM (SELECT *, (len({_win('a', 3)}) = 3 AND NOT list_contains({_win('a', 3)}, false)) AS q FROM h))",
    "r04_each": _sql("2 * len(list_filter(l, lambda q: q))", "list_contains(l, true)") + _L5,
    "r04_each_dist": _sql(f"list_sum(list_transform(range(0, 5), lambda d: CASE WHEN len(l) > d AND l[len(l) - d] THEN {_PTS.format(d='d')} ELSE 0 END))", "list_contains(l, true)") + _L5,
    "r05_recent_dist": _sql(f"CASE WHEN list_contains(l, true) THEN {_PTS.format(d='(list_position(list_reverse(l), true) - 1)')} ELSE 0 END", "list_contains(l, true)") + _L5,
    "r07_cap": _sql("least(2 * len(list_filter(l, lambda q: q)), 5)", "list_contains(l, true)") + f"(SELECT *, {_win('a', 5)} AS l FROM h)",
    "r09_combo_last": _sql(f"CASE WHEN hits > 0 THEN least({_BASE.format(h='hits')} + bonus, 6) ELSE 0 END", "hits > 0") + _C,
    "r10_combo_any": _sql(f"CASE WHEN z.hits > 0 THEN {_BASE.format(h='z.hits')} + z.bonus ELSE 0 END", "z.hits > 0") + f"(SELECT *, list_max({_win(chr(123) + chr(39) + 'hits' + chr(39) + ': hits, ' + chr(39) + 'n' + chr(39) + ': n, ' + chr(39) + 'bonus' + chr(39) + ': bonus' + chr(125), 3)}) AS z FROM {_C})",
    "r10_combo_each": _sql("CASE WHEN s > 0 THEN least(s + least(q, 4), 12) ELSE 0 END", "s > 0") + f"(SELECT *, {_SUM5} AS s, sum(CASE WHEN hits > 0 THEN bonus ELSE 0 END) OVER c5 AS q FROM {_C} WINDOW c5 AS (PARTITION BY code ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))",
    "r11_total": f"WITH {_RULES} SELECT code, day, round(total, 6) AS total FROM tot",
    "r12_details": f"WITH {_RULES} SELECT code, day, rule, scene, stage, score FROM d",
    "r13_scene_stage": f"WITH {_RULES} SELECT code, day, scene, stage_score, risk_score, scene_stage, round(confirm_strength, 6) AS confirm_strength, round(risk_intensity, 6) AS risk_intensity FROM st",
    "r16_rank_tiebreak": f"WITH {_RULES} SELECT code, day, total, CAST(row_number() OVER (PARTITION BY day ORDER BY total DESC, j ASC NULLS LAST, code) AS INT) AS rank FROM tot",
    "r17_rank_plain": f"WITH {_RULES} SELECT code, day, CAST(row_number() OVER (PARTITION BY day ORDER BY total DESC, code) AS INT) AS rank FROM tot",
    "r18_scene_rank": f"WITH {_RULES} SELECT st.code, st.day, scene, CAST(row_number() OVER (PARTITION BY st.day, scene ORDER BY {_WEIGHT} DESC, confirm_strength DESC, confirm_strength - risk_intensity DESC, abs(stage_score) - abs(risk_score) DESC, total DESC, st.code) AS INT) AS scene_rank FROM st JOIN tot ON st.code = tot.code AND st.day = tot.day",
    "r20_convolution": f"WITH {_CONV} SELECT code, day, score, round(smooth, 5) AS smooth, CAST(raw_rank AS INT) AS raw_rank, CAST(conv_rank AS INT) AS conv_rank, CAST(raw_rank - conv_rank AS INT) AS change FROM k",
    "r21_convolution_one_date": f"WITH {EVENT_SCORES}, w AS (SELECT day, CASE n WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 ELSE 0.2 END AS weight, n FROM (SELECT day, row_number() OVER (ORDER BY day DESC) AS n FROM (SELECT DISTINCT day FROM sc WHERE day <= DATE '2024-01-20')) WHERE n <= 3), e AS (SELECT code, sum(score * weight) AS smooth, max(score) FILTER (n = 1) AS score FROM sc JOIN w USING (day) GROUP BY code HAVING count(*) = 3), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, code) AS raw_rank, row_number() OVER (ORDER BY smooth DESC, code) AS conv_rank FROM e) SELECT code, (SELECT max(day) FROM w) AS day, score, round(smooth, 5) AS smooth, CAST(raw_rank AS INT) AS raw_rank, CAST(conv_rank AS INT) AS conv_rank, CAST(raw_rank - conv_rank AS INT) AS change FROM r",
    "r20_kernel_h30": f"WITH {EVENT_SCORES}, ax AS (SELECT day, row_number() OVER (ORDER BY day) AS no FROM (SELECT DISTINCT day FROM sc)), n AS (SELECT code, score, no FROM sc JOIN ax USING (day)), z AS (SELECT x.code, x.no, sum(y.score * (0.5 / 30 + CASE x.no - y.no WHEN 0 THEN 0.5 / 2.19 WHEN 1 THEN 0.35 / 2.19 WHEN 2 THEN 0.245 / 2.19 ELSE 0 END)) AS smooth, count(*) AS c FROM n x JOIN n y ON x.code = y.code AND y.no BETWEEN x.no - 29 AND x.no GROUP BY ALL) SELECT code, day, round(smooth, 4) AS smooth FROM z JOIN ax USING (no) WHERE c = 30",
    "r10_combo_consec": _sql("CASE WHEN k > 0 THEN CASE k WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 5 END + CASE WHEN qt THEN 2 ELSE 0 END ELSE 0 END", "k > 0") + f"(SELECT *, CAST(qa AS INT) + CAST(qb AS INT) + CAST(qt AS INT) AS k FROM (SELECT *, " + ", ".join(f"list_contains({_win('r' + c, 4)}, true) AS q{c}" for c in "abt") + " FROM (SELECT *, " + ", ".join(f"(len({_win(c, 2)}) = 2 AND NOT list_contains({_win(c, 2)}, false)) AS r{c}" for c in "abt") + " FROM h)))",
}
