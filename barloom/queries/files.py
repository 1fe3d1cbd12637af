"""Rule files, minute answers, list dates, windows of trigger sequences and vendor prices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions.rounding import vendor_change
from barloom.operators import eligibility as el
from barloom.operators import layers as la
from barloom.operators import scoring as sc
from barloom.operators import sequence as sq
from barloom.queries.backtest import _FW, universe
from barloom.queries.layers import _POINTS, RULE_NAMES, rounded
from barloom.queries.scoring import ORACLE as SCORING_SQL
from barloom.queries.scoring import _RULES, S, details, panel
from barloom.sources.fixtures import BARS, read, supplier_bars
from barloom.sources.minutes import minute_series
from barloom.sources.rules import read_rules
from barloom.sources.store import kept, scratch

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


RULE_FILE = """
version = 1

[[scene]]
name = "trend"
direction = "long"
observe_threshold = 1.0
trigger_threshold = 3.0
confirm_threshold = 6.0
fail_threshold = 4.0

[[scene]]
name = "heat"
direction = "short"
observe_threshold = 1.0
trigger_threshold = 2.0
confirm_threshold = 4.0
fail_threshold = 3.0

[[rule]]
name = "above"
scene = "trend"
stage = "base"
scope_way = "LAST"
scope_windows = 1
when = "above"
points = 1.0
explain = "close above its mean"

[[rule]]
name = "crossed"
scene = "trend"
stage = "trigger"
scope_way = "EACH"
scope_windows = 5
when = "crossed"
dist_points = [{ min = 0, max = 0, points = 5.0 }, { min = 1, max = 2, points = 3.0 }, { min = 3, max = 4, points = 1.0 }]
max_points = 6.0
explain = "crossings of the long mean"

[[rule]]
name = "joined"
scene = "trend"
stage = "confirm"
kind = "combination"
scope_way = "LAST"
scope_windows = 1
points_by_hits = [0.0, 1.0, 3.0, 5.0]
explain = "how many hold"
condition = [{ name = "a", when = "above" }, { name = "b", when = "crossed" }, { name = "t", when = "hot", bonus_points = 2.0 }]

[[rule]]
name = "hot"
scene = "heat"
stage = "trigger"
scope_way = "ANY"
scope_windows = 3
when = "hot"
points = -2.0
explain = "turnover is high"

[[rule]]
name = "broken"
scene = "trend"
stage = "fail"
scope_way = "LAST"
scope_windows = 1
when = "hot below"
points = -4.0
explain = "below the mean at high turnover"
"""


def formulas():
    a, b, t = map(F.col, "abt")
    return {"above": a, "crossed": b, "hot": t, "hot below": ~a & t}


def rule_file(spark):
    """The rule file as a user keeps it: a text that Spark reads."""
    path = scratch(spark, "rules")
    spark.createDataFrame([(RULE_FILE,)], "value string").coalesce(1).write.text(path)
    return read_rules(spark, path, S, formulas())


@query(SCORING_SQL["r11_total"])
def s07_rule_file(spark, d):
    """Totals from rules that are read from a file, in one pass over the panel."""
    rules, _ = rule_file(spark)
    return sc.score_panel(panel(spark, d), rules, ("code", "day")).select("code", "day", F.round("total", 6).alias("total"))


@query(SCORING_SQL["r13_scene_stage"])
def s07_scene_file(spark, d):
    rules, scenes = rule_file(spark)
    scored = sc.score_panel(panel(spark, d), rules, ("code", "day"))
    out = sc.scene_stages(scored, scenes, "code", "day")
    return out.select("code", "day", "scene", "stage_score", "risk_score", "scene_stage", *[F.round(c, 6).alias(c) for c in ("confirm_strength", "risk_intensity")])


def minute_answers(spark, d):
    """One JSON answer per user and day from the events; some broken, refused, of another key, falling or short."""
    w = Window.partitionBy("user_id", "date").orderBy("event_id")
    e = read(spark, d, "events").select("user_id", "event_id", "value", F.to_date("ts").alias("date"))
    cents = F.round(F.col("value") * 100).cast("long")
    e = e.withColumns({"no": F.row_number().over(w), "cents": cents, "total": F.sum(cents).over(w), "lot": F.when(F.col("user_id") % 3 == 0, 1).otherwise(100)})
    minute = 570 + F.col("no")
    time = F.concat(F.lpad(F.floor(minute / 60).cast("string"), 2, "0"), F.lpad((minute % 60).cast("string"), 2, "0"))
    falls = (F.col("user_id") % 10 == 3) & (F.col("no") == 2)  # both totals, as the first amount may be 0
    row = F.concat_ws(" ", time, F.format_string("%d.%02d", F.floor(F.col("cents") / 100), F.col("cents") % 100), F.when(falls, F.lit("0")).otherwise((F.col("no") * F.lit(100) / F.col("lot")).cast("long").cast("string")), F.when(falls, F.lit("0")).when((F.col("user_id") % 10 == 4) & (F.col("no") == 1), F.lit(None).cast("string")).otherwise(F.col("total").cast("string")))
    g = e.groupBy("user_id", "date").agg(F.sort_array(F.collect_list(F.struct("no", row.alias("row"))))["row"].alias("rows"))
    k = F.col("user_id") % 10
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    body = F.concat(F.lit('{"code": '), F.when(k == 2, "7").otherwise("0"), F.lit(', "msg": "", "data": {"'), F.when(k == 5, "other").otherwise(name), F.lit('": {"data": {"data": ["'), F.array_join("rows", '", "'), F.lit('"], "date": "'), F.date_format("date", "yyyyMMdd"), F.lit('"}}}}'))
    return g.select(F.upper(name).alias("key"), F.when(k == 1, F.substring(body, F.lit(1), F.length(body) - 9)).otherwise(body).alias("answer"))


_MINUTES = """WITH e AS (SELECT user_id, event_id, CAST(ts AS DATE) AS date, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
n AS (SELECT *, row_number() OVER w AS no, CAST(sum(cents) OVER w AS BIGINT) AS total, count(*) OVER (PARTITION BY user_id, date) AS k FROM e WINDOW w AS (PARTITION BY user_id, date ORDER BY event_id)),
v AS (SELECT *, no * CASE WHEN user_id % 3 = 0 THEN 100 ELSE 1 END AS vol FROM n),
f AS (SELECT user_id, date, arg_min(total, no) / (arg_min(vol, no) * 100.0) AS lots, arg_min(total, no) / (arg_min(vol, no) * 1.0) AS shares, arg_min(cents, no) / 100.0 AS price, max(k) AS k FROM v GROUP BY ALL),
u AS (SELECT user_id, date, k, CASE WHEN price > 0 AND abs(lots - price) / price > 0.5 AND abs(shares - price) / price < abs(lots - price) / price THEN 1.0 ELSE 100.0 END AS unit,
  CASE user_id % 10 WHEN 1 THEN 'no JSON answer' WHEN 2 THEN 'code 7' WHEN 3 THEN CASE WHEN k >= 2 THEN 'total falls' END WHEN 4 THEN 'too few fields' WHEN 5 THEN 'key is missing' END AS error FROM f)
SELECT 'U' || v.user_id AS key, v.date, CAST(no - 1 AS INT) AS no, printf('%02d:%02d', (570 + no) // 60, (570 + no) % 60) AS time, cents / 100 AS price, CAST(vol - coalesce(lag(vol) OVER w, 0) AS DOUBLE) AS vol, CAST(total - coalesce(lag(total) OVER w, 0) AS DOUBLE) AS amount, round(total / (vol * unit), 6) AS average_price, error
FROM v JOIN u ON u.user_id = v.user_id AND u.date = v.date WHERE error IS NULL WINDOW w AS (PARTITION BY v.user_id, v.date ORDER BY no)
UNION ALL SELECT 'U' || user_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, error FROM u WHERE error IS NOT NULL"""


@query(_MINUTES)
def s13_minutes(spark, d):
    out = minute_series(minute_answers(spark, d), "key", "answer")
    return out.withColumn("average_price", F.round("average_price", 6))


_LISTED = "cal AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS no FROM (SELECT DISTINCT day FROM bars WHERE dayofweek(day) NOT IN (0, 6))), ls AS (SELECT s_suppkey AS code, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 17 = 0 THEN DATE '2099-01-01' ELSE DATE '1993-01-01' + CAST(s_suppkey % 100 * 13 AS INT) END AS listed FROM supplier), li AS (SELECT code, CASE WHEN listed <= (SELECT max(day) FROM cal) THEN (SELECT count(*) FROM cal WHERE cal.day < ls.listed) END AS first FROM ls)"


def _eligible(spark, d, samples):
    calendar = supplier_bars(spark, d).select("day").where(~F.dayofweek("day").isin(1, 7))
    code = F.col("code")
    listed = read(spark, d, "supplier").select(F.col("s_suppkey").alias("code")).withColumn("listed", F.when(code % 10 == 0, None).when(code % 17 == 0, F.to_date(F.lit("2099-01-01"))).otherwise(F.date_add(F.to_date(F.lit("1993-01-01")), (code % 100 * 13).cast("int"))))
    return el.eligible(samples, calendar, listed, "code", "day", "listed", 60)


@query(f"WITH {BARS}, {_LISTED} SELECT bars.code, bars.day FROM bars JOIN cal ON cal.day = bars.day LEFT JOIN li ON li.code = bars.code WHERE first IS NULL OR no + 1 >= first + 60")
def p07_list_dates(spark, d):
    """List dates on days that the calendar lacks, unknown ones and one after its end; bars of weekends are refused."""
    return _eligible(spark, d, supplier_bars(spark, d).select("code", "day"))


_ELIGIBLE = _POINTS.replace(", u AS (", ", u0 AS (").replace(", mk AS (", f", {_LISTED}, u AS (SELECT u0.* FROM u0 JOIN cal ON cal.day = u0.day LEFT JOIN li ON li.code = u0.code WHERE first IS NULL OR no + 1 >= first + 60), mk AS (", 1)


@query(f"WITH {_ELIGIBLE}, summed AS (SELECT rule, count(*) AS days, avg(spread) AS spread_mean, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, count(ic) AS k FROM pt GROUP BY rule) SELECT rule, days, round(spread_mean, 5) AS spread_mean, round(ic_mean, 5) AS ic_mean, round(ic_std, 5) AS ic_std, round(CASE WHEN ic_std > 1e-12 THEN ic_mean / ic_std END, 5) AS icir, round(CASE WHEN ic_std > 1e-12 THEN ic_mean / ic_std * sqrt(k) END, 4) AS ic_t FROM summed")
def b05_eligible_rules(spark, d):
    """The rules' back-test over entities that were listed for sixty days."""
    points = kept(la.rule_points(_eligible(spark, d, universe(spark, d)), RULE_NAMES, "ahead", "code", "day", 2), "points")
    return rounded(la.summary(points, "rule", "day"), "rule", "days", spread_mean=5, ic_mean=5, ic_std=5, icir=5, ic_t=4)


_ROWS, _GAP = 20, 2
_WINDOWS = f"""{_RULES}, ax AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT DISTINCT day FROM h)), dn AS (SELECT count(*) AS days FROM ax), ev AS (SELECT code, pos, rule FROM d JOIN ax ON ax.day = d.day WHERE abs(score) > 1e-12),
tg AS (SELECT rule, pos - (SELECT max(pos) FROM ev WHERE code = 1) + {_ROWS - 1} AS o FROM ev WHERE code = 1 AND pos > (SELECT max(pos) FROM ev WHERE code = 1) - {_ROWS}),
mt AS (SELECT code, s, rule, o, min(abs(pos - s - o)) AS gap FROM (SELECT ev.*, tg.o, unnest(range(greatest(0, pos - o - {_GAP}), least((SELECT days FROM dn) - {_ROWS}, pos - o + {_GAP}) + 1)) AS s FROM ev JOIN tg ON tg.rule = ev.rule WHERE code <> 1) WHERE pos >= s AND pos < s + {_ROWS} GROUP BY ALL),
ws AS (SELECT code, s, count(*) AS matched, CAST(sum(gap) AS BIGINT) AS gap_sum, sum({_GAP + 1} - gap) AS points FROM mt GROUP BY ALL),
wn AS (SELECT ws.*, (SELECT count(*) FROM ev WHERE ev.code = ws.code AND ev.pos >= ws.s AND ev.pos < ws.s + {_ROWS}) AS own FROM ws)"""


def _windows(spark, d):
    """Windows like the last twenty days of the first supplier's events."""
    ev = details(spark, d).where(F.abs("score") > 1e-12).select("code", "day", "rule")
    axis = el.calendar_index(supplier_bars(spark, d).select("day"), "day")
    ev = kept(ev.join(axis, "day").select("code", F.col("no").alias("at"), "rule"), "events")
    last = ev.where("code = 1").agg(F.max("at")).first()[0]
    target = ev.where((F.col("code") == 1) & (F.col("at") > last - _ROWS)).select("rule", (F.col("at") - last + _ROWS - 1).alias("offset"))
    return sq.window_similarity(ev.where("code <> 1"), target, axis.count(), _ROWS, _GAP, "code", "at", "rule")


@query(f"WITH {_WINDOWS} SELECT code, CAST(s AS INT) AS start, matched, gap_sum, own, round(200.0 * points / {_GAP + 1} / (own + (SELECT count(*) FROM tg)), 6)::DOUBLE AS similarity FROM wn")
def b29_windows(spark, d):
    return rounded(_windows(spark, d), "code", "start", "matched", "gap_sum", "own", similarity=6)


@query(f"WITH {_WINDOWS}, sm AS (SELECT *, 200.0 * points / {_GAP + 1} / (own + (SELECT count(*) FROM tg)) AS similarity FROM wn), b AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY round(similarity::DOUBLE, 9) DESC, matched DESC, round(gap_sum / matched, 9), s) AS n FROM sm) SELECT code, CAST(s AS INT) AS start, matched, gap_sum, own, round(similarity, 6)::DOUBLE AS similarity FROM b WHERE n = 1")
def b29_best_windows(spark, d):
    return rounded(sq.best_windows(_windows(spark, d), "code"), "code", "start", "matched", "gap_sum", "own", similarity=6)


@query(f"WITH {BARS}, p AS (SELECT code, day, CAST(printf('%.2f', close) AS DOUBLE) AS close, CAST(printf('%.2f', pre_close) AS DOUBLE) AS pre_close FROM bars WHERE pre_close IS NOT NULL) SELECT code, day, close, pre_close, CAST(printf('%.2f', close - pre_close) AS DOUBLE) + 0.0 AS change, CASE WHEN abs(pre_close) < 2.220446049250313e-16 THEN 0.0 ELSE CAST(printf('%.2f', (close - pre_close) / pre_close * 100) AS DOUBLE) + 0.0 END AS pct FROM p")
def i03_vendor_prices(spark, d):
    """Prices to the cent, change and percent from the rounded prices."""
    close, before, change, pct = vendor_change(F.col("close"), F.col("pre_close"))
    return supplier_bars(spark, d).where("pre_close is not null").select("code", "day", close.alias("close"), before.alias("pre_close"), change.alias("change"), pct.alias("pct"))
