"""Streams into tables, and tables that change in steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import semantics as m
from barloom.functions.series import Series
from barloom.operators import backtest as bt
from barloom.operators import scoring as sc
from barloom.queries.backtest import _FW, universe
from barloom.queries.market import RANKED, ranked
from barloom.queries.scoring import K3, event_scores
from barloom.queries.scoring import ORACLE as SCORING_SQL
from barloom.sources.fixtures import BARS, STOCKS, read, stocks, supplier_bars
from barloom.sources.runs import compare_runs, save_run
from barloom.sources.store import BUCKETS, Store, kept, scratch
from barloom.streaming import live as lv
from barloom.streaming import snapshots as st

QUERIES: dict = {}
ORACLE: dict = {}
S = Series("code", "day")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# --- tables ---------------------------------------------------------------------------------------------------------


@query(f"WITH {RANKED} SELECT code, day, round(total, 5) AS total, rank FROM rk")
def k05_score_rollback(spark, d):
    """A range of scores is written again, ranked on the way; a second writer fails in the middle and leaves no trace."""
    scores = kept(ranked(spark, d).select("code", "day", "j", "total", F.year("day").alias("year")), "scores")
    write = lambda df: sc.rank_days(df, "code", "day", "total", "j")
    store = Store(spark, scratch(spark, "scores"), "year").create(write(scores.withColumn("total", F.when(F.col("year") == 1997, -1.0).otherwise(F.col("total")))))
    store.replace_range(write(scores.where("year = 1997")), "day", "1997-01-01", "1997-12-31")
    broken = scores.where("year = 1996").withColumn("total", F.when(F.col("code") > 1, F.raise_error(F.lit("aborted")).cast("double")).otherwise(0.0))
    try:
        store.replace_range(write(broken), "day", "1996-01-01", "1996-12-31")
    except Exception as e:
        if "aborted" not in str(e):
            raise
    return store.read().select("code", "day", F.round("total", 5).alias("total"), "rank")


@query(f"WITH {BARS}, {STOCKS} SELECT industry, day, count(*) AS n, round(avg(pct), 5) AS performance FROM bars JOIN stocks ON bars.code = stocks.code WHERE pct IS NOT NULL GROUP BY ALL")
def k06_board_replace(spark, d):
    """Board performance of a range of days, computed wrongly and for a board that is gone, is replaced in one step."""
    bars = supplier_bars(spark, d).where("pct is not null").join(stocks(spark, d).select("code", "industry"), "code")
    board = kept(bars.groupBy("industry", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("pct"), 5).alias("performance")).withColumn("year", F.year("day")), "board")
    within = F.col("day").between("1996-03-01", "1997-06-30")
    gone = board.where("day between '1996-05-01' and '1996-05-31'").withColumn("industry", F.lit("GONE"))
    store = Store(spark, scratch(spark, "board"), "year").create(board.withColumn("performance", F.col("performance") + F.when(within, 1).otherwise(0)).unionByName(gone))
    store.replace_range(board.where(within), "day", "1996-03-01", "1997-06-30")
    return store.read().select("industry", "day", "n", "performance")


@query(SCORING_SQL["r20_convolution"])
def k11_convolution_replace(spark, d):
    """Smoothed ranks by day: the last days are computed again and replace theirs, twice."""
    out = sc.convolution_rank(event_scores(spark, d), K3, "code", "day", "score")
    out = kept(out.select("code", "day", "score", F.round("smooth", 5).alias("smooth"), "raw_rank", "conv_rank", "change"), "smooth")
    late = F.col("day") >= "2024-01-20"
    store = Store(spark, scratch(spark, "convolution"), "day").create(out.where(~late).unionByName(out.where(late & (F.col("code") % 2 == 0)).withColumn("conv_rank", F.lit(0))))
    for _ in range(2):
        store.replace_range(out.where(late), "day", "2024-01-20", "2024-12-31")
    return store.read()


def _run_sql(k: int) -> str:
    return f"SELECT {k} AS layers, layer, count(*) AS days, CAST(sum(n) AS BIGINT) AS samples, round(avg(m), 5) AS mean FROM (SELECT day, layer, avg(ahead) AS m, count(*) AS n FROM (SELECT day, CAST((row_number() OVER (PARTITION BY day ORDER BY total, rank DESC) - 1) * {k} // count(*) OVER (PARTITION BY day) AS INT) AS layer, ahead FROM u) GROUP BY ALL) GROUP BY layer"


def _runs(spark, d) -> tuple[Store, list[str]]:
    """Runs with 5, 3 and again 5 layers; the second of 5 takes the place of the first."""
    u = kept(universe(spark, d).select("day", "code", "total", "rank", "ahead"), "universe")
    store, ids = Store(spark, scratch(spark, "runs"), "run_id"), []
    for k in (5, 3, 5):
        ids.append(save_run(store, {"score": "total", "ahead": 3, "layers": k}, bt.layer_means(u, bt.layer_by_count("total", "rank", "day", k), "ahead", "day")))
    return store, ids


@query(f"WITH {_FW} {_run_sql(5)} UNION ALL {_run_sql(3)}")
def g06_runs(spark, d):
    store, _ = _runs(spark, d)
    return store.read().select(F.get_json_object("parameters", "$.layers").cast("int").alias("layers"), "layer", "days", "samples", "mean")


@query(f"WITH {_FW}, a AS ({_run_sql(5)}), b AS ({_run_sql(3)}) SELECT layer, a.mean AS earlier, b.mean AS later, round(b.mean - a.mean, 5) AS change FROM a FULL JOIN b USING (layer)")
def g06_compare(spark, d):
    """Layer by layer what a run changed; layers that only one run has stay."""
    store, ids = _runs(spark, d)
    return compare_runs(store, ids[0], ids[1], ["layer"], "mean").select("layer", "earlier", "later", F.round("change", 5).alias("change"))


# --- streams --------------------------------------------------------------------------------------------------------

_LAST = "l AS (SELECT code, max(day) AS day, arg_max(close, day) AS close, arg_max(volume, day) AS volume FROM bars GROUP BY code)"
_QUOTE = "SELECT code, CAST(day + CAST(code % 2 AS INT) AS DATE) AS day, close * (1 + ({v} + code % 5 - 2) * 0.02) AS close, volume * {v} AS volume, 3 AS version FROM l WHERE code % 7 <> 0"
_CTX = "rd AS (SELECT day, row_number() OVER (ORDER BY day DESC) AS back FROM (SELECT DISTINCT day FROM rk)), cx AS (SELECT code, max(rank) FILTER (back = 1) AS rank, min(rank) FILTER (back <= 3) AS best_rank_3d, min(rank) FILTER (back <= 5) AS best_rank_5d, max(total) FILTER (back = 1) AS total FROM rk JOIN rd ON rk.day = rd.day WHERE back <= 5 GROUP BY code)"


def _quotes(bars, version: int):
    last = bars.groupBy("code").agg(F.max("day").alias("day"), F.max_by("close", "day").alias("close"), F.max_by("volume", "day").alias("volume")).where("code % 7 <> 0")
    return last.select("code", F.date_add("day", (F.col("code") % 2).cast("int")).alias("day"), (F.col("close") * (1 + (version + F.col("code") % 5 - 2) * 0.02)).alias("close"), (F.col("volume") * version).alias("volume"), F.lit(version).alias("version"))


@query(f"""WITH {RANKED}, {_LAST}, {_CTX}, q AS ({_QUOTE.format(v=3)}), v AS (SELECT code, day, volume FROM bars),
t AS (SELECT rk.code, rk.day, rk.close, v.volume, rk.rank, false AS live FROM rk JOIN v ON v.code = rk.code AND v.day = rk.day JOIN q ON q.code = rk.code WHERE rk.day < q.day UNION ALL SELECT code, day, close, volume, NULL, true FROM q),
x AS (SELECT *, CASE WHEN count(*) OVER w5 = 5 THEN avg(close) OVER w5 END AS m5, lag(volume) OVER w AS v1, lag(close) OVER w AS c1 FROM t WINDOW w AS (PARTITION BY code ORDER BY day), w5 AS (PARTITION BY code ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT s_suppkey AS code, cx.rank, best_rank_3d, best_rank_5d, round(cx.total, 5) AS total, coalesce(x.live, false) AS quoted, round(x.close, 5) AS price, round((x.close / c1 - 1) * 100, 5) AS pct,
  coalesce(array_to_string(list_filter([CASE WHEN x.close > m5 + 1e-12 THEN 'above' END, CASE WHEN x.volume > 2 * v1 + 1e-12 THEN 'active' END], lambda h: h IS NOT NULL), ','), '') AS hits, 3 AS version, 2 AS refreshes
FROM supplier LEFT JOIN (SELECT * FROM x WHERE live) x ON x.code = s_suppkey LEFT JOIN cx ON cx.code = s_suppkey""")
def g13_live_panel(spark, d):
    """Three snapshots, the second newest one late and without effect; every supplier has a row, quoted or not."""
    days = kept(ranked(spark, d).select("code", "day", "close", "rank", "total"), "ranked")
    bars = kept(supplier_bars(spark, d).select("code", "day", "close", "volume"), "bars")
    history = days.join(bars.select("code", "day", "volume"), ["code", "day"])
    everyone = read(spark, d, "supplier").select(F.col("s_suppkey").alias("code")).join(lv.rank_context(days, "code", "day", "rank", "total"), "code", "left")
    table = Store(spark, scratch(spark, "live"), "quoted").create(spark.createDataFrame([], "code long, rank int, best_rank_3d int, best_rank_5d int, total double, day date, quoted boolean, price double, pct double, hits array<string>, version int, refreshes int"))
    close, volume = F.col("close"), F.col("volume")
    templates = {"above": m.gt(close, S.mean(close, 5)), "active": m.gt(volume, 2 * F.lag("volume").over(S.w)), "leader": m.le(F.col("rank"), 1_000_000)}
    last = {"price": close, "pct": (close / F.lag("close").over(S.w) - 1) * 100}
    stream = lv.file_stream(spark, [_quotes(bars, v) for v in (1, 3, 2)], scratch(spark, "quotes"))
    lv.run_batches(stream, lambda batch, _: lv.live_panel(batch, history, kept(everyone, "everyone"), table, "code", "day", "version", 6, templates, last), scratch(spark, "checkpoint"))
    return table.read().select("code", "rank", "best_rank_3d", "best_rank_5d", F.round("total", 5).alias("total"), "quoted", F.round("price", 5).alias("price"), F.round("pct", 5).alias("pct"), F.array_join("hits", ",").alias("hits"), "version", "refreshes")


_INGESTED = f"WITH {BARS}, p AS (SELECT DISTINCT code FROM bars WHERE day > DATE '1997-12-31') SELECT code, day, round(CASE WHEN code % 4 = 0 AND code IN (FROM p) THEN close / 2 ELSE close END, 6) AS close, CAST(NULL AS VARCHAR) AS error FROM bars WHERE NOT (code % 8 = 0 AND code IN (FROM p)) UNION ALL SELECT code, NULL, NULL, 'not found' FROM p WHERE code % 8 = 0"


@query(_INGESTED)
def m06_ingest(spark, d):
    """Days arrive in three batches. Every fourth entity's prices were halved since: its history is loaded anew, which fails for half of them."""
    bars = kept(supplier_bars(spark, d).select("code", "day", "close", "pre_close"), "bars")
    halved = kept(bars.select("code", "day", *[F.when(F.col("code") % 4 == 0, F.col(c) / 2).otherwise(F.col(c)).alias(c) for c in ("close", "pre_close")]), "halved")
    end = "1997-12-31"
    table = Store(spark, scratch(spark, "daily"), "code", BUCKETS).create(bars.where(F.col("day") <= end))
    failed = Store(spark, scratch(spark, "failed"), "code", BUCKETS).create(spark.createDataFrame([], "code long, error string"))
    cuts = [end, "1998-03-31", "1998-06-30", "2100-01-01"]
    stream = lv.file_stream(spark, [halved.where((F.col("day") > a) & (F.col("day") <= b)) for a, b in zip(cuts, cuts[1:], strict=False)], scratch(spark, "pending"))
    load = lambda keys: halved.join(keys, "code", "left_semi").withColumn("error", F.when(F.col("code") % 8 == 0, F.lit("not found")))
    lv.run_batches(stream, lambda batch, _: lv.ingest_daily(batch, table, failed, load, "code", "day"), scratch(spark, "checkpoint"))
    rows = table.read().select("code", "day", F.round("close", 6).alias("close"), F.lit(None).cast("string").alias("error"))
    return rows.unionByName(failed.read().select("code", F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("close"), "error"))


_TICKS = "e AS (SELECT user_id, event_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CASE WHEN event_id % 17 <> 0 THEN value END AS price FROM events)"
_SPEEDS = ", ".join(f"CASE WHEN a.price > 0 THEN round((a.price / least(min(b.price) FILTER (b.hour > a.hour - {n}), arg_max(b.price, (b.hour, b.event_id)) FILTER (b.hour <= a.hour - {n})) - 1) * 100, 5) END AS speed_{n}" for n in (10, 30, 60))
_SPEED_SQL = f"WITH {_TICKS} SELECT a.user_id, a.event_id, a.hour, {_SPEEDS} FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.price > 0 AND b.hour BETWEEN a.hour - 90 AND a.hour AND (b.hour < a.hour OR b.event_id <= a.event_id) GROUP BY a.user_id, a.event_id, a.hour, a.price"


def _ticks(spark, d):
    """Event values as prices, hours as the unit of time, some prices missing."""
    return read(spark, d, "events").select("user_id", "event_id", F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour"), F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("price"))


def _shown(df):
    return df.select("user_id", "event_id", "hour", *[F.round(f"speed_{n}", 5).alias(f"speed_{n}") for n in (10, 30, 60)])


@query(_SPEED_SQL)
def m09_speed_batch(spark, d):
    return _shown(lv.speeds_batch(_ticks(spark, d), "user_id", "hour", "event_id", "price"))


@query(_SPEED_SQL)
def m09_speed_stream(spark, d):
    """The same from a stream of three files, with the prices of the last ninety hours as state."""
    ticks = kept(_ticks(spark, d), "ticks")
    low, high = ticks.agg(F.min("hour"), F.max("hour")).first()
    cuts = [low - 1, low + (high - low) // 3, low + (high - low) // 2, high]
    stream = lv.file_stream(spark, [ticks.where((F.col("hour") > a) & (F.col("hour") <= b)) for a, b in zip(cuts, cuts[1:], strict=False)], scratch(spark, "ticks"))
    return _shown(st.run_once(spark, lv.speeds_stream(stream, "user_id", "hour", "event_id", "price"), "append", scratch(spark, "speeds")))
