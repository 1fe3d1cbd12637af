"""Sinks, file sources and streams: what a table holds after writing, and what a stream gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import panel as op
from barloom.operators import scoring as sc
from barloom.queries.market import RANKED, ranked
from barloom.queries.scoring import _RULES, total_panel
from barloom.sources.fixtures import BARS, read, supplier_bars
from barloom.sources.store import BUCKETS, Store, scratch
from barloom.streaming import snapshots as st

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _bars(spark, d):
    return supplier_bars(spark, d).select("code", "day", "volume", F.year("day").alias("year"))


@query(f"WITH {BARS}, n AS (SELECT code, day, volume + 1 AS volume FROM bars WHERE code % 3 = 0 AND day BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'), s AS (SELECT code, min(day) AS a, max(day) AS b FROM n GROUP BY code) SELECT bars.code, day, volume FROM bars LEFT JOIN s ON s.code = bars.code WHERE s.code IS NULL OR day NOT BETWEEN a AND b UNION ALL SELECT * FROM n")
def k01_upsert(spark, d):
    store = Store(spark, scratch(spark, "bars"), "code", BUCKETS).create(_bars(spark, d).select("day", "volume", "code"))
    new = _bars(spark, d).where("code % 3 = 0 AND day BETWEEN DATE '1996-01-01' AND DATE '1996-06-30'").withColumn("volume", F.col("volume") + 1)
    store.upsert_range(new, "day")
    return store.read().select(F.col("code").cast("long").alias("code"), "day", "volume")


@query(f"WITH {BARS} SELECT code, day, CASE WHEN year(day) = 1997 THEN volume * 2 ELSE volume END AS volume FROM bars WHERE year(day) <> 1997 OR code % 2 = 0")
def k02_day_replace(spark, d):
    """A partition's rows are replaced as a whole; the second time changes nothing."""
    store = Store(spark, scratch(spark, "bars"), "year").create(_bars(spark, d))
    new = _bars(spark, d).where("year = 1997 AND code % 2 = 0").withColumn("volume", F.col("volume") * 2)
    store.replace_partitions(new)
    store.replace_partitions(new)
    return store.read().select("code", "day", "volume")


@query(f"WITH {BARS} SELECT code, day, CASE WHEN year(day) = 1998 AND code % 4 = 1 THEN -1.0 ELSE volume END AS volume FROM bars")
def k03_staged_update(spark, d):
    store = Store(spark, scratch(spark, "bars"), "year").create(_bars(spark, d))
    stage = _bars(spark, d).where("year = 1998 AND code % 4 = 1").withColumn("volume", F.lit(-1.0))
    store.staged_update(stage, ["code", "day"], ["volume"])
    return store.read().select("code", "day", "volume")


@query(f"WITH {BARS} SELECT code, day, volume * 10 AS tenfold FROM bars")
def k04_columns(spark, d):
    store = Store(spark, scratch(spark, "bars"), "year").create(_bars(spark, d))
    return store.with_columns({"tenfold": F.col("volume") * 10}, ("volume",)).read().select("code", "day", "tenfold")


@query(f"WITH {RANKED} SELECT code, day, round(total, 5) AS total, rank FROM rk")
def k05_score_writer(spark, d):
    """Scores are ranked as they are written; one range of days is written again."""
    scores = ranked(spark, d).select("code", "day", "total", "rank", F.year("day").alias("year"))
    store = Store(spark, scratch(spark, "scores"), "year").create(scores)
    store.replace_partitions(scores.where("year = 1997"))
    return store.read().select("code", "day", F.round("total", 5).alias("total"), "rank")


@query(f"WITH {BARS} SELECT day, count(*) AS n FROM bars GROUP BY day")
def k08_idempotent_days(spark, d):
    daily = supplier_bars(spark, d).groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("year", F.year("day"))
    store = Store(spark, scratch(spark, "days"), "year").create(daily.withColumn("n", F.col("n") + F.when(F.col("year") == 1996, 5).otherwise(0)))
    for _ in range(2):
        store.replace_partitions(daily.where("year = 1996"))
    return store.read().select("day", "n")


@query("SELECT s_suppkey AS code, s_name AS name, s_acctbal AS balance FROM supplier")
def s06_csv(spark, d):
    """Written with a header and read by name."""
    path = scratch(spark, "suppliers")
    read(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("code long, name string, balance double").csv(path)


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def s10_preview(spark, d):
    """One page of a table."""
    return read(spark, d, "customer").select("c_custkey", "c_mktsegment").orderBy("c_custkey").offset(100).limit(50)


@query(f"WITH {BARS} SELECT code, day, volume FROM bars WHERE code = 7 AND day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def s01_range_scan(spark, d):
    return supplier_bars(spark, d).where("code = 7 AND day BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'").select("code", "day", "volume")


@query("SELECT 'lineitem' AS name, 'l_tax' AS column UNION ALL SELECT 'lineitem', 'l_discount'")
def s15_column_probe(spark, d):
    """Which wanted columns a table has, whatever their case."""
    have = {c.lower(): c for c in read(spark, d, "lineitem").columns}
    found = [("lineitem", have[c.lower()]) for c in ("L_TAX", "l_Discount", "absent") if c.lower() in have]
    return spark.createDataFrame(found, "name string, column string")


@query(f"WITH {_RULES} SELECT code, day, rule, score FROM d WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
def s08_result_scan(spark, d):
    """Rule rows of a range, from a table of scored rows partitioned by year."""
    scored = total_panel(spark, d).select("code", "day", "details", F.year("day").alias("year"))
    store = Store(spark, scratch(spark, "details"), "year").create(scored)
    rows = store.read().where("year = 1997 AND day BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'")
    return sc.rule_details(rows, "code", "day").select("code", "day", "rule", "score")


def _events(spark, d):
    path = f"{d}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, d))


def _folder(spark, d):
    """The events as a folder of files, which a stream can watch."""
    out = scratch(spark, "events")
    read(spark, d, "events").repartition(4, "user_id").write.parquet(out)
    return out


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def m01_version_gate(spark, d):
    s = _events(spark, d).select("user_id", "event_id", "value")
    return st.run_once(spark, st.newest_versions(s, "user_id", "event_id"), "complete", scratch(spark, "newest"))


@query(f"WITH {BARS}, l AS (SELECT code, max(day) AS day FROM bars GROUP BY code), q AS (SELECT code, day + CAST(code % 2 AS INT) AS day, CAST(1000 AS DOUBLE) AS volume FROM l), u AS (SELECT b.code, b.day, b.volume, false AS live FROM bars b JOIN q ON q.code = b.code WHERE b.day < q.day UNION ALL SELECT code, day, volume, true FROM q) SELECT code, day, volume, live, CAST(n AS INT) AS back FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY day DESC) AS n FROM u) WHERE n <= 3")
def m02_quote_tail(spark, d):
    """A quote of the last day replaces that day's row, a later one is appended."""
    bars = supplier_bars(spark, d).select("code", "day", "volume")
    quotes = bars.groupBy("code").agg(F.max("day").alias("day")).select("code", F.date_add("day", (F.col("code") % 2).cast("int")).alias("day"), F.lit(1000.0).alias("volume"))
    return st.tail_rows(bars, quotes, "code", "day", 3).select("code", "day", "volume", "live", "back")


@query(f"WITH {_RULES}, l AS (SELECT code, max(day) AS day FROM tot GROUP BY code), t(template, least) AS (VALUES ('warm', 51.0), ('hot', 55.0)) SELECT tot.code, template FROM tot JOIN l ON l.code = tot.code AND l.day = tot.day JOIN t ON total >= least")
def m03_template_hits(spark, d):
    """Templates that the last row of each entity meets."""
    last = op.newest(total_panel(spark, d), "code", "day")
    hits = F.array_compact(F.array(*[F.when(F.col("total") >= v, F.lit(k)) for k, v in (("warm", 51.0), ("hot", 55.0))]))
    return last.withColumn("hits", hits).select("code", F.explode("hits").alias("template"))


_TOTAL = "CASE WHEN event_id % 40 = 0 THEN 0.5 ELSE event_id * 1.0 END"


@query(f"SELECT user_id, event_id, CASE WHEN t < coalesce(lag(t) OVER w, 0) THEN t ELSE t - coalesce(lag(t) OVER w, 0) END AS delta, t < coalesce(lag(t) OVER w, 0) AS fell FROM (SELECT user_id, event_id, CAST({_TOTAL} AS DOUBLE) AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def m04_stream_delta(spark, d):
    """Differences of a running total that falls back now and then, with the last total as state."""
    t = F.when(F.col("event_id") % 40 == 0, 0.5).otherwise(F.col("event_id").cast("double")).alias("t")
    s = _events(spark, d).select("user_id", "event_id", t)
    return st.run_once(spark, st.deltas(s, "user_id", "event_id", "t"), "append", scratch(spark, "deltas"))
