"""Streams into tables: the live panel of newest quotes, daily bars with repair, and speeds of prices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.store import Store, kept
from barloom.streaming.snapshots import tail_rows


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """All that is there now, micro-batch by micro-batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def live_panel(quotes: DataFrame, history: DataFrame, entities: DataFrame, table: Store, key: str, day: str, version: str, rows: int, templates: dict[str, Column], last: dict[str, Column], cleared: tuple[str, ...] = ("rank", "total"), refreshes: str = "refreshes") -> None:
    """One micro-batch of quote snapshots into ``table``: a row for every entity, as of the newest version seen.

    Only the batch's newest version counts, and only if it is newer than the table's; a late or null one has no effect, so
    that a batch that runs again changes nothing. Of several quotes of an entity in one version the largest by all columns
    is taken. A quote becomes the last row of the entity's own last ``rows`` of ``history`` (it replaces the row of its day
    or is appended) with the ``cleared`` columns null, and ``templates`` (conditions over windows by entity) and ``last``
    (values) are taken at that row: ``hits`` lists the templates that are true. Entities without a quote stay, with nulls
    and no hits. ``refreshes`` counts the versions that took effect.
    """
    seen, count = table.read().agg(F.max(version), F.max(refreshes)).first()
    newest = quotes.agg(F.max(version)).first()[0]
    if newest is None or (seen is not None and newest <= seen):
        return
    now = quotes.where(F.col(version) == F.lit(newest)).groupBy(key).agg(F.max(F.struct(*quotes.columns)).alias("_q")).select("_q.*").drop(version)
    tail = tail_rows(history, now.select([c for c in now.columns if c not in cleared]), key, day, rows)
    hits = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in templates.items()])) if templates else F.array().cast("array<string>")
    at = tail.withColumns({**last, "hits": hits}).where("live").select(key, day, F.lit(True).alias("quoted"), *last, "hits")
    rows_ = entities.join(at, key, "left").withColumns({"quoted": F.coalesce("quoted", F.lit(False)), "hits": F.coalesce("hits", F.array().cast("array<string>")), version: F.lit(newest), refreshes: F.lit((count or 0) + 1)})
    table.overwrite(rows_)


def rank_context(ranked: DataFrame, key: str, day: str, rank: str, total: str) -> DataFrame:
    """Per entity its rank and total on the newest day and its best rank of the newest three and five days."""
    days = ranked.select(day).distinct().orderBy(F.desc(day)).limit(5)
    order = days.withColumn("_back", F.row_number().over(Window.orderBy(F.desc(day))))  # five rows
    r = ranked.join(order, day)
    pick = lambda n, f, c: f(F.when(F.col("_back") <= n, F.col(c)))
    return r.groupBy(key).agg(pick(1, F.max, rank).alias("rank"), pick(3, F.min, rank).alias("best_rank_3d"), pick(5, F.min, rank).alias("best_rank_5d"), pick(1, F.max, total).alias("total"))


def ingest_daily(batch: DataFrame, table: Store, failed: Store, reload: Callable[[DataFrame], DataFrame], key: str, day: str, close: str = "close", before: str = "pre_close", tolerance: float = 0.001) -> None:
    """One micro-batch of daily rows into ``table`` (split by ``key``): continuous entities are appended, broken ones loaded anew.

    An entity is broken where a row's stated previous close is null or ``tolerance`` or more off the row before it, in the
    table or the batch, or where an earlier load of it failed. An entity without history is continuous at its first row.
    ``reload`` gets the broken keys and returns their whole histories with a column ``error``; an entity with an error, or
    without rows, is written to ``failed`` and loses its rows, the others replace theirs. If ``reload`` itself fails, all
    broken entities do. Each step commits alone, in an order that leaves nothing lost or doubled if the batch runs again:
    rows not after an entity's last day are skipped. Null keys and days are skipped too.
    """
    spark, fields = batch.sparkSession, table.read().columns
    batch = kept(batch.where(F.col(key).isNotNull() & F.col(day).isNotNull()), "ingest")
    known = table.read().join(batch.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.max(day).alias("_day"), F.max_by(close, day).alias("_close"))
    again = failed.read().select(F.col(key).alias("_failed")).distinct()
    fresh = batch.join(known, key, "left").where(F.col("_day").isNull() | (F.col(day) > F.col("_day"))).join(again, F.col(key) == F.col("_failed"), "left")
    previous = F.coalesce(F.lag(close).over(Window.partitionBy(key).orderBy(day)), F.col("_close"))
    off = F.col("_failed").isNotNull() | (previous.isNotNull() & ~F.coalesce(F.abs(previous - F.col(before)) < tolerance, F.lit(False)))
    checked = kept(fresh.withColumn("_off", off).withColumn("_broken", F.max("_off").over(Window.partitionBy(key))), "checked")
    good, broken = checked.where("not _broken").select(*fields), checked.where("_broken").select(key).distinct()
    if not good.isEmpty():
        table.append(good)
    if broken.isEmpty():
        return
    try:
        loaded = kept(reload(broken), "reloaded")
    except Exception as e:  # the day's rows are committed; the load is tried again with the next rows
        loaded = spark.createDataFrame([], table.read().withColumn("error", F.lit("")).schema)
        reason = F.lit(f"{type(e).__name__}")
    else:
        reason = F.lit("no rows")
    bad = loaded.where("error is not null").groupBy(F.col(key).alias("_bad")).agg(F.min("error").alias("error"))
    whole = loaded.join(bad, F.col(key) == F.col("_bad"), "left_anti").select(*fields)
    lost = broken.join(whole.select(key).distinct(), key, "left_anti")
    lost = kept(lost.join(bad, F.col(key) == F.col("_bad"), "left").select(key, F.coalesce("error", reason).alias("error")), "lost")
    table.replace_partitions(whole)
    table.remove(lost)
    failed.remove(broken)
    if not lost.isEmpty():
        failed.append(lost)


def speeds_batch(prices: DataFrame, key: str, time: str, row: str, price: str, periods: tuple[int, ...] = (10, 30, 60), keep: int = 90) -> DataFrame:
    """(key, time, row, speed_N...): percent that a price lies above the entity's lowest of the last N time units.

    The lowest is over the entity's rows after time - N up to now and the last one at or before time - N that is at most
    ``keep`` old. Rows of one time (long) go by ``row``, which is unique. Null prices and those not above 0 have no speed
    and count for none.
    """
    w = Window.partitionBy(key).orderBy(F.col(time))
    good = F.when(F.col(price) > 0, F.col(price))
    boundary = lambda n: F.max_by(good, F.when(good.isNotNull(), F.struct(time, row))).over(w.rangeBetween(-keep, -n))
    out = prices.where(F.col(key).isNotNull())
    before = F.filter(F.collect_list(F.struct(F.col(time).alias("t"), F.col(row).alias("r"), good.alias("p"))).over(w.rangeBetween(-max(periods) + 1, 0)), lambda s: s["p"].isNotNull())
    out = out.withColumn("_seen", before)
    low = lambda n: F.array_min(F.transform(F.filter("_seen", lambda s: (s["t"] > F.col(time) - n) & ((s["t"] < F.col(time)) | (s["r"] <= F.col(row)))), lambda s: s["p"]))
    return out.select(key, time, row, *[F.when(good.isNotNull(), (good / F.least(low(n), boundary(n)) - 1) * 100).alias(f"speed_{n}") for n in periods])


def speeds_stream(prices: DataFrame, key: str, time: str, row: str, price: str, periods: tuple[int, ...] = (10, 30, 60), keep: int = 90) -> DataFrame:
    """``speeds_batch`` of a stream whose rows come in order of (time, row) from batch to batch; ``keep`` time units of prices are state.

    A row that comes after a later one of an earlier batch has null speeds and counts for none. Output mode append.
    """
    kinds = {f.name: f.dataType.simpleString() for f in prices.schema.fields}
    names = [f"speed_{n}" for n in periods]
    schema = f"`{key}` {kinds[key]}, `{time}` {kinds[time]}, `{row}` {kinds[row]}, " + ", ".join(f"{n} double" for n in names)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, lows, last = state.get if state.exists else ([], [], None)
        rows = pd.concat(list(frames)).sort_values([time, row])
        out = pd.DataFrame({key: rows[key], time: rows[time], row: rows[row]})
        place = [*zip(rows[time].tolist(), rows[row].tolist(), strict=True)]
        late = np.array([last is not None and p <= tuple(last) for p in place], bool)
        value = rows[price].to_numpy(float)
        good = ~late & (value > 0)
        seen_t = np.concatenate([np.array(times, np.int64), rows[time].to_numpy(np.int64)[good]])
        seen_p = np.concatenate([np.array(lows, float), value[good]])
        at = len(times) + np.cumsum(good) - 1
        for n, name in zip(periods, names, strict=True):
            speed = np.full(len(rows), np.nan)
            for i in np.flatnonzero(good):
                now = seen_t[at[i]]
                first = int(np.searchsorted(seen_t, now - n, "right"))
                if first and seen_t[first - 1] >= now - keep:
                    first -= 1
                speed[i] = (value[i] / seen_p[first : at[i] + 1].min() - 1) * 100
            out[name] = pd.array(speed, "Float64")
        left = seen_t >= (seen_t[-1] if len(seen_t) else 0) - keep
        state.update((seen_t[left].tolist(), seen_p[left].tolist(), max([p for p, x in zip(place, late, strict=True) if not x], default=last)))
        yield out

    return prices.groupBy(key).applyInPandasWithState(step, schema, f"times array<long>, prices array<double>, last struct<t:{kinds[time]},r:{kinds[row]}>", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, frames: list[DataFrame], folder: str) -> DataFrame:
    """A stream that reads one file a micro-batch, in the order of ``frames``."""
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
