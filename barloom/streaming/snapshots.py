"""Quote snapshots as streams: a version gate, the tail row of each entity, and deltas of running totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def newest_versions(stream: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key seen so far; older versions that come late change nothing. Output mode complete or update."""
    rest = [c for c in stream.columns if c not in (key, version)]
    return stream.groupBy(key).agg(F.max(version).alias(version), *[F.max_by(c, F.col(version)).alias(c) for c in rest])


def tail_rows(history: DataFrame, quotes: DataFrame, key: str, day: str, n: int) -> DataFrame:
    """The last ``n`` rows of each quoted key, the quote as last row: it replaces the row of its day or is appended.

    Static history and the quotes of one micro-batch; ranks and scores of the quote's row are null.
    """
    from pyspark.sql import Window

    mine = history.join(quotes.select(key, F.col(day).alias("_day")), key).where(F.col(day) < F.col("_day")).drop("_day")
    rows = mine.withColumn("live", F.lit(False)).unionByName(quotes.withColumn("live", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(day))
    return rows.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def deltas(stream: DataFrame, key: str, order: str, total: str) -> DataFrame:
    """(key, order, delta, fell): differences of a running total by key; a total that falls starts anew and says so.

    The last total of a key and its place are kept as state. A row that comes after a later one of an earlier batch has null
    delta and fell and changes nothing. A key's rows of one micro-batch are held together.
    """
    kind = stream.schema[key].dataType.simpleString()
    when = stream.schema[order].dataType.simpleString()

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, place = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(frames)).sort_values(order)
        late = rows[order] <= place if place is not None else pd.Series(False, rows.index)
        if late.any():
            yield pd.DataFrame({key: rows[key], order: rows[order], "delta": None, "fell": None})[late]
        rows = rows[~late]
        if len(rows):
            before = rows[total].shift(1, fill_value=last)
            fell = rows[total] < before
            state.update((float(rows[total].iloc[-1]), rows[order].iloc[-1]))
            yield pd.DataFrame({key: rows[key], order: rows[order], "delta": (rows[total] - before).where(~fell, rows[total]), "fell": fell})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {order} {when}, delta double, fell boolean", f"last double, place {when}", "append", GroupStateTimeout.NoTimeout)


def run_once(spark: SparkSession, frame: DataFrame, mode: str, out: str) -> DataFrame:
    """All that is there now, through a stream: what the sink holds afterwards."""
    if mode == "append":
        q = frame.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(f"{out}/table")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table")

    q = frame.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{out}/table")
