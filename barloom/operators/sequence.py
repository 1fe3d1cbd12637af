"""Windows of an entity's trigger events that resemble those of a target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_similarity(events: DataFrame, target: DataFrame, days: int, rows: int, most_gap: int, key: str, at: str, rule: str) -> DataFrame:
    """Per entity and window start that meets the target anywhere: matched, gap_sum, own, similarity.

    ``events`` has (key, at, rule), at being the day's number from 0 to ``days`` - 1; ``target`` has (rule, offset), the events
    of the target window by their place in it, each a row. A window starts at s and has ``rows`` days. A target event meets
    the window's events of its rule at most ``most_gap`` days from s + offset, inside the window; the nearest counts, with
    (most_gap + 1 - gap) / (most_gap + 1). Similarity is 200 times the sum of these over the events of both, the
    entity's own being all of its events in the window, whatever their rule.

    ``target`` goes to every task, at most ``rows`` days of it. An entity's days are arrays of ``days`` places, in which the
    nearest event of a rule is looked up for all starts at once; nothing is joined. ``events`` should not hold the target entity.
    """
    wanted = [tuple(r) for r in target.groupBy(rule, F.col("offset").cast("int").alias("o")).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most rows x rules
    size, starts, kind = sum(n for _, _, n in wanted), days - rows + 1, events.schema[key].dataType.simpleString()

    def one(own_rows: pd.DataFrame) -> pd.DataFrame:
        place = own_rows[at].to_numpy(np.int64)
        name = own_rows[rule].to_numpy()
        matched, gap_sum = np.zeros(starts, np.int64), np.zeros(starts, np.int64)
        held = {}
        for r, o, n in wanted:
            if r not in held:
                held[r] = np.zeros(days + 2 * most_gap, bool)
                held[r][place[name == r] + most_gap] = True
            gap = np.full(starts, most_gap + 1, np.int64)
            # an event delta days after s + offset lies in the window if 0 <= offset + delta < rows; nearer ones overwrite
            for delta in sorted(range(-most_gap, most_gap + 1), key=abs, reverse=True):
                if 0 <= o + delta < rows:
                    first = o + delta + most_gap
                    gap[held[r][first : first + starts]] = abs(delta)
            met = gap <= most_gap
            matched += n * met
            gap_sum += np.where(met, n * gap, 0)
        before = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=days))])
        own = before[rows : rows + starts] - before[:starts]
        some = np.flatnonzero(matched)
        matched, gap_sum, own = matched[some], gap_sum[some], own[some]
        points = (most_gap + 1) * matched - gap_sum
        return pd.DataFrame({key: own_rows[key].iloc[0], "start": some.astype(np.int32), "matched": matched, "gap_sum": gap_sum, "own": own, "similarity": 200.0 * points / (most_gap + 1) / (own + size)})

    schema = f"`{key}` {kind}, start int, matched long, gap_sum long, own long, similarity double"
    if starts < 1 or not wanted:
        return events.sparkSession.createDataFrame([], schema)
    return events.select(key, at, rule).groupBy(key).applyInPandas(one, schema)


def best_windows(windows: DataFrame, key: str) -> DataFrame:
    """Per entity its window of highest similarity, then most matches, smallest mean gap, earliest start."""
    order = Window.partitionBy(key).orderBy(F.desc(F.round("similarity", 9)), F.desc("matched"), F.asc(F.round(F.col("gap_sum") / F.col("matched"), 9)), F.asc("start"))
    return windows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
