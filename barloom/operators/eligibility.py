"""Which samples of a back-test count: entities that were listed for long enough by the trade calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar_index(calendar: DataFrame, day: str) -> DataFrame:
    """(day, no): distinct days numbered from 0."""
    return calendar.select(day).where(F.col(day).isNotNull()).distinct().withColumn("no", F.row_number().over(Window.orderBy(day)) - 1)  # one row a day


def first_day_on_or_after(dates: DataFrame, date: str, calendar: DataFrame, day: str) -> DataFrame:
    """(date, no): for distinct dates the number of the first calendar day that isn't before, null beyond the last day.

    Dates are sorted in among the days, at most one row for each of either, and count the days before them.
    """
    days = calendar_index(calendar, day)
    mixed = days.select(F.col(day).alias("_d"), F.lit(1).alias("_is_day")).unionByName(dates.select(F.col(date).alias("_d"), F.lit(0).alias("_is_day")).where("_d is not null").distinct())
    before = F.sum("_is_day").over(Window.orderBy("_d", "_is_day").rowsBetween(Window.unboundedPreceding, 0))
    last = F.sum("_is_day").over(Window.partitionBy())
    return mixed.select("_d", "_is_day", before.alias("_no"), last.alias("_days")).where("_is_day = 0").select(F.col("_d").alias(date), F.when(F.col("_no") < F.col("_days"), F.col("_no")).alias("no"))


def eligible(samples: DataFrame, calendar: DataFrame, listed: DataFrame, key: str, day: str, date: str, least: int = 60) -> DataFrame:
    """``samples`` of entities that have been listed for ``least`` calendar days, the sample's day and the first one included.

    The first day is the first calendar day on or after the entity's ``date`` in ``listed``. An entity without a known date,
    or with one after the calendar, is allowed; a sample on a day that the calendar lacks is refused. With ``least`` 0
    every sample is allowed. Of several dates of an entity the latest counts.
    """
    if least == 0:
        return samples
    own = listed.groupBy(F.col(key).alias("_key")).agg(F.max(date).alias("_date"))
    first = first_day_on_or_after(own, "_date", calendar, day)
    since = own.join(first, "_date").select("_key", F.col("no").alias("_first"))
    days = calendar_index(calendar, day).select(F.col(day).alias("_day"), "no")
    joined = samples.join(days, F.col(day) == F.col("_day")).join(since, F.col(key) == F.col("_key"), "left")
    return joined.where(F.col("_first").isNull() | (F.col("no") + 1 >= F.col("_first") + least)).select(*samples.columns)
