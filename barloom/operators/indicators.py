"""Chains of indicators over bars: each is rounded and visible to those after it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Indicator:
    """``make`` gives the column from the columns there are so far; the result has ``digits`` decimals."""

    name: str
    make: Callable[[], Column]
    digits: int
    warm_up: int = 0


def indicator_chain(df: DataFrame, chain: list[Indicator]) -> DataFrame:
    """``df`` with every indicator in order; a name that is there already is an error."""
    for ind in chain:
        if ind.name in df.columns:
            raise ValueError(f"{ind.name} is there already")
        df = df.withColumn(ind.name, F.round(ind.make(), ind.digits))
    return df


def lossy_chain(df: DataFrame, chain: list[Indicator]) -> tuple[DataFrame, list[str]]:
    """As ``indicator_chain``, but indicators that can't be planned are left out; their names are returned."""
    failed = []
    for ind in chain:
        try:
            df = indicator_chain(df, [ind])
        except (AnalysisException, ValueError, TypeError, KeyError):
            failed.append(ind.name)
    return df, failed


def incremental_chain(history: DataFrame, new: DataFrame, chain: list[Indicator], key: str, day: str) -> DataFrame:
    """Indicators of the ``new`` rows only, computed over them and the tail of ``history`` that the warm-ups need."""
    tail = sum(ind.warm_up for ind in chain)
    back = Window.partitionBy(key).orderBy(F.desc(day))
    first = new.groupBy(key).agg(F.min(day).alias("_from"))
    older = history.join(first, key).where(F.col(day) < F.col("_from")).withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= tail).select(*new.columns)
    both = older.withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
    return indicator_chain(both, chain).where("_new").drop("_new")
