"""Minute series from nested JSON answers, one answer a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "code int, msg string, data map<string, struct<data: struct<data: array<string>, date: string>>>"
#: Largest relative distance of a mean price from the price at which volume is still taken to be in lots.
MOST_DEVIATION = 0.5


def _number(s: Column) -> Column:
    x = s.try_cast("double")
    return F.when((x >= 0) & (x < float("inf")), x)


def _previous(points: Column, i: Column, name: str) -> Column:
    return F.when(i == 0, 0.0).otherwise(F.get(points, i - 1)[name])


def _once(value: Column, name: str) -> Column:
    """A column that is made once a row; as a plain one its expression would be copied to each place that uses it."""
    return F.explode(F.array(value)).alias(name)


def minute_series(raw: DataFrame, key: str, text: str) -> DataFrame:
    """Points of every answer: key, date, no (from 0), time, price, vol, amount, average_price, and error.

    ``text`` is a JSON object with code, msg and, under the key in lower case, a date (yyyymmdd) and points of at least four
    fields: time (hhmm), price, and running totals of volume and amount, whose differences become vol and amount. An
    answer that is no JSON, has a code other than 0, lacks the key or the date, or has a point with too few fields, a
    negative or unreadable number, an impossible time or a falling total gives one row with ``error`` and nothing else;
    good answers have null there, and none where they have no points. The mean price is amount over shares: totals count
    lots of 100 unless, at the first point with volume, that is more than MOST_DEVIATION off the price and shares
    are nearer. Everything happens within the row.
    """
    p = raw.select(F.col(key).alias("_key"), F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"}).alias("_j"))
    series = F.try_element_at("_j.data", F.lower(F.col("_key").cast("string")))
    p = p.select("_key", "_j", series["data"]["date"].alias("_date"), series["data"]["data"].alias("_rows"), series.isNull().alias("_absent"))
    fields = lambda r: F.split(F.trim(r), r"\s+")
    point = lambda r: F.struct(
        F.when(fields(r)[0].rlike("^([01][0-9]|2[0-3])[0-5][0-9]$"), F.concat(F.substring(fields(r)[0], 1, 2), F.lit(":"), F.substring(fields(r)[0], 3, 2))).alias("time"),
        F.size(fields(r)).alias("fields"), _number(F.get(fields(r), F.lit(1))).alias("price"), _number(F.get(fields(r), F.lit(2))).alias("vol"), _number(F.get(fields(r), F.lit(3))).alias("amount"))
    p = p.select("_key", "_j", "_absent", F.when(F.col("_date").rlike("^[0-9]{8}$"), F.try_to_date(F.col("_date"), "yyyyMMdd")).alias("_day"), _once(F.transform("_rows", point), "_p"))
    points = F.col("_p")
    fell = F.exists(F.transform(points, lambda x, i: (x["vol"] < _previous(points, i, "vol")) | (x["amount"] < _previous(points, i, "amount"))), lambda b: F.coalesce(b, F.lit(False)))
    error = (
        F.when(F.col("_j").isNull() | F.col("_j.code").isNull(), "no JSON answer")
        .when(F.col("_j.code") != 0, F.concat(F.lit("code "), F.col("_j.code").cast("string")))
        .when(F.col("_absent"), "key is missing").when(F.col("_day").isNull() | points.isNull(), "no date or points")
        .when(F.exists(points, lambda x: x["fields"] < 4), "too few fields")
        .when(F.exists(points, lambda x: x["time"].isNull()), "bad time")
        .when(F.exists(points, lambda x: x["price"].isNull() | x["vol"].isNull() | x["amount"].isNull()), "bad number")
        .when(fell, "total falls"))
    p = p.select("_key", "_day", "_p", _once(error, "error"))
    first = F.get(F.filter(points, lambda x: x["vol"] > 0), F.lit(0))
    # null at a price of 0, where the price can't tell
    off = lambda unit: F.try_divide(F.abs(F.try_divide(first["amount"], first["vol"] * unit) - first["price"]), first["price"])
    known = (first["price"] > 0) & (first["amount"] > 0)
    unit = F.when(known & (off(100.0) > MOST_DEVIATION) & (off(1.0) < off(100.0)), 1.0).otherwise(100.0)
    made = F.transform(points, lambda x, i: F.struct(
        i.alias("no"), x["time"].alias("time"), x["price"].alias("price"), (x["vol"] - _previous(points, i, "vol")).alias("vol"), (x["amount"] - _previous(points, i, "amount")).alias("amount"),
        F.when(x["vol"] > 0, x["amount"] / (x["vol"] * F.col("_unit"))).alias("average_price")))
    out = p.select("*", _once(unit, "_unit")).withColumn("_made", F.when(F.col("error").isNull(), made).otherwise(F.array(F.lit(None).cast("struct<no:int,time:string,price:double,vol:double,amount:double,average_price:double>"))))
    out = out.select(F.col("_key").alias(key), F.when(F.col("error").isNull(), F.col("_day")).alias("date"), F.explode("_made").alias("_m"), "error")
    return out.select(key, "date", "_m.*", "error")
