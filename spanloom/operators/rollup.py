"""Occupancy of civil days."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from .intervals import assign, union_seconds


def day_spine(spark: SparkSession, first: datetime.date, last: datetime.date, zone: str = "UTC") -> DataFrame:
    """(date, s, e): the civil days from ``first`` to before ``last`` on a zone's clock, as instants in seconds."""
    days = spark.range((last - first).days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    midnight = lambda d: times.seconds(times.to_utc(d.cast("timestamp_ntz"), zone))
    return days.select("date", midnight(F.col("date")).alias("s"), midnight(F.date_add("date", 1)).alias("e"))


def daily(df: DataFrame, spine: DataFrame, by: tuple[str, ...] = (), all_day: DataFrame | None = None) -> DataFrame:
    """(by, date, day_seconds, occupied_seconds, timed_occurrences, all_day_occurrences) of every day and owner.

    Occupied is the union of the day's intervals. A timed occurrence counts on each day that
    it shares time with, one without length on the day it lies in; all-day occurrences (by, ds, de: dates,
    the end excluded) count on their dates and occupy nothing. Days without anything come with zeros, for each owner of ``df``.
    """
    rows = df.select(*by, "s", "e")
    lengths = (23 * 3600, 25 * 3600)
    held = assign(rows, spine.select("date", "s", "e"), (), lengths) if not by else assign(rows.withColumn("_one", F.lit(1)), spine.select("date", "s", "e").withColumn("_one", F.lit(1)), ("_one",), lengths).drop("_one")
    keys = [*by, "date"]
    seconds = union_seconds(held.select(*keys, "s", "e"), keys)
    counts = held.groupBy(*keys).agg(F.count("*").alias("n"))
    points = rows.where("s = e").withColumn("_day", F.floor(F.col("s") / times.DAY))
    reach = F.explode(F.sequence(F.floor(F.col("s") / times.DAY), F.floor((F.col("e") - 1) / times.DAY)))
    on_day = points.join(spine.select("date", F.col("s").alias("lo"), F.col("e").alias("hi"), reach.alias("_day")), "_day").where("s >= lo and s < hi").groupBy(*keys).agg(F.count("*").alias("p"))
    base = spine.select("date", (F.col("e") - F.col("s")).alias("day_seconds"))
    if by:
        base = df.select(*by).distinct().join(F.broadcast(base), F.lit(True))
    out = base.join(seconds, keys, "left").join(counts, keys, "left").join(on_day, keys, "left")
    zero = F.lit(0).cast("bigint")
    days = F.coalesce("a", zero) if all_day is not None else zero
    if all_day is not None:
        dates = all_day.where("ds < de").select(*by, F.explode(F.sequence("ds", F.date_sub("de", 1))).alias("date")).groupBy(*keys).agg(F.count("*").alias("a"))
        out = out.join(dates, keys, "left")
    return out.select(*keys, "day_seconds", F.coalesce("seconds", zero).alias("occupied_seconds"), (F.coalesce("n", zero) + F.coalesce("p", zero)).alias("timed_occurrences"), days.alias("all_day_occurrences"))
