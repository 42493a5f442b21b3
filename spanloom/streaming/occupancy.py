"""Continuous variants of islands, daily rollup and interval join over a stream of intervals.

A stream has columns (by, id, begins, ends): instants as TIMESTAMP. Results agree with the batch
operators for rows within the watermark; later rows are dropped, so batch results stay authoritative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def islands(stream: DataFrame, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Merged busy blocks: a session window in which each interval keeps the block open until it ends."""
    gap = F.concat((F.unix_timestamp("ends") - F.unix_timestamp("begins")).cast("string"), F.lit(" seconds"))
    block = F.session_window("begins", gap)
    grouped = stream.where("ends > begins").withWatermark("begins", late).groupBy(*by, block.alias("w"))
    return grouped.agg(F.count("*").alias("intervals")).select(*by, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "intervals")


def daily(stream: DataFrame, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Occupied seconds of each merged block on each UTC day that it meets: (by, date, seconds), one row a block and day.

    Blocks are apart, so a day's rows add up to the batch rollup's occupied seconds. The
    cutting at midnight keeps no state.
    """
    last = F.to_date(F.col("ends") - F.expr("INTERVAL '0.000001' SECOND"))
    days = islands(stream, by, late).withColumn("date", F.explode(F.sequence(F.to_date("begins"), last)))
    start = F.greatest(F.col("begins"), F.col("date").cast("timestamp"))
    end = F.least(F.col("ends"), F.date_add("date", 1).cast("timestamp"))
    return days.select(*by, "date", (F.unix_timestamp(end) - F.unix_timestamp(start)).alias("seconds"))


def overlaps(left: DataFrame, right: DataFrame, by: str, longest: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Pairs of a left and a right interval of one owner that share time; none lasts over ``longest``, which bounds the state."""
    l = left.withWatermark("begins", late).select(F.col(by).alias("l_by"), *(F.col(c).alias(f"l_{c}") for c in ("id", "begins", "ends")))
    r = right.withWatermark("begins", late).select(F.col(by).alias("r_by"), *(F.col(c).alias(f"r_{c}") for c in ("id", "begins", "ends")))
    near = f"l_by = r_by and l_begins < r_ends and r_begins < l_ends and r_begins >= l_begins - interval {longest} and r_begins <= l_begins + interval {longest}"
    return l.join(r, F.expr(near)).select(F.col("l_by").alias(by), F.col("l_id").alias("left"), F.col("r_id").alias("right"))


def daily_bound(stream: DataFrame, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """(by, date, intervals, seconds): what begins on each UTC day, a bound of the day's occupancy that keeps one row a day and owner."""
    day = F.window("begins", "1 day")
    rows = stream.where("ends > begins").withWatermark("begins", late)
    found = rows.groupBy(*by, day.alias("w")).agg(F.count("*").alias("intervals"), F.sum(F.unix_timestamp("ends") - F.unix_timestamp("begins")).alias("seconds"))
    return found.select(*by, F.to_date("w.start").alias("date"), "intervals", "seconds")
