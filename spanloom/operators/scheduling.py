"""Working windows, date replacements, day explanations and shifts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from . import scan
from .intervals import islands


def _boundary(date: str, minutes: Column, zone: Column | str) -> tuple[Column, Column]:
    return times.strict(F.timestamp_seconds(F.unix_date(F.col(date)).cast("bigint") * times.DAY + minutes * 60).cast("timestamp_ntz"), zone)


def working_windows(dates: DataFrame, weekdays: list[int], start: str, end: str, zone: str) -> DataFrame:
    """(date, s, e, error): one window on each of ``dates`` (column date) that falls on one of ``weekdays`` (Monday is 0).

    Both clocks (HH:MM, the end up to 24:00) have to name exactly one instant on that date; where they don't, error says
    Nonexistent or Ambiguous and the bounds are null.
    """
    (s, bad_s), (e, bad_e) = (_boundary("date", times.clock_minutes(F.lit(c)), zone) for c in (start, end))
    return dates.where(times.weekday("date").isin(*weekdays)).select("date", s.alias("s"), e.alias("e"), F.coalesce(bad_s, bad_e).alias("error"))


def effective(dates: DataFrame, weekly: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(date, windows, applied_exception): a date's own windows (array of struct lo, hi in minutes) if it has any entry, else its weekday's.

    weekly: weekday, windows; exceptions: date, windows. An exception of an empty array closes the date; a weekday without entry has no windows.
    """
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    rows = dates.withColumn("weekday", times.weekday("date")).join(weekly.withColumnRenamed("windows", "_weekly"), "weekday", "left").join(exceptions.withColumnRenamed("windows", "_own").withColumn("_has", F.lit(True)), "date", "left")
    return rows.select("date", "weekday", F.when(F.col("_has"), F.coalesce("_own", none)).otherwise(F.coalesce("_weekly", none)).alias("windows"), F.coalesce("_has", F.lit(False)).alias("applied_exception"))


def merge_windows(schedule: DataFrame, zone: str) -> DataFrame:
    """(date, s, e, error): a schedule's windows as instants, those of one date that touch merged; dates never merge."""
    flat = schedule.select("date", F.explode("windows").alias("w"))
    (s, bad_s), (e, bad_e) = (_boundary("date", F.col(f"w.{c}"), zone) for c in ("lo", "hi"))
    rows = flat.select("date", s.alias("s"), e.alias("e"), F.coalesce(bad_s, bad_e).alias("error"))
    merged = islands(rows.where("error is null"), ["date"])
    return merged.select("date", "s", "e", F.lit(None).cast("string").alias("error")).unionByName(rows.where("error is not null"))


def overlapping_windows(windows: DataFrame, by: str | None = None) -> DataFrame:
    """Windows that begin before an earlier one has ended (columns s, e; within ``by`` if given).

    Owners' windows are looked at in two levels, so an owner may have any number; without owners they are one
    specification's, of at most a few a day.
    """
    if by:
        reached = scan.running(scan.blocks(windows, [by], ["s", "e"]), [by], ["s", "e"], {"_reach": ("max", F.col("e"))}, own_row=False)
    else:
        reached = windows.withColumn("_reach", F.max("e").over(Window.partitionBy().orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)))
    return reached.where(F.col("s") < F.col("_reach")).select(windows.columns)


def day_status(days: DataFrame, minimum: int) -> DataFrame:
    """``days`` (working, occupied, free, candidate seconds; complete) with ``status``.

    Without working time a day is closed; an incomplete analysis tells nothing more; a day without free time is
    fully_booked, one with a candidate of ``minimum`` seconds available, and else below_minimum.
    """
    status = F.when(F.col("working_seconds") == 0, "closed").when(~F.col("complete"), "incomplete").when(F.col("free_seconds") == 0, "fully_booked").when(F.col("candidate_seconds") >= minimum, "available").otherwise("below_minimum")
    return days.withColumn("status", status)


def shifts(people: DataFrame, dates: DataFrame, lo: int, hi: int) -> DataFrame:
    """(pid, s, e): the union of each person's weekly shifts within [lo, hi).

    people: pid, zone, weekday, lo and hi in minutes; a shift that ends before it begins ends on the next date. ``dates``
    has to begin a day before ``lo`` on every person's clock. Clocks follow :func:`times.strict`; a shift with a
    bound that isn't one instant is left out.
    """
    rows = dates.withColumn("weekday", times.weekday("date")).join(people, "weekday").withColumn("end_date", F.date_add("date", F.when(F.col("hi") < F.col("lo"), 1).otherwise(0)))
    s, _ = _boundary("date", F.col("lo"), F.col("zone"))
    e, _ = _boundary("end_date", F.col("hi"), F.col("zone"))
    cut = rows.select("pid", F.greatest(s, F.lit(lo)).alias("s"), F.least(e, F.lit(hi)).alias("e"))
    return islands(cut.where("s < e"), ["pid"])
