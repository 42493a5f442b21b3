"""Zones as tables of the periods in which their offset stays the same."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import times

#: Before and after all civil times.
_EVER = 1 << 60
SCHEMA = "zone string, lo bigint, hi bigint, shown bigint, offset bigint"


def transitions(spark: SparkSession, zones: Iterable[str], first: int, last: int) -> DataFrame:
    """(zone, at, before, after): the instants from day ``first`` to day ``last`` (since 1970) at which a zone's offset changes, in seconds.

    Days, then the minutes and seconds of those over which the offset changes, are compared by the functions that convert times one by
    one, so the table knows what they know. Two changes in one day that cancel out aren't seen; no zone has them.
    """
    off = lambda t: times.seconds(times.from_utc(times.instant(t), F.col("zone"))) - t
    now = spark.range(first, last + 1).select((F.col("id") * times.DAY).alias("t"), F.explode(F.array(*map(F.lit, sorted(zones)))).alias("zone"))
    now = now.where(off(F.col("t")) != off(F.col("t") + times.DAY))
    for step, unit in ((times.DAY, 60), (60, 1)):
        now = now.select("zone", F.explode(F.sequence(F.col("t"), F.col("t") + step - unit, F.lit(unit))).alias("t"))
        now = now.where(off(F.col("t")) != off(F.col("t") + unit))
    return now.select("zone", (F.col("t") + 1).alias("at"), off(F.col("t")).alias("before"), off(F.col("t") + 1).alias("after"))


def periods(spark: SparkSession, zones: Iterable[str], first: int, last: int) -> DataFrame:
    """(zone, lo, hi, shown, offset): civil time, in seconds, parted by what to subtract from it to get the instant.

    A time is in the period with lo <= time < hi; the zone never shows those from ``shown`` on, which it skips. Skipped times take the offset
    before the gap, times shown twice the first. A zone has a row and two more a year at most. Civil times have to lie
    between the days ``first`` and ``last``.
    """
    zones = sorted(set(zones))
    if zones in ([], ["UTC"]):
        return spark.createDataFrame([(z, -_EVER, _EVER, _EVER, 0) for z in zones], SCHEMA)
    start = F.lit((first - 2) * times.DAY).cast("bigint")
    base = spark.range(1).select(F.explode(F.array(*map(F.lit, zones))).alias("zone"))
    base = base.select("zone", F.lit(None).cast("bigint").alias("at"), (times.seconds(times.from_utc(times.instant(start), F.col("zone"))) - start).alias("before"), F.lit(0).cast("bigint").alias("after"))
    changes, offsets, rows = defaultdict(list), {}, []
    for r in transitions(spark, zones, first - 2, last + 2).unionByName(base).collect():
        if r.at is None:
            offsets[r.zone] = r.before
        else:
            changes[r.zone].append((r.at, r.before, r.after))
    for zone, offset in offsets.items():
        lo = -_EVER
        for at, before, after in sorted(changes[zone]):
            hi = max(at + before, at + after)
            rows.append((zone, lo, hi, at + before, offset))
            lo, offset = hi, after
        rows.append((zone, lo, _EVER, _EVER, offset))
    return spark.createDataFrame(rows, SCHEMA)
