"""Recurrence rules as columns: parsing, and expansion of daily and weekly rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import times, zones

_KEYS = ("FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "WKST")
_DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def parse_rule(rule: Column | str) -> Column:
    """A rule's text as a struct (freq, interval, count, until, byday, wkst, error).

    Only daily and weekly rules are known, with INTERVAL and COUNT of up to nine digits, COUNT or
    UNTIL but not both, and BYDAY and WKST of weekly rules; anything else names its error and the rest is null.
    """
    rule = F.upper(F.col(rule) if isinstance(rule, str) else rule)
    parts = F.split(rule, ";")
    names = F.transform(parts, lambda p: F.substring_index(p, "=", 1))
    well = F.forall(parts, lambda p: F.regexp_like(p, F.lit("^[A-Z]+=[^=]+$")))
    part = lambda key: F.get(F.filter(F.transform(parts, lambda p: F.when(F.substring_index(p, "=", 1) == key, F.substring_index(p, "=", -1))), lambda v: v.isNotNull()), F.lit(0))
    freq, interval, count, until, byday, wkst = (part(k) for k in _KEYS)
    number = lambda v: F.regexp_like(v, F.lit("^0{0,8}[1-9][0-9]{0,8}$")) & (F.length(v) <= 9)
    days = F.split(byday, ",")
    known = lambda d: d.isin(*_DAYS)
    error = (
        F.when(rule.isNull(), F.lit(None).cast("string"))
        .when(~well, "malformed")
        .when(F.size(names) != F.size(F.array_distinct(names)), "duplicate part")
        .when(F.size(F.array_except(names, F.array(*map(F.lit, _KEYS)))) > 0, "unsupported part")
        .when(freq.isNull() | ~freq.isin("DAILY", "WEEKLY"), "unsupported frequency")
        .when((freq == "DAILY") & (byday.isNotNull() | wkst.isNotNull()), "weekly part of a daily rule")
        .when(interval.isNotNull() & ~number(interval), "bad interval")
        .when(count.isNotNull() & ~number(count), "bad count")
        .when(count.isNotNull() & until.isNotNull(), "count and until")
        .when(byday.isNotNull() & (~F.forall(days, known) | (F.size(days) != F.size(F.array_distinct(days)))), "bad weekday")
        .when(wkst.isNotNull() & ~known(wkst), "bad weekday")
    )
    ok = lambda v: F.when(rule.isNotNull() & error.isNull(), v)
    return F.struct(
        ok(freq).alias("freq"),
        ok(F.coalesce(interval.try_cast("int"), F.lit(1))).alias("interval"),
        ok(count.try_cast("int")).alias("count"),
        ok(until).alias("until"),
        ok(F.array_sort(F.transform(days, times.weekday_number))).alias("byday"),
        ok(F.coalesce(times.weekday_number(wkst), F.lit(0)).cast("int")).alias("wkst"),
        error.alias("error"),
    )


def _placed(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` (zone, start) with ``skips``: numbers of their candidates that the zone skips, but for the first.

    Only rows whose time of day some gap of the zone has look at its gaps, two a year at most.
    """
    gaps = table.where("shown < hi").groupBy("zone").agg(F.array_sort(F.collect_list(F.struct("shown", "hi"))).alias("_gaps"))
    day = lambda g: F.floor((g["hi"] - 1 - F.col("start")) / times.DAY).cast("bigint")
    hit = lambda g: (day(g) > 0) & (F.col("start") + day(g) * times.DAY >= g["shown"])
    week = lambda d: F.floor((d + F.col("shift")) / 7).cast("bigint")
    in_week = lambda d: F.size(F.filter("byday", lambda x: F.pmod(x - F.col("wkst"), F.lit(7)) < F.pmod(d + F.col("shift"), F.lit(7))))
    weekly = F.col("freq") == "WEEKLY"
    chosen = lambda d: F.when(weekly, (F.pmod(week(d), F.col("interval")) == 0) & F.array_contains("byday", F.pmod(d + F.col("shift") + F.col("wkst"), F.lit(7)).cast("int"))).otherwise(F.pmod(d, F.col("interval")) == 0)
    number = lambda d: F.when(weekly, _week_number((week(d) / F.col("interval")).cast("bigint"), in_week(d))).otherwise((d / F.col("interval")).cast("bigint"))
    found = F.transform(F.filter("_gaps", lambda g: hit(g) & chosen(day(g))), lambda g: number(day(g)))
    none = F.array().cast("array<bigint>")
    return rows.join(F.broadcast(gaps), "zone", "left").withColumn("skips", F.when(F.col("_gaps").isNotNull() & F.col("freq").isNotNull(), F.coalesce(found, none)).otherwise(none)).drop("_gaps")


def _week_number(week: Column, before: Column) -> Column:
    """Number from 0 of a weekly candidate: in which of the rule's weeks, and how many weekdays of that week come before it."""
    # of the first week only days from the start on count, and the start itself where its weekday isn't named
    return week * F.size("byday") + before - F.col("early") + F.col("extra")


def expand(masters: DataFrame, until_local: Column, key: str = "family", from_local: Column | None = None) -> DataFrame:
    """Occurrence starts of recurring masters: (key, ordinal, local, utc), before exclusions.

    masters: key, local (civil start), zone, freq (DAILY, WEEKLY or null for a single
    event), interval, byday (weekdays from 0; null: the start's), wkst, count, until_utc
    (inclusive, null: none). ``until_local``: the last civil time asked for; ``from_local``: the first (null, or none given: the start).
    Each day's civil time is the start's; one that the zone skips is no occurrence and takes no number, but the first
    always is one. COUNT counts before exclusions. A master of null start or zone has no occurrence.

    Candidates are numbered in closed form, from the start, so those before ``from_local`` or beyond COUNT are never made: a
    division gives the first and last step in reach. Masters are joined with the periods of their zone's offset
    (:func:`spanloom.functions.zones.periods`; one pass finds the zones and days), so instants are sums and only masters that a zone's gaps
    meet look at them. Nothing is shuffled, and a key's masters are numbered each for itself.
    """
    spec = {f.name for f in masters.schema.fields}
    opt = lambda c, kind: F.col(c).cast(kind) if c in spec else F.lit(None).cast(kind)
    start_day = times.weekday("local")
    rows = masters.select(F.col(key).alias("_key"), "local", "zone", opt("freq", "string").alias("freq"), F.coalesce(opt("interval", "int"), F.lit(1)).alias("interval"), F.array_sort(F.array_distinct(F.coalesce(opt("byday", "array<int>"), F.array(start_day)))).alias("byday"), F.coalesce(opt("wkst", "int"), F.lit(0)).alias("wkst"), opt("count", "int").alias("count"), opt("until_utc", "timestamp_ntz").alias("until_utc"), until_local.alias("horizon"), (F.lit(None) if from_local is None else from_local).cast("timestamp_ntz").alias("begin"))
    rows = rows.where("local is not null and zone is not null and horizon is not null")
    secs = times.seconds
    # an end in UTC is two days later at most on any clock
    last = F.least(secs("horizon"), F.coalesce(secs("until_utc") + 2 * times.DAY, secs("horizon")))
    rows = rows.withColumns({"start": secs("local"), "last": F.when(F.col("freq").isNull(), secs("local")).otherwise(F.greatest(last, secs("local"))), "first": F.greatest(secs("local"), F.coalesce(secs("begin"), secs("local")))})
    found = rows.agg(F.collect_set("zone").alias("zones"), F.min("start").alias("lo"), F.max("last").alias("hi")).first()
    table = zones.periods(masters.sparkSession, found.zones, (found.lo or 0) // times.DAY, (found.hi or 0) // times.DAY)
    rel = lambda d: F.pmod(d - F.col("wkst"), F.lit(7))
    rows = rows.withColumn("shift", rel(start_day)).withColumns({"early": F.size(F.filter("byday", lambda d: rel(d) < F.col("shift"))), "extra": (~F.array_contains("byday", start_day)).cast("int"), "rels": F.array_sort(F.transform("byday", rel))})
    rows = _placed(rows, table)
    # the part of each period in reach, in days since the start; a period's first and last day may lie outside, so are checked again
    rows = rows.join(F.broadcast(table), "zone").where((F.col("lo") <= F.col("last")) & (F.col("hi") > F.col("first")))
    day = lambda t: F.floor((t - F.col("start")) / times.DAY).cast("bigint")
    lo, hi = F.greatest(day(F.greatest("lo", "first")), F.lit(0)), day(F.least(F.col("hi") - 1, F.col("last")))
    weekly, size = F.col("freq") == "WEEKLY", F.size("byday")
    most = F.col("count") + F.size("skips")
    step = F.when(weekly, 7 * F.col("interval")).otherwise(F.col("interval")).cast("bigint")
    ahead = F.when(weekly, F.col("shift")).otherwise(0)
    steps = F.when(weekly, F.floor(most / size) + 1).otherwise(most).cast("bigint")
    high = F.floor((hi + ahead) / step).cast("bigint")
    rows = rows.withColumns({"_lo": F.floor((lo + ahead) / step).cast("bigint"), "_hi": F.when(F.col("freq").isNull(), F.lit(0)).otherwise(F.least(high, F.coalesce(steps, high)))}).where("_lo <= _hi")
    rows = rows.withColumn("_step", F.explode(F.sequence("_lo", "_hi")))
    # days of one of the rule's weeks, in order, and the start's own in the first
    named = F.when(weekly, F.when((F.col("_step") == 0) & (F.col("extra") == 1), F.concat("rels", F.array("shift"))).otherwise(F.col("rels"))).otherwise(F.array(F.lit(0)))
    rows = rows.select("*", F.posexplode(named).alias("_before", "_rel"))
    days = F.when(weekly, F.col("_step") * 7 * F.col("interval") + F.col("_rel") - F.col("shift")).otherwise(F.col("_step") * F.col("interval"))
    rows = rows.withColumn("_day", days.cast("int")).withColumn("_t", F.col("start") + F.col("_day").cast("bigint") * times.DAY)
    rows = rows.where("_day >= 0 and _t >= lo and _t < hi and _t >= first and _t <= last and (_t < shown or _day = 0)")
    index = F.when(F.col("_day") == 0, F.lit(0)).when(weekly, _week_number(F.col("_step"), F.col("_before"))).otherwise(F.col("_step"))
    rows = rows.withColumn("_index", index)
    skipped = F.when(F.size("skips") > 0, F.size(F.filter("skips", lambda k: k < F.col("_index")))).otherwise(0)
    local = F.timestamp_add("DAY", F.col("_day"), F.col("local"))
    out = rows.select("_key", (F.col("_index") - skipped + 1).cast("int").alias("ordinal"), local.alias("local"), F.timestamp_add("SECOND", -F.col("offset"), local).alias("utc"), "count", "until_utc", "horizon")
    out = out.where((F.col("count").isNull() | (F.col("ordinal") <= F.col("count"))) & ((F.col("ordinal") == 1) | F.col("until_utc").isNull() | (F.col("utc") <= F.col("until_utc"))) & (F.col("local") <= F.col("horizon")))
    return out.select(F.col("_key").alias(key), "ordinal", "local", "utc")


def without(occurrences: DataFrame, excluded: DataFrame, key: str = "family", on: str = "utc") -> DataFrame:
    """Occurrences that no exclusion of their family names; exclusions of null never match."""
    return occurrences.join(excluded.select(key, on).distinct(), [key, on], "left_anti")


def resolve(occurrences: DataFrame, overrides: DataFrame, key: str = "family", on: str = "utc") -> DataFrame:
    """Occurrences with their single-instance replacements: override columns ``new_s``, ``new_e``, ``status``, null where there is none."""
    return occurrences.join(overrides, [key, on], "left")


def orphans(overrides: DataFrame, occurrences: DataFrame, key: str = "family", on: str = "utc") -> DataFrame:
    """Overrides whose identity the rule, before exclusions, doesn't have."""
    return overrides.join(occurrences.select(key, on), [key, on], "left_anti")


def collisions(overrides: DataFrame, excluded: DataFrame, key: str = "family", on: str = "utc") -> DataFrame:
    """Overrides of an excluded instance."""
    return overrides.join(excluded.select(key, on), [key, on], "left_semi")
