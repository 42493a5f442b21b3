"""Calendar files to occurrences: families are checked and resolved by joins and grouped aggregation on their UID."""

from __future__ import annotations

import datetime
import re
import zoneinfo
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, Limits
from ..functions import times
from ..operators import intervals as iv
from ..operators import families, recurrence
from ..operators.rollup import daily, day_spine
from ..session import prepare
from ..sources import ics
from ..sources import lines as text_lines
from ..tables import save, save_counted

#: Order of the checks of a family; the first that fails names the family's error.
_TEXT, _SNAPSHOTS, _CARDINALITY, _CANCELLED, _MASTER, _NONRECURRING, _OVERRIDE, _EXPANSION = range(8)


def _window(start: str, end: str, zone: str) -> tuple[datetime.date, datetime.date, int, int]:
    try:
        if not all(re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", x) for x in (start, end)):
            raise ValueError("dates are like 2026-01-31")
        first, last = (datetime.date.fromisoformat(x) for x in (start, end))
        local = [datetime.datetime.combine(d, datetime.time(), zoneinfo.ZoneInfo(zone)) for d in (first, last)]
    except (ValueError, KeyError, OSError) as e:
        raise InputError(f"bad window or zone: {e}") from None
    if not 1 <= (last - first).days <= 90:
        raise InputError("a window has 1 to 90 civil days")
    return first, last, *(int(x.timestamp()) for x in local)


class Audit:
    """Occurrences, issues and rollups of calendar files within [start, end) on ``zone``'s civil days.

    Every attribute is a DataFrame, computed on first use and then kept as a table in the shared folder. Times in seconds are UTC; dates of all-day occurrences are
    civil. Records are known by ``ord`` (the file's number in the upper and the event's number in it in the lower 32 bits).
    """

    def __init__(self, spark: SparkSession, paths: Sequence[str], start: str, end: str, zone: str, floating_timezone: str | None = None, limits: Limits | None = None):
        self.spark, self.paths, self.zone, self.floating = prepare(spark), list(paths), zone, floating_timezone
        self.limits, self._counts = limits or Limits(), {}
        if not self.paths:
            raise InputError("no calendar given")
        self.first, self.last, self.lo, self.hi = _window(start, end, zone)
        if floating_timezone is not None and floating_timezone not in zoneinfo.available_timezones():
            raise InputError("unknown zone for floating times")
        self.limits.check("files", len(self.paths))

    @cached_property
    def _read(self) -> tuple[DataFrame, DataFrame]:
        # sizes come from the listing, so too much input is refused before any of it is read
        size, largest = text_lines.sizes(self.spark, self.paths).agg(F.sum("bytes"), F.max("bytes")).first()
        self.limits.check("input_bytes", size)
        files, events = ics.read(self.spark, self.paths, self.floating or self.zone, self.floating is not None, largest > ics.WIDE_FILE)
        self.limits.check("line_bytes", files.agg(F.max("longest")).first()[0] or 0)
        return files, events

    def _kept(self, df: DataFrame, name: str, counter: str | None = None) -> DataFrame:
        """``df`` as a table, its rows counted by the job that writes it and held against the limit of that counter."""
        out, self._counts[name] = save_counted(df, name)
        if counter:
            self.limits.check(counter, self._counts[name])
        return out

    @property
    def files(self) -> DataFrame:
        return self._read[0]

    @cached_property
    def sources(self) -> DataFrame:
        return self.files.select("source_ord", "name", "bytes", "sha256")

    @cached_property
    def records(self) -> DataFrame:
        """Every event as a record: identity, decoded values and what is wrong with it alone."""
        rows = self._read[1].withColumn("ord", F.shiftleft(F.col("source_ord").cast("bigint"), 32) + F.col("no"))
        return self._kept(rows, "records", "events")

    def _decoded(self, start: Column, transp: Column, status: Column, rule: bool) -> dict[str, Column]:
        """bad, duration and the rule's end, for a record with the given (perhaps inherited) values."""
        end, kind = F.col("end"), start["kind"]
        is_date = kind == "date"
        floating = lambda t: t["kind"] == "floating"
        given = F.when(F.col("ends") == 1, F.when(is_date, times.seconds(end["value"]) - times.seconds(start["value"])).otherwise(end["utc"] - start["utc"]))
        duration = F.coalesce(given, F.when(is_date, times.DAY).otherwise(0).cast("bigint"))
        same = lambda t: (t["kind"] == "date").eqNullSafe(is_date) & floating(t).eqNullSafe(floating(start))
        wrong_end = (F.col("ends") > 1) | (F.col("ends") == 1) & (end["kind"].isNull() | ~same(end) | (given <= 0))
        expected = F.when(is_date, "date").when(kind == "floating", "floating").otherwise("utc")
        wrong_rule = F.lit(False)
        if rule:
            weekday = times.weekday(start["value"])
            wrong_until = F.col("rule.until").isNotNull() & (~F.col("rule.until.kind").eqNullSafe(expected) | (F.col("rule.until.utc") < start["utc"]))
            wrong_rule = (F.col("rules") > 1) | F.col("rule.error").isNotNull() | wrong_until | F.col("rule.byday").isNotNull() & ~F.array_contains("rule.byday", weekday)
        wrong_excluded = F.exists(F.coalesce("excluded", F.array()), lambda t: t["kind"].isNull() | ~same(t)) if rule else F.lit(False)
        enums = F.coalesce(transp, F.lit("OPAQUE")).isin("OPAQUE", "TRANSPARENT") & F.coalesce(status, F.lit("CONFIRMED")).isin("CONFIRMED", "TENTATIVE", "CANCELLED")
        bad = kind.isNull() | F.col("bad_enum") | wrong_end | wrong_rule | wrong_excluded | ~enums | F.col("has_unsupported")
        return {"bad": F.coalesce(bad, F.lit(True)), "duration": duration, "until_utc": times.instant("rule.until.utc")}

    @cached_property
    def members(self) -> DataFrame:
        """Records with a usable UID."""
        return self.records.where("uid is not null and uid <> ''")

    @cached_property
    def unique(self) -> DataFrame:
        """The first record of each UID and fingerprint."""
        first = families.dedup(self.members, source="source_ord").select(F.col("canonical").alias("ord"))
        return save(self.members.join(first, "ord", "left_semi"), "unique")

    @cached_property
    def masters(self) -> DataFrame:
        rows = self.unique.where("not is_override")
        plain = self._decoded(F.col("start"), F.col("transp"), F.col("status"), True)
        cancelled = F.coalesce(F.col("status") == "CANCELLED", F.lit(False)) & ~F.col("bad_enum")
        rows = rows.select("uid", "ord", "start", "summary", "has_summary", "transp", "status", "rule", (F.col("rules") > 0).alias("recurs"), F.coalesce("excluded", F.array()).alias("excluded"), *(v.alias(k) for k, v in plain.items()), cancelled.alias("cancelled"), (F.coalesce("transp", F.lit("OPAQUE")) == "TRANSPARENT").alias("transparent"))
        return save(rows, "masters")

    @cached_property
    def overrides(self) -> DataFrame:
        """Override records beside their master (columns m_*), with values inherited and the checks' outcome in ``code``."""
        one = self.masters.groupBy("uid").agg(F.count("*").alias("n"), *(F.first(c).alias(f"m_{c}") for c in ("ord", "start", "transp", "status", "duration", "excluded", "recurs", "bad", "cancelled", "summary"))).where("n = 1").drop("n")
        rows = self.unique.where("is_override").join(one, "uid")
        transp, status = F.coalesce("transp", "m_transp"), F.coalesce("status", "m_status")
        cancelled = F.coalesce(status == "CANCELLED", F.lit(False))
        start = F.when((F.col("starts") == 0) & cancelled, F.col("rid")).otherwise(F.col("start"))
        d = self._decoded(start, transp, status, False)
        m, rid = F.col("m_start"), F.col("rid")
        again = self.unique.where("is_override and one_identity and rid.kind is not null").groupBy(F.col("uid").alias("_uid"), F.col("rid.value").alias("_value")).agg(F.min("ord").alias("first_ord"))
        rows = rows.join(again, (F.col("uid") == F.col("_uid")) & (rid["value"] == F.col("_value")), "left").drop("_uid", "_value")
        code = (
            F.when(~F.col("one_identity"), F.struct(F.lit(0).alias("sub"), F.lit("unsupported_event").alias("code")))
            .when(F.col("has_range"), F.struct(F.lit(1).alias("sub"), F.lit("unsupported_range").alias("code")))
            .when(rid["kind"].isNull(), F.struct(F.lit(2).alias("sub"), F.lit("unsupported_event").alias("code")))
            .when((rid["kind"] != m["kind"]) | (rid["zone"] != m["zone"]), F.struct(F.lit(3).alias("sub"), F.lit("incompatible_identity").alias("code")))
            .when(F.col("ord") > F.col("first_ord"), F.struct(F.lit(4).alias("sub"), F.lit("conflicting_overrides").alias("code")))
            .when(F.exists("m_excluded", lambda t: t["utc"] == rid["utc"]), F.struct(F.lit(5).alias("sub"), F.lit("exdate_override_collision").alias("code")))
            .when((F.col("rules") > 0) | F.col("has_exdate") | F.col("has_unsupported"), F.struct(F.lit(6).alias("sub"), F.lit("unsupported_override").alias("code")))
            .when((F.col("starts") == 0) & ~cancelled, F.struct(F.lit(7).alias("sub"), F.lit("missing_override_start").alias("code")))
            .when(d["bad"], F.struct(F.lit(8).alias("sub"), F.lit("unsupported_event").alias("code")))
            .when(((start["kind"] == "date") != (m["kind"] == "date")) | ((start["kind"] == "floating") != (m["kind"] == "floating")), F.struct(F.lit(9).alias("sub"), F.lit("incompatible_timing").alias("code")))
        )
        duration = F.when(F.col("ends") == 0, F.col("m_duration")).otherwise(d["duration"])
        inherited = F.array_compact(F.array(F.when(~F.col("has_summary"), "SUMMARY"), F.when(F.col("transp").isNull(), "TRANSP"), F.when(F.col("status").isNull(), "STATUS"), F.when(F.col("ends") == 0, "duration")))
        rows = rows.select("uid", "ord", F.col("m_ord").alias("master"), rid["value"].alias("identity"), code.alias("problem"), start.alias("start"), duration.alias("duration"), cancelled.alias("cancelled"), (transp == "TRANSPARENT").eqNullSafe(F.lit(True)).alias("transparent"), inherited.alias("inherited"), "m_recurs", "m_bad", "m_cancelled")
        return save(rows, "overrides")

    @cached_property
    def errors(self) -> DataFrame:
        """(uid, code, coded): the first failed check of every family that has one; such a family has no occurrence."""
        fail = lambda df, check, code, ord="ord", sub=None: df.select("uid", F.lit(check).alias("check"), F.col(ord).alias("ord"), (F.lit(0) if sub is None else sub).alias("sub"), (F.lit(code) if isinstance(code, str) else code).alias("code"))
        m = self.members
        sets = families.snapshot_conflicts(m, source="source_ord").withColumn("ord", F.lit(0).cast("bigint"))
        # overrides of one instance are told apart below, by the order of the checks of each
        counts = families.cardinality_errors(self.unique.withColumn("identity", F.col("rid.value"))).where("code <> 'conflicting_overrides'").withColumn("ord", F.lit(0).cast("bigint"))
        over = self.overrides
        found = [
            fail(m.where("bad_text"), _TEXT, "unsupported_event"),
            fail(sets, _SNAPSHOTS, "conflicting_snapshots"),
            fail(counts, _CARDINALITY, F.col("code")),
            fail(over.where("m_cancelled"), _CANCELLED, "cancelled_master_with_overrides"),
            fail(self.masters.where("bad and not cancelled"), _MASTER, "unsupported_event"),
            fail(over.where("not m_recurs"), _NONRECURRING, "nonrecurring_master"),
            fail(over.where("problem is not null"), _OVERRIDE, F.col("problem.code"), sub=F.col("problem.sub")),
            fail(self._orphans, _EXPANSION, "orphan_override"),
            fail(self._exhausted.withColumn("ord", F.lit(0).cast("bigint")), _EXPANSION, "resolution_limit", sub=F.lit(-1)),
        ]
        out = found[0]
        for df in found[1:]:
            out = out.unionByName(df)
        first = out.groupBy("uid").agg(F.min(F.struct("check", "ord", "sub", "code")).alias("x"))
        return save(first.select("uid", F.col("x.code").alias("code"), (F.col("x.code") != "unsupported_event").alias("coded")), "errors")

    @cached_property
    def _candidates(self) -> DataFrame:
        """Recurrence instances of understandable masters, before exclusions, up to the window's end or the last override."""
        through = self.overrides.groupBy("uid").agg(F.max("identity").alias("through"))
        m = self.masters.where("not bad and not cancelled").join(through, "uid", "left")
        one = m.groupBy("uid").agg(F.count("*").alias("_n")).where("_n = 1").select("uid")
        m = m.join(one, "uid", "left_semi")
        horizon = F.when(F.col("start.kind") == "date", F.lit(self.last).cast("timestamp_ntz")).otherwise(times.from_utc(times.instant(F.lit(self.hi)), F.col("start.zone")))
        rows = m.select("uid", F.col("start.value").alias("local"), F.col("start.zone").alias("zone"), F.when(F.col("recurs"), F.col("rule.freq")).alias("freq"), "rule.interval", "rule.byday", "rule.wkst", "rule.count", "until_utc", F.greatest(horizon, "through", "start.value").alias("stop"))
        return self._kept(recurrence.expand(rows, F.col("stop"), "uid"), "candidates")

    @cached_property
    def _resolutions(self) -> DataFrame:
        """(uid, n): instances that are looked at to resolve a family's overrides."""
        return save(self._candidates.join(self.overrides.select("uid").distinct(), "uid", "left_semi").groupBy("uid").agg(F.count("*").alias("n")), "resolutions")

    @cached_property
    def _exhausted(self) -> DataFrame:
        """Families whose overrides would take more than the limit to resolve; the whole family is excluded."""
        most = self.limits.resolutions
        return self._resolutions.where(F.lit(False) if most is None else F.col("n") > most).select("uid")

    @cached_property
    def counters(self) -> dict[str, int]:
        """How much was read, expanded, resolved and found."""
        resolved = self._resolutions.agg(F.sum("n")).first()[0] or 0
        _, n = (self.records, self._candidates, self.occurrences), self._counts  # tables are counted when they are made
        out = {"events": n["records"], "candidates": n["candidates"] - resolved, "resolutions": resolved, "occurrences": n["occurrences"]}
        self.limits.check("candidates", out["candidates"])
        return out

    @cached_property
    def _orphans(self) -> DataFrame:
        real = self.overrides.where("problem is null and not m_bad and not m_cancelled and m_recurs")
        return recurrence.orphans(real, self._candidates.select("uid", F.col("local").alias("identity")), "uid", "identity")

    @cached_property
    def _resolved(self) -> DataFrame:
        good = self._candidates.join(self.errors.select("uid"), "uid", "left_anti")
        excluded = self.masters.select("uid", F.explode("excluded").alias("x")).select("uid", times.instant("x.utc").alias("utc"))
        kept = recurrence.without(good, excluded, "uid")
        own = self.masters.select("uid", F.col("ord").alias("master"), F.col("start.kind").alias("kind"), F.col("start.zone").alias("zone"), F.col("duration").alias("m_duration"), F.col("transparent").alias("m_transparent"))
        new = self.overrides.select("uid", F.col("identity").alias("local"), F.col("ord").alias("override"), F.col("start.utc").alias("new_s"), F.col("duration").alias("new_duration"), "cancelled", F.col("transparent").alias("new_transparent"), F.col("start.kind").alias("new_kind"))
        rows = recurrence.resolve(kept.join(own, "uid"), new, "uid", "local")
        zoned = F.concat(F.date_format(F.col("local").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), times.offset_text(times.seconds("local"), times.seconds("utc")))
        identity = F.when(F.col("kind") == "date", F.date_format(F.col("local").cast("timestamp"), "yyyy-MM-dd")).when(F.col("kind") == "floating", F.date_format(F.col("local").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")).when(F.col("kind") == "utc", times.iso("utc")).otherwise(zoned)
        return save(rows.withColumn("recurrence_id", identity), "resolved")

    @cached_property
    def cancellations(self) -> DataFrame:
        """Cancelled instances, also outside the window."""
        return self._resolved.where("cancelled").select("uid", "master", "override", "recurrence_id", "ordinal")

    @cached_property
    def occurrences(self) -> DataFrame:
        """(uid, ord, master, override, recurrence_id, ordinal, all_day, s, e, cs, ce): opaque occurrences that meet the window.

        cs and ce are cut to it; those of all-day occurrences are the first seconds of their civil dates read as UTC.
        """
        rows = self._resolved.where(~F.coalesce("cancelled", F.lit(False)))
        s = F.coalesce("new_s", times.seconds("utc"))
        rows = rows.select("uid", F.coalesce("override", "master").alias("ord"), "master", "override", "recurrence_id", "ordinal", (F.coalesce("new_kind", "kind") == "date").alias("all_day"), s.alias("s"), (s + F.coalesce("new_duration", "m_duration")).alias("e"), F.coalesce("new_transparent", "m_transparent").alias("transparent")).where("not transparent").drop("transparent")
        civil = lambda d: int(datetime.datetime.combine(d, datetime.time(), datetime.timezone.utc).timestamp())
        lo, hi = (F.when(F.col("all_day"), civil(d)).otherwise(t) for d, t in ((self.first, self.lo), (self.last, self.hi)))
        cut = iv.clip(rows.withColumns({"cs": F.col("s"), "ce": F.col("e")}), lo, hi, "cs", "ce")
        return self._kept(cut, "occurrences", "occurrences")

    @cached_property
    def timed(self) -> DataFrame:
        """Timed occurrences cut to the window, as intervals."""
        return self.occurrences.where("not all_day").select(F.struct("ord", "recurrence_id").alias("id"), F.col("cs").alias("s"), F.col("ce").alias("e"))

    @cached_property
    def issues(self) -> DataFrame:
        """(source_ord, ord, code, message): of files, of records without identity, and one for each member of a failed family."""
        null = lambda kind: F.lit(None).cast(kind)
        files = self.files.where("error is not null").select("source_ord", null("bigint").alias("ord"), F.lit("invalid_calendar").alias("code"), F.col("error").alias("message"))
        warned = self.files.select("source_ord", null("bigint").alias("ord"), F.lit("unsupported_component").alias("code"), F.explode("warnings").alias("message"))
        nameless = self.records.where("uid is null or uid = '' or bad_text").select(null("int").alias("source_ord"), "ord", F.lit("invalid_identity").alias("code"), F.lit("Missing, empty or repeated identity").alias("message"))
        failed = self.members.join(self.errors, "uid").select(null("int").alias("source_ord"), "ord", "code", F.concat(F.lit("Family excluded: "), F.col("code")).alias("message"))
        return self._kept(files.unionByName(warned).unionByName(nameless).unionByName(failed), "issues")

    @cached_property
    def complete(self) -> bool:
        """False if anything wasn't understood; absence of occurrences then proves nothing."""
        _ = self.issues
        return self._counts["issues"] == 0

    @cached_property
    def overlaps(self) -> DataFrame:
        return self._kept(iv.overlap_pairs(self.timed), "pairs", "pairs")

    @cached_property
    def daily(self) -> DataFrame:
        date = lambda c: F.to_date(times.instant(c))
        whole = self.occurrences.where("all_day").select(date(F.col("cs")).alias("ds"), date(F.col("ce")).alias("de"))
        return daily(self.timed, day_spine(self.spark, self.first, self.last, self.zone), (), whole)

    def occupied_seconds(self) -> int:
        return iv.union_seconds(self.timed).first()["seconds"] or 0
