"""Free time of calendars inside working windows, busy-time exports, and windows shared by several participants."""

from __future__ import annotations

import datetime
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, LimitError, Limits
from ..functions import times
from ..operators import intervals as iv
from ..operators import scheduling
from ..operators.rollup import day_spine
from ..session import prepare
from ..sinks import freebusy as freebusy_out
from ..sources import freebusy as freebusy_in
from ..sources import specs
from ..tables import save
from .audit import Audit


def _span(windows: list[list[str]]) -> list[tuple[int, int]]:
    return [(int(a[:2]) * 60 + int(a[3:]), int(b[:2]) * 60 + int(b[3:])) for a, b in windows]


_WINDOWS = "array<struct<lo:int,hi:int>>"


class Availability:
    """Gaps of at least the specification's minimum beside everything that occupies a working window.

    ``windows`` (date, s, e, window), ``busy`` (blocks with members and witnesses), ``candidates`` and ``days`` are
    DataFrames. If the calendars weren't wholly understood there are no candidates, and totals that
    depend on free time are null.
    """

    def __init__(self, spark: SparkSession, paths: list[str], spec: dict, limits: Limits | None = None, max_days: int = 90):
        self.spec = specs.validate_spec(spec, max_days)
        self.audit = Audit(spark, paths, spec["start"], spec["end"], spec["timezone"], None, limits)
        self.spark, zone = self.audit.spark, spec["timezone"]
        self.dates = day_spine(self.spark, self.audit.first, self.audit.last).select("date")
        if self.spec["version"] == 2:
            weekly = self.spark.createDataFrame([(k, _span(self.spec["weekly"].get(d, []))) for k, d in enumerate(specs.WEEKDAYS)], f"weekday int, windows {_WINDOWS}")
            own = self.spark.createDataFrame([(datetime.date.fromisoformat(x["date"]), _span(x["windows"])) for x in self.spec["exceptions"]], f"date date, windows {_WINDOWS}")
            self.schedule = scheduling.effective(self.dates, weekly, own)
            found = scheduling.merge_windows(self.schedule, zone)
        else:
            found = scheduling.working_windows(self.dates, [specs.WEEKDAYS.index(d) for d in self.spec["weekdays"]], self.spec["work_start"], self.spec["work_end"], zone)
        found = save(found, "windows")
        bad = found.where("error is not null").orderBy("date").first()
        if bad is not None:
            raise InputError(f"{bad['error']} working boundary on {bad['date']}")
        if found.where("s >= e").limit(1).count() or scheduling.overlapping_windows(found).limit(1).count():
            raise InputError("working windows overlap or have no length")
        self.windows = found.select("date", "s", "e", F.struct("date", "s").alias("window"))

    @property
    def complete(self) -> bool:
        return self.audit.complete

    def occupied(self) -> DataFrame:
        """(window, id, s, e): what occupies each window; an all-day occurrence that blocks takes the windows of its dates whole."""
        rows = self.audit.occurrences.select(F.struct("ord", "recurrence_id").alias("id"), "s", "e", "all_day")
        held = iv.assign(rows.where("not all_day").select("id", "s", "e"), self.windows.select("window", "s", "e")).select("window", "id", "s", "e")
        if self.spec["all_day"] == "ignore":
            return held
        day = F.to_date(times.instant("s")), F.to_date(times.instant("e"))
        dates = rows.where("all_day").select("id", F.explode(F.sequence(day[0], F.date_sub(day[1], 1))).alias("date"))
        return held.unionByName(dates.join(self.windows, "date").select("window", "id", "s", "e"))

    def busy(self) -> DataFrame:
        return iv.blocks(self.occupied(), ["window"])

    def candidates(self) -> DataFrame:
        found = self._gaps()
        return found if self.complete else found.limit(0)

    def _gaps(self) -> DataFrame:
        held = self.occupied()
        free = iv.subtract(self.windows.select("window", "s", "e"), held, ["window"]).withColumn("seconds", F.col("e") - F.col("s")).where(F.col("seconds") >= self.spec["minimum_seconds"])
        ends = held.groupBy("window", F.col("e").alias("s")).agg(F.array_sort(F.collect_set("id")).alias("before"))
        starts = held.groupBy("window", F.col("s").alias("e")).agg(F.array_sort(F.collect_set("id")).alias("after"))
        edges = self.windows.select("window", F.col("s").alias("w_s"), F.col("e").alias("w_e"))
        out = free.join(edges, "window").join(ends, ["window", "s"], "left").join(starts, ["window", "e"], "left")
        none = F.array().cast(held.select(F.array("id")).schema[0].dataType)
        return out.select("window", F.col("window.date").alias("date"), "s", "e", "seconds", F.when(F.col("s") == F.col("w_s"), none).otherwise(F.coalesce("before", none)).alias("before"), F.when(F.col("e") == F.col("w_e"), none).otherwise(F.coalesce("after", none)).alias("after"))

    def days(self) -> DataFrame:
        """Each date explained: working, occupied, free and candidate seconds and its status."""
        zero = F.lit(0).cast("bigint")
        work = self.windows.groupBy("date").agg(F.sum(F.col("e") - F.col("s")).alias("w"))
        used = iv.union_seconds(self.occupied(), ["window"]).groupBy(F.col("window.date").alias("date")).agg(F.sum("seconds").alias("o"))
        gaps = self._gaps().groupBy("date").agg(F.sum("seconds").alias("c"))
        rows = self.dates.join(work, "date", "left").join(used, "date", "left").join(gaps, "date", "left").withColumn("complete", F.lit(self.complete))
        known = lambda c: F.when(F.col("complete"), c)
        w, o = F.coalesce("w", zero), F.coalesce("o", zero)
        rows = rows.select("date", w.alias("working_seconds"), o.alias("observed_occupied_seconds"), known(o).alias("occupied_seconds"), known(w - o).alias("free_seconds"), known(F.coalesce("c", zero)).alias("candidate_seconds"), "complete")
        return scheduling.day_status(rows, self.spec["minimum_seconds"])


def busy_periods(spark: SparkSession, paths: list[str], start: str, end: str, zone: str, all_day: str, limits: Limits | None = None, max_intervals: int = 20_000) -> tuple[int, int, list[tuple[int, int]]]:
    """(begin, end, periods) of a minimal busy-time export. Incomplete calendars raise, as do too many periods."""
    if all_day not in ("block", "ignore"):
        raise InputError("all_day is block or ignore")
    audit = Audit(spark, paths, start, end, zone, None, limits)
    local = lambda d: F.lit(d).cast("timestamp_ntz")
    edges = audit.spark.range(1).select(*(x for d in (audit.first, audit.last) for x in times.strict(local(d), zone))).first()
    if edges[1] or edges[3]:
        raise InputError(f"{edges[1] or edges[3]} midnight at the horizon")
    if not audit.complete:
        raise freebusy_out.IncompleteExport("calendars weren't wholly understood; nothing is exported")
    rows = audit.occurrences.where("not all_day").select("s", "e")
    if all_day == "block":
        days = audit.occurrences.where("all_day").select(*(times.strict(times.instant(c), zone)[0].alias(n) for c, n in (("cs", "s"), ("ce", "e"))))
        if days.where("s is null or e is null").limit(1).count():
            raise InputError("an all-day occurrence begins or ends at a midnight that isn't one instant")
        rows = rows.unionByName(days)
    merged = freebusy_out.periods(rows, audit.lo, audit.hi).orderBy("s").limit(max_intervals + 1).collect()
    if len(merged) > max_intervals:
        raise LimitError(f"more than {max_intervals} periods")
    return edges[0], edges[2], [(r.s, r.e) for r in merged]


class Shared:
    """Windows in which every participant of a manifest is known to work and to be free.

    Time that a participant's sources don't cover is unknown and never free. ``sets`` has (pid, kind, s, e)
    for the kinds coverage, coverage_gaps, busy, working, known_working and free; ``windows`` the shared ones.
    """

    def __init__(self, spark: SparkSession, manifest_path: str, limits: Limits | None = None):
        self.spark, self.limits = prepare(spark), limits or Limits()
        raw = specs.read_small(manifest_path, specs.MANIFEST_BYTES)
        self.manifest, self.manifest_source = specs.validate_manifest(specs.parse_json(raw)), specs.fingerprint(manifest_path, raw)
        base, owners, paths = os.path.dirname(os.path.abspath(manifest_path)), [], []
        seen: dict[tuple[int, int], int] = {}
        size = 0
        for pid, p in enumerate(self.manifest["participants"], 1):
            for s in p["sources"]:
                path = os.path.join(base, s["path"])
                specs.regular(path)
                st = os.stat(path)
                size += st.st_size
                self.limits.check("input_bytes", size)
                if seen.setdefault((st.st_dev, st.st_ino), pid) != pid:
                    raise InputError("a source file belongs to one participant")
                paths.append(path)
                owners.append((len(paths), pid))
        self.lo, self.hi = self.manifest["lo"], self.manifest["hi"]
        files = save(freebusy_in.read(self.spark, paths), "freebusy")
        self.limits.check("periods", files.agg(F.sum(F.size("periods"))).first()[0] or 0)
        self.files = freebusy_in.require(files).join(self.spark.createDataFrame(owners, "source_ord int, pid int"), "source_ord")
        self.people = self.spark.createDataFrame([(k, p["alias"], p["timezone"]) for k, p in enumerate(self.manifest["participants"], 1)], "pid int, alias string, zone string")
        self.sets = save(self._sets(), "sets")
        self.limits.check("intervals", self.sets.count())
        common = iv.common(self.sets.where("kind = 'free'"), "pid", len(self.manifest["participants"]))
        length = self.manifest["duration_seconds"]
        found = common.withColumn("seconds", F.col("e") - F.col("s")).where(F.col("seconds") >= length)
        self.windows = save(found.withColumn("latest_start", F.col("e") - length), "shared")
        self.limits.check("windows", self.windows.count())

    def _sets(self) -> DataFrame:
        lo, hi = self.lo, self.hi
        cover = iv.islands(iv.clip(self.files.select("pid", F.col("lo").alias("s"), F.col("hi").alias("e")), lo, hi), ["pid"])
        periods = self.files.select("pid", F.explode("periods").alias("p")).where("p.kind <> 'FREE'").select("pid", "p.s", "p.e")
        busy = iv.islands(iv.clip(periods, lo, hi), ["pid"])
        rows = [(k, p["timezone"], specs.WEEKDAYS.index(d), a, b) for k, p in enumerate(self.manifest["participants"], 1) for d, w in p["weekly"].items() for a, b in _span(w)]
        shifts = self.spark.createDataFrame(rows, "pid int, zone string, weekday int, lo int, hi int")
        day = lambda t: datetime.datetime.fromtimestamp(t, datetime.timezone.utc).date()
        one = datetime.timedelta(1)
        dates = day_spine(self.spark, day(lo) - 2 * one, day(hi) + 2 * one).select("date")
        work = scheduling.shifts(shifts, dates, lo, hi)
        horizon = self.people.select("pid", F.lit(lo).cast("bigint").alias("s"), F.lit(hi).cast("bigint").alias("e"))
        known = iv.intersect(work, cover, ["pid"])
        sets = {"coverage": cover, "coverage_gaps": iv.subtract(horizon, cover, ["pid"]), "busy": busy, "working": work, "known_working": known, "free": iv.subtract(known, busy, ["pid"])}
        out = None
        for kind, df in sets.items():
            own = df.select("pid", F.lit(kind).alias("kind"), "s", "e")
            out = own if out is None else out.unionByName(own)
        return out

    @property
    def coverage_complete(self) -> bool:
        return self.sets.where("kind = 'coverage_gaps'").limit(1).count() == 0

    def local(self) -> DataFrame:
        """Every window on each participant's clock."""
        rows = self.windows.join(F.broadcast(self.people), F.lit(True))
        return rows.select("s", "pid", *(times.local_text(times.instant(c), F.col("zone")).alias(n) for c, n in (("s", "start"), ("e", "end"), ("latest_start", "latest"))))
