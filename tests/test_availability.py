import datetime
import json

import pytest

from calendars import NY, Sample, calendar, event, minutes, runs, seconds
from spanloom.errors import InputError
from spanloom.plans.availability import Availability, Shared, busy_periods
from spanloom.sinks.freebusy import IncompleteExport, calendar_bytes, export_identity, fold_line
from spanloom.sources import freebusy, specs



def parsed(spark, *raw):
    rows = spark.createDataFrame([(k, f"f{k}", len(x), "", bytearray(x)) for k, x in enumerate(raw, 1)], "source_ord int, name string, bytes bigint, sha256 string, content binary")
    return freebusy.parsed(rows).orderBy("source_ord").collect()


V1 = {"version": 1, "start": "2025-10-24", "end": "2025-10-28", "timezone": "Europe/Berlin", "weekdays": ["MO", "TU", "FR"], "work_start": "08:00", "work_end": "16:30", "minimum_seconds": 2400, "all_day": "block"}
SPLIT = [["08:30", "11:30"], ["12:30", "16:00"]]
V2 = {k: V1[k] for k in ("start", "end", "timezone", "minimum_seconds", "all_day")} | {"version": 2, "weekly": dict.fromkeys(("MO", "TU", "WE", "TH", "FR"), SPLIT), "exceptions": [{"date": "2025-10-25", "windows": [["11:00", "14:00"]]}, {"date": "2025-10-27", "windows": []}]}


@pytest.fixture(params=[4, 5])
def sample(request):
    return Sample(request.param, entries=9)


@pytest.fixture()
def week(tmp_path, sample):
    path = tmp_path / "sample.ics"
    path.write_text(sample.text, newline="")
    return str(path)


def held(sample):
    """Minutes that anything occupies: an all-day occurrence has its dates whole."""
    return minutes(sample.times) | minutes([(seconds(d), seconds(str(datetime.date.fromisoformat(d) + datetime.timedelta(1)))) for own in sample.dates for d in own])


def test_version_1(spark, week, sample):
    a = Availability(spark, [week], V1)
    free = [minutes([(seconds(f"2025-10-{d} 08:00"), seconds(f"2025-10-{d} 16:30"))]) - held(sample) for d in (24, 27)]
    assert sorted(r.seconds for r in a.candidates().collect()) == sorted(n for day in free for n in runs(day) if n >= 2400)


def test_version_2(spark, week, sample):
    a = Availability(spark, [week], V2)
    windows = {"2025-10-24": SPLIT, "2025-10-25": [["11:00", "14:00"]], "2025-10-26": [], "2025-10-27": []}
    want = {}
    for date, spans in windows.items():
        work = minutes([(seconds(f"{date} {x}"), seconds(f"{date} {y}")) for x, y in spans])
        free = work - held(sample)
        found = [n for x, y in spans for n in runs(minutes([(seconds(f"{date} {x}"), seconds(f"{date} {y}"))]) & free) if n >= V2["minimum_seconds"]]
        status = "closed" if not work else "fully_booked" if not free else "available" if found else "below_minimum"
        want[date] = (60 * len(work), 60 * len(work - free), sum(found), status)
    days = a.days().orderBy("date").collect()
    assert {str(r.date): (r.working_seconds, r.occupied_seconds, r.candidate_seconds, r.status) for r in days} == want


def test_incomplete_calendars_have_no_candidates(spark, tmp_path):
    path = tmp_path / "bad.ics"
    path.write_text(calendar(event("u", "20251024T140000Z", None, "RRULE:FREQ=YEARLY")))
    a = Availability(spark, [str(path)], V2)
    days = a.days().orderBy("date").collect()
    assert a.candidates().count() == 0 and {r.status for r in days} == {"closed", "incomplete"} and {r.free_seconds for r in days} == {None}
    with pytest.raises(IncompleteExport):
        busy_periods(spark, [str(path)], "2025-10-24", "2025-10-25", "UTC", "ignore")


def test_witnesses(spark, tmp_path):
    path = tmp_path / "w.ics"
    path.write_text(calendar(event("a", f"{NY}20260306T090000", f"{NY}20260306T110000"), event("b", f"{NY}20260306T100000", f"{NY}20260306T110000"), event("c", f"{NY}20260306T113000", f"{NY}20260306T170000")))
    gaps = Availability(spark, [str(path)], V1 | {"start": "2026-03-06", "end": "2026-03-07", "timezone": "America/New_York", "work_start": "09:00", "work_end": "17:00", "minimum_seconds": 1800}).candidates().collect()
    assert [(r.seconds, [x["ord"] & 0xFFFFFFFF for x in r.before], [x["ord"] & 0xFFFFFFFF for x in r.after]) for r in gaps] == [(1800, [1, 2], [3])]


@pytest.mark.parametrize(("zone", "date", "clock", "error"), [("America/New_York", "2026-03-08", "02:30", "Nonexistent"), ("America/New_York", "2026-11-01", "01:30", "Ambiguous"), ("Pacific/Apia", "2011-12-30", "09:00", "Nonexistent")])
def test_boundaries_have_to_be_one_instant(spark, week, zone, date, clock, error):
    after = str(datetime.date.fromisoformat(date) + datetime.timedelta(1))
    with pytest.raises(InputError, match=error):
        Availability(spark, [week], V1 | {"start": date, "end": after, "timezone": zone, "weekdays": list(specs.WEEKDAYS), "work_start": clock, "work_end": "17:00"})


@pytest.mark.parametrize("change", [{"version": 3}, {"weekdays": ["MO", "MO"]}, {"work_end": "08:00"}, {"work_start": "9:00"}, {"minimum_seconds": 0}, {"minimum_seconds": True}, {"all_day": "maybe"}, {"timezone": "X/Y"}, {"end": "2025-10-24"}, {"extra": 1}])
def test_bad_specifications(change):
    with pytest.raises(InputError):
        specs.validate_spec(V1 | change)


@pytest.mark.parametrize("change", [{"weekly": {"XX": []}}, {"weekly": {"MO": [["09:00", "12:00"], ["11:00", "13:00"]]}}, {"exceptions": [{"date": "2025-12-01", "windows": []}]}, {"exceptions": [{"date": "2025-10-25", "windows": []}] * 2}, {"exceptions": [{"date": "2025-10-25"}]}])
def test_bad_schedules(change):
    with pytest.raises(InputError):
        specs.validate_spec(V2 | change)


def test_json_keys_occur_once():
    with pytest.raises(InputError):
        specs.parse_json(b'{"a": 1, "a": 2}')


def test_busy_export_round_trip(spark, tmp_path):
    path = tmp_path / "x.ics"
    path.write_text(calendar(event("a", "20260303T090000Z", "20260303T100000Z"), event("b", "20260303T100000Z", "20260303T110000Z"), event("c", "20260303T093000Z", "20260303T094500Z"), event("d", "20260303T120000Z", "20260303T130000Z", "TRANSP:TRANSPARENT"), event("e", ";VALUE=DATE:20260304")))
    lo, hi, found = busy_periods(spark, [str(path)], "2026-03-03", "2026-03-05", "UTC", "ignore")
    assert [(b - a, (a - lo) // 3600) for a, b in found] == [(7_200, 9)]
    assert len(busy_periods(spark, [str(path)], "2026-03-03", "2026-03-05", "UTC", "block")[2]) == 2
    uid, created = export_identity("123e4567-e89b-42d3-a456-426614174000", "2026-03-01T00:00:00Z")
    raw = calendar_bytes(found, lo, hi, uid, created)
    (got,) = parsed(spark, raw)
    assert (got.error, got.lo, got.hi, [tuple(p) for p in got.periods]) == (None, lo, hi, [("BUSY", *found[0])])
    for bad in ("123E4567-e89b-42d3-a456-426614174000", "123e4567-e89b-12d3-a456-426614174000"):
        with pytest.raises(ValueError):
            export_identity(bad)


def test_fold():
    line = "DESCRIPTION:" + "äöü€😀" * 40
    parts = fold_line(line).split("\r\n")
    assert all(len(p.encode()) <= 75 for p in parts) and all(p[0] == " " for p in parts[1:]) and parts[0] + "".join(p[1:] for p in parts[1:]) == line


HEAD = "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:x\r\nBEGIN:VFREEBUSY\r\nUID:u\r\nDTSTAMP:20260301T000000Z\r\nDTSTART:{}\r\nDTEND:{}\r\n"
TAIL = "END:VFREEBUSY\r\nEND:VCALENDAR\r\n"


def fb(lo, hi, *lines):
    return HEAD.format(lo, hi) + "".join(x + "\r\n" for x in lines) + TAIL


DAY = ("20260309T000000Z", "20260310T000000Z")


REJECTED = [
    "FREEBUSY:20260309T050000Z", "FREEBUSY:20260309T050000Z/20260309T050000Z", "FREEBUSY:20260309T050000Z/PT0M", "FREEBUSY:20260309T050000Z/P2WT3H", "FREEBUSY:20260309T213000Z/PT2H31M", "FREEBUSY;FBTYPE=MAYBE:20260309T050000Z/PT1H", "FREEBUSY;TZID=UTC:20260309T050000Z/PT1H",
    "FREEBUSY:20260309T050000/PT1H", "EXDATE:20260309T050000Z", "UID:second", "no colon here", "LOCATION:x", "FREEBUSY:20260309T050000Z/PT1H,,", "FREEBUSY:20260309T050000Z/PT1M1H", "FREEBUSY;VALUE=DATE:20260309T050000Z/PT1H", "FREEBUSY:20260309T250000Z/PT1H", "FREEBUSY;FBTYPE=BUSY;FBTYPE=FREE:20260309T050000Z/PT1H", "", "BEGIN:VEVENT", "CONTACT:",
]
ACCEPTED = {"FREEBUSY:20260309T050000Z/PT1H30S": [("BUSY", 5 * 3600, 6 * 3600 + 30)], "freebusy;fbtype=busy-tentative:20260309T000000Z/+P1D,20260309T010000Z/20260309T013000Z": [("BUSY-TENTATIVE", 0, 86_400), ("BUSY-TENTATIVE", 3600, 5400)], "COMMENT:a\r\nCOMMENT:b\r\n c": [], 'FREEBUSY;FBTYPE="FREE":20260309T100000Z/PT90M': [("FREE", 36_000, 41_400)]}


def test_rejected_and_accepted_freebusy(spark):
    base = seconds("2026-03-09 00:00", "UTC")
    got = parsed(spark, *(fb(*DAY, line).encode() for line in [*REJECTED, *ACCEPTED]), b"", b" x", fb(*DAY).replace("\r\n", "\r").encode(), fb(*DAY).replace("UID:u", "UID:\xff").encode("latin-1"), fb(*DAY).replace("UID:u\r\n", "").encode(), fb("20260309T000000Z", "20260709T000000Z").encode())
    assert [r.error is None for r in got] == [False] * len(REJECTED) + [True] * len(ACCEPTED) + [False] * 6
    assert [[(p.kind, p.s - base, p.e - base) for p in r.periods] for r in got[len(REJECTED) : -6]] == list(ACCEPTED.values())


def test_names_are_ascii(spark):
    """Letters that a general upper case turns into A-Z are none of a name or a fixed value."""
    good = fb(*DAY).lower().replace("t0", "T0").replace("z\r\n", "Z\r\n").encode()
    long_s = [fb(*DAY).replace("BEGIN:VFREEBUSY", "BEGIN:VFREEBUſY").encode(), fb(*DAY).replace("PRODID:x", "PRODID:x\r\nMETHOD:PUBLIſH").encode(), fb(*DAY, "FREEBUSY;FBTYPE=BUſY:20260309T050000Z/PT1H").encode()]
    assert [r.error is None for r in parsed(spark, good, *long_s)] == [True, False, False, False]


def test_shared_windows(spark, tmp_path):
    (tmp_path / "a.ics").write_text(fb("20260309T000000Z", "20260311T000000Z", "FREEBUSY:20260309T140000Z/PT1H", "FREEBUSY;FBTYPE=FREE:20260309T000000Z/PT12H"), newline="")
    (tmp_path / "b.ics").write_text(fb(*DAY, "FREEBUSY;FBTYPE=BUSY-TENTATIVE:20260309T160000Z/20260309T163000Z"), newline="")
    manifest = {"version": 1, "start": "2026-03-09T00:00:00Z", "end": "2026-03-11T00:00:00Z", "duration_seconds": 1800, "participants": [
        {"alias": "A", "timezone": "America/New_York", "weekly": dict.fromkeys(("MO", "TU"), [["09:00", "17:00"]]), "sources": [{"path": "a.ics", "complete_occupancy": True}]},
        {"alias": "B", "timezone": "Europe/London", "weekly": dict.fromkeys(("MO", "TU"), [["09:00", "17:00"]]), "sources": [{"path": "b.ics", "complete_occupancy": True}]},
    ]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(manifest))
    shared = Shared(spark, str(path))
    hour = lambda t: (t - shared.lo) / 3600
    assert [(hour(r.s), hour(r.e)) for r in shared.windows.orderBy("s").collect()] == [(13, 14), (15, 16), (16.5, 17)]
    assert not shared.coverage_complete
    assert {r.pid: hour(r.s) for r in shared.sets.where("kind = 'coverage_gaps'").collect()} == {2: 24}
    assert [r.start for r in shared.local().where("pid = 1").orderBy("s").collect()][0] == "2026-03-09T09:00:00-04:00"
    with pytest.raises(InputError):
        specs.validate_manifest(manifest | {"duration_seconds": 0})
    manifest["participants"][1]["sources"][0]["path"] = "a.ics"
    path.write_text(json.dumps(manifest))
    with pytest.raises(InputError, match="one participant"):
        Shared(spark, str(path))
