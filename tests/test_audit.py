import datetime
import itertools

import pytest

from calendars import NY, Sample, calendar, event, minutes, seconds
from spanloom.errors import InputError, LimitError, Limits
from spanloom.plans.audit import Audit


number = itertools.count()


@pytest.fixture()
def audit(spark, tmp_path):
    def make(*texts, start="2026-03-03", end="2026-03-06", zone="UTC", **more):
        paths = []
        for k, text in enumerate(texts):
            path = tmp_path / f"c{next(number)}.ics"
            path.write_bytes(text if isinstance(text, bytes) else text.encode())
            paths.append(str(path))
        return Audit(spark, paths, start, end, zone, **more)

    return make


def utc(text):
    return int(datetime.datetime.strptime(text, "%Y-%m-%dT%H:%MZ").replace(tzinfo=datetime.timezone.utc).timestamp())


def starts(a):
    return sorted(r.s for r in a.occurrences.where("not all_day").collect())


def codes(a):
    return sorted(r.code for r in a.issues.collect())


@pytest.mark.parametrize("seed", [1, 3, 16])
def test_generated_calendars_equal_a_count_of_minutes(audit, seed):
    """Four days over the end of summer time: single events, series with exclusions and overrides, all-day and hidden ones."""
    x = Sample(seed, entries=24)
    a = audit(x.text, start="2025-10-24", end="2025-10-28", zone="Europe/Berlin")
    assert a.complete and len(x.times) > 8
    held, dates = minutes(x.times), [d for d in x.dates if d]
    assert a.occupied_seconds() == 60 * len(held)
    shared = [60 * len(minutes([p]) & minutes([q])) for p, q in itertools.combinations(x.times, 2)]
    assert sorted(r.seconds for r in a.overlaps.collect()) == sorted(n for n in shared if n)
    assert sorted((r.cs, r.ce) for r in a.occurrences.where("not all_day and ce > cs").collect()) == sorted(x.times)
    assert a.occurrences.count() == len(x.times) + x.points + len(dates)
    assert a.cancellations.count() == x.cancelled
    days = [(seconds(f"2025-10-{d}"), seconds(f"2025-10-{d + 1}")) for d in range(24, 28)]
    daily = a.daily.orderBy("date").collect()
    assert [r.occupied_seconds for r in daily] == [60 * len(held & minutes([d])) for d in days]
    assert [r.day_seconds for r in daily] == [e - s for s, e in days] == [86_400, 86_400, 90_000, 86_400]
    assert [r.all_day_occurrences for r in daily] == [sum(str(r.date) in d for d in dates) for r in daily]


def test_spring_gap(audit):
    text = calendar(
        event("gap", f"{NY}20260307T023000", None, "RRULE:FREQ=DAILY;COUNT=4"),
        event("elapsed", f"{NY}20260307T230000", f"{NY}20260308T040000", "RRULE:FREQ=DAILY;COUNT=2"),
        event("dates", ";VALUE=DATE:20260307", ";VALUE=DATE:20260310"),
    )
    a = audit(text, start="2026-03-07", end="2026-03-12", zone="America/New_York")
    gap = [r.s for r in a.occurrences.where("uid = 'gap'").orderBy("s").collect()]
    assert gap == [utc("2026-03-07T07:30Z"), utc("2026-03-09T06:30Z"), utc("2026-03-10T06:30Z"), utc("2026-03-11T06:30Z")]
    assert [(r.s, r.e) for r in a.occurrences.where("uid = 'elapsed'").orderBy("s").collect()] == [(utc("2026-03-08T04:00Z"), utc("2026-03-08T08:00Z")), (utc("2026-03-09T03:00Z"), utc("2026-03-09T07:00Z"))]
    assert [r.all_day_occurrences for r in a.daily.orderBy("date").collect()] == [1, 1, 1, 0, 0]


def test_autumn_fold(audit):
    a = audit(calendar(event("fold", f"{NY}20261031T013000", None, "RRULE:FREQ=DAILY;COUNT=3"), event("explicit", "20261101T053000Z", "20261101T073000Z")), start="2026-10-31", end="2026-11-03", zone="America/New_York")
    assert starts(a) == sorted(map(utc, ("2026-10-31T05:30Z", "2026-11-01T05:30Z", "2026-11-02T06:30Z", "2026-11-01T05:30Z")))
    assert [r.day_seconds for r in a.daily.orderBy("date").collect()][1] == 90_000


def test_weekly_rules(audit):
    text = calendar(
        event("two", "20260301T090000Z", None, "RRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=SU,TU;WKST=SU;COUNT=5", "EXDATE:20260303T090000Z,20260315T090000Z"),
        event("until", "20260302T090000Z", None, "RRULE:FREQ=WEEKLY;UNTIL=20260316T090000Z"),
    )
    a = audit(text, start="2026-03-01", end="2026-04-01")
    day = lambda uid: [datetime.datetime.fromtimestamp(r.s, datetime.timezone.utc).day for r in a.occurrences.where(f"uid = '{uid}'").orderBy("s").collect()]
    assert day("two") == [1, 17, 29]
    assert day("until") == [2, 9, 16]


def test_clipping_and_points(audit):
    text = calendar(event("long", "20260228T230000Z", "20260303T020000Z"), event("x", "20260301T010000Z", "20260301T020000Z"), event("y", "20260301T013000Z", "20260301T030000Z"), event("before", "20260228T220000Z", "20260301T000000Z"), event("after", "20260302T000000Z", "20260302T010000Z"))
    a = audit(text, start="2026-03-01", end="2026-03-02")
    assert (a.occupied_seconds(), a.overlaps.count(), a.occurrences.count()) == (86_400, 3, 3)
    b = audit(calendar(event("night", "20260301T233000Z", "20260302T013000Z"), event("noon", "20260302T120000Z")), start="2026-03-01", end="2026-03-03")
    assert [(r.occupied_seconds, r.timed_occurrences) for r in b.daily.orderBy("date").collect()] == [(1800, 1), (5400, 2)]


def test_copies_and_conflicting_snapshots(audit):
    one = event("u", "20260303T100000Z", "20260303T110000Z", summary="A")
    a = audit(calendar(one), calendar(one))
    assert a.complete and a.occurrences.count() == 1
    b = audit(calendar(one), calendar(event("u", "20260303T100000Z", "20260303T110000Z", summary="B")))
    assert codes(b) == ["conflicting_snapshots"] * 2 and b.occurrences.count() == 0


BASE = ("20260303T100000Z", "20260303T110000Z")
NOT_UNDERSTOOD = [
    (*BASE, "RRULE:FREQ=MONTHLY"), (*BASE, "RRULE:FREQ=DAILY;COUNT=2;UNTIL=20260305T000000Z"), (*BASE, "RRULE:FREQ=DAILY;BYDAY=TU"), (*BASE, "RRULE:FREQ=WEEKLY;BYDAY=MO"), (*BASE, "RRULE:FREQ=DAILY;UNTIL=20260301T000000Z"),
    (*BASE, "RRULE:FREQ=DAILY;UNTIL=20260309T000000"), (*BASE, "RDATE:20260304T100000Z"), (*BASE, "DURATION:PT1H"), (*BASE, "STATUS:MAYBE"), (*BASE, "TRANSP:GLASS"), (*BASE, "EXDATE;VALUE=DATE:20260303"),
    ("20260303T100000Z", "20260303T100000Z"), (";TZID=Nowhere/Land:20260303T100000",), (";TZID=UTC:20260303T100000Z",), (";VALUE=DATE:20260303T100000",), ("20261303T100000Z",), ("20260303T100000Z", "20260303T110000"),
    (";VALUE=DATE:20260303", "20260304T000000Z"), (None,), (*BASE, "DTSTART:20260303T120000Z"), (*BASE, "RRULE:FREQ=DAILY", "RRULE:FREQ=DAILY"),
]


def test_what_is_not_understood_excludes_its_family_only(audit):
    a = audit(calendar(*(event(f"u{k}", *v) for k, v in enumerate(NOT_UNDERSTOOD)), event("text", *BASE, "SUMMARY:x", "SUMMARY:y"), event("other", "20260304T100000Z", "20260304T110000Z")))
    assert not a.complete
    assert codes(a) == ["invalid_identity"] + ["unsupported_event"] * (len(NOT_UNDERSTOOD) + 1)
    assert [r.uid for r in a.occurrences.collect()] == ["other"]


SERIES = ("20260301T100000Z", "20260301T110000Z", "RRULE:FREQ=DAILY;COUNT=10")
RID = "RECURRENCE-ID:20260303T100000Z"
FAMILIES = [
    ([SERIES, ("20260303T120000Z", None, "RECURRENCE-ID;RANGE=THISANDFUTURE:20260303T100000Z")], "unsupported_range"),
    ([SERIES, ("20260303T120000Z", None, "RECURRENCE-ID;VALUE=DATE:20260303")], "incompatible_identity"),
    ([SERIES, ("20260303T120000Z", None, "RECURRENCE-ID:20260303T110000Z")], "orphan_override"),
    ([SERIES, ("20260303T120000Z", None, RID), ("20260303T130000Z", None, RID)], "conflicting_overrides"),
    ([SERIES, ("20260303T120000Z", None, RID, "RRULE:FREQ=DAILY")], "unsupported_override"),
    ([SERIES, (None, None, RID)], "missing_override_start"),
    ([SERIES, (";VALUE=DATE:20260303", None, RID)], "incompatible_timing"),
    ([SERIES, ("20260303T120000Z", "20260303T110000Z", RID)], "unsupported_event"),
    ([("20260303T120000Z", None, RID)], "orphan_override"),
    ([SERIES, ("20260302T100000Z", None, "RRULE:FREQ=DAILY")], "conflicting_masters"),
    ([("20260303T100000Z",), ("20260303T120000Z", None, RID)], "nonrecurring_master"),
    ([("20260301T100000Z", None, "RRULE:FREQ=DAILY", "STATUS:CANCELLED"), ("20260303T120000Z", None, RID)], "cancelled_master_with_overrides"),
    ([("20260301T100000Z", None, "RRULE:FREQ=DAILY", "EXDATE:20260303T100000Z"), ("20260303T120000Z", None, RID)], "exdate_override_collision"),
]


def test_family_codes(audit):
    a = audit(calendar(*(event(f"s{k}", *m) for k, (members, _) in enumerate(FAMILIES) for m in members), event("other", "20260304T100000Z", "20260304T110000Z")))
    assert {r.uid: r.code for r in a.errors.collect()} == {f"s{k}": code for k, (_, code) in enumerate(FAMILIES)}
    assert codes(a) == sorted(code for members, code in FAMILIES for _ in members)
    assert [r.uid for r in a.occurrences.collect()] == ["other"]


def test_unreadable_files(audit):
    bad = [
        b"\xff\xfe", calendar().replace("VERSION:2.0", "VERSION:1.0"), calendar(head=("METHOD:REQUEST",)), calendar(head=("CALSCALE:JULIAN",)), "BEGIN:VCALENDAR\r\nVERSION:2.0\r\n", calendar() + calendar(), " folded\r\n" + calendar(),
        calendar(["BEGIN:VEVENT", "BEGIN:VTODO", "END:VTODO", "END:VEVENT"]), calendar(["no colon"]), "",
    ]
    a = audit(*bad, calendar(event("other", "20260304T100000Z", "20260304T110000Z")))
    assert codes(a) == ["invalid_calendar"] * len(bad) and a.occurrences.count() == 1


def test_other_components_warn(audit):
    a = audit(calendar(["BEGIN:VTODO", "END:VTODO"], ["BEGIN:VTIMEZONE", "BEGIN:STANDARD", "END:STANDARD", "END:VTIMEZONE"], event("u", "20260303T100000Z", None, "BEGIN:VALARM", "TRIGGER:-PT5M", "END:VALARM")))
    assert codes(a) == ["unsupported_component"] * 2 and a.occurrences.count() == 1


def test_floating_assertion(audit):
    text = calendar(event("u", "20260303T233000", "20260304T003000"), head=("X-WR-TIMEZONE:Europe/Brussels",))
    assert not audit(text).complete
    a = audit(text, floating_timezone="Europe/Brussels")
    assert a.complete and starts(a) == [utc("2026-03-03T22:30Z")]


def test_folded_lines_and_escapes(audit):
    text = calendar(event("u", "20260303T100000Z", None, summary="one\\, two\\nthree \\\\n")).replace("SUMMARY:one", "SUMMARY:\r\n one").replace("PRODID", "\r\nPRODID")
    assert [r.summary for r in audit(text).records.collect()] == ["one, two\nthree \\n"]


def test_settings_and_limits(audit):
    for more in ({"start": "2026-03-06"}, {"end": "2026-07-01"}, {"zone": "Nowhere/Land"}, {"start": "06.03.2026"}, {"start": "2026-3-3"}):
        with pytest.raises(InputError):
            audit(calendar(), **more)
    with pytest.raises(LimitError):
        audit(calendar(), calendar(), limits=Limits(files=1))


def test_names_are_literal_and_lines_have_a_limit(spark, tmp_path):
    text = calendar(event("u", "20260303T100000Z", "20260303T110000Z"))
    for name in ("team[1].ics", "a*b?.ics", "{x,y} z.ics"):
        (tmp_path / name).write_text(text, newline="")
    paths = [str(tmp_path / name) for name in ("team[1].ics", "a*b?.ics", "{x,y} z.ics", "team[1].ics")]
    a = Audit(spark, paths, "2026-03-03", "2026-03-04", "UTC")
    assert a.complete and a.occurrences.count() == 1 and [r.name for r in a.sources.orderBy("source_ord").collect()] == [p.rsplit("/", 1)[1] for p in paths]
    folded = "SUMMARY:" + "\r\n ".join(["x" * 60] * 5)
    (tmp_path / "long.ics").write_text(calendar(event("u", "20260303T100000Z", None, folded)), newline="")
    assert Audit(spark, [str(tmp_path / "long.ics")], "2026-03-03", "2026-03-04", "UTC", limits=Limits(line_bytes=308)).complete
    with pytest.raises(LimitError):
        assert Audit(spark, [str(tmp_path / "long.ics")], "2026-03-03", "2026-03-04", "UTC", limits=Limits(line_bytes=307)).complete


def test_large_files_are_parsed_in_two_levels(spark, tmp_path):
    """The same events, whether a file is one window partition or its lines fill many blocks."""
    from spanloom.sources import ics

    paths = []
    for seed in (21, 22):
        paths.append(str(tmp_path / f"{seed}.ics"))
        (tmp_path / f"{seed}.ics").write_text(Sample(seed, entries=40).text, newline="")
    (tmp_path / "bad.ics").write_text("BEGIN:VCALENDAR\r\nVERSION:2.0\r\nEND:VEVENT\r\n", newline="")
    paths.append(str(tmp_path / "bad.ics"))
    both = []
    for wide in (False, True):
        files, events = ics.read(spark, paths, "Europe/Berlin", True, wide)
        both.append((sorted(map(str, files.collect())), sorted(map(str, events.collect()))))
    assert both[0] == both[1] and len(both[0][1]) > 60
