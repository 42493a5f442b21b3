"""Instants, civil times and zones as columns.

An instant is a TIMESTAMP_NTZ in UTC or its whole seconds since 1970 (BIGINT); a civil time is a
TIMESTAMP_NTZ with a zone name beside it. The session zone is UTC (:func:`spanloom.session.prepare`).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
_WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seconds(instant: Column | str) -> Column:
    """Whole seconds since 1970 of an instant."""
    return F.unix_timestamp(F.date_trunc("second", _col(instant).cast("timestamp")))


def instant(secs: Column | str) -> Column:
    """The instant of so many seconds since 1970."""
    return F.timestamp_seconds(_col(secs)).cast("timestamp_ntz")


def to_utc(local: Column | str, zone: Column | str) -> Column:
    """A civil time's instant. In a gap the offset before it holds, in a fold the first of both instants."""
    return F.to_utc_timestamp(_col(local).cast("timestamp"), zone if isinstance(zone, Column) else F.lit(zone)).cast("timestamp_ntz")


def from_utc(utc: Column | str, zone: Column | str) -> Column:
    return F.from_utc_timestamp(_col(utc).cast("timestamp"), zone if isinstance(zone, Column) else F.lit(zone)).cast("timestamp_ntz")


def exists(local: Column | str, zone: Column | str) -> Column:
    """False for a civil time that a zone skips."""
    return from_utc(to_utc(local, zone), zone) == _col(local)


def boundaries(local: Column | str, zone: Column | str) -> Column:
    """All instants that a zone shows as this civil time: none in a gap, two in a fold.

    Offsets a day before and after give the candidates; those that convert back stay.
    """
    local = _col(local)
    offsets = [seconds(local + F.expr(f"INTERVAL '{d}' DAY")) - seconds(to_utc(local + F.expr(f"INTERVAL '{d}' DAY"), zone)) for d in (-1, 1)]
    candidates = F.array_sort(F.array_distinct(F.array(*(seconds(local) - off for off in offsets))))
    return F.filter(candidates, lambda s: from_utc(instant(s), zone) == local)


def strict(local: Column | str, zone: Column | str) -> tuple[Column, Column]:
    """(seconds, error) of a civil time that has to stand for exactly one instant."""
    found = boundaries(local, zone)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0))), F.when(F.size(found) == 0, F.lit("Nonexistent")).when(F.size(found) > 1, F.lit("Ambiguous"))


def iso(utc: Column | str) -> Column:
    return F.date_format(_col(utc).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def basic(utc: Column | str) -> Column:
    """The basic form that calendars use."""
    return F.date_format(_col(utc).cast("timestamp"), "yyyyMMdd'T'HHmmss'Z'")


def offset_text(local_secs: Column, utc_secs: Column) -> Column:
    """+HH:MM of a local reading."""
    minutes = F.floor((local_secs - utc_secs) / 60)
    return F.format_string("%s%02d:%02d", F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("int"), (F.abs(minutes) % 60).cast("int"))


def local_text(utc: Column | str, zone: Column | str) -> Column:
    """ISO text of an instant on a zone's clock, with the offset."""
    local = from_utc(utc, zone)
    return F.concat(F.date_format(local.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), offset_text(seconds(local), seconds(utc)))


def weekday(d: Column | str) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.weekday(_col(d))


def weekday_number(code: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, _WEEKDAYS)), code) - 1


def clock_minutes(text: Column | str) -> Column:
    """Minutes of HH:MM, up to 24:00; null for other text."""
    text = _col(text)
    h, m = F.substring(text, 1, 2).try_cast("int"), F.substring(text, 4, 2).try_cast("int")
    fits = F.regexp_like(text, F.lit("^[0-9]{2}:[0-9]{2}$")) & (m < 60) & ((h < 24) | ((h == 24) & (m == 0)))
    return F.when(fits, h * 60 + m)


def decode_time(raw: Column | str, tzid: Column | str) -> tuple[Column, Column]:
    """(kind, value) of a calendar time: date, utc, zoned or floating; kind is null for what isn't a valid time.

    A DATE has no zone, and neither has a time that ends in Z.
    """
    raw, tzid = _col(raw), _col(tzid)
    day, time = F.lit("^[0-9]{8}$"), F.lit("^[0-9]{8}T[0-9]{6}Z?$")
    date = F.when(F.regexp_like(raw, day), F.try_to_timestamp(raw, F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    at = F.when(F.regexp_like(raw, time), F.try_to_timestamp(F.rtrim(raw, F.lit("Z")), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz"))
    value = F.coalesce(date, at)
    utc = raw.endswith("Z")
    kind = F.when(date.isNotNull() & tzid.isNull(), "date").when(at.isNotNull() & utc & tzid.isNull(), "utc").when(at.isNotNull() & ~utc, F.when(tzid.isNotNull(), "zoned").otherwise("floating"))
    return kind, F.when(kind.isNotNull(), value)


#: Units of a duration in seconds, and the orders they may stand in: weeks alone, or days, then times behind a T.
_UNITS = {"W": 7 * DAY, "D": DAY, "H": 3600, "M": 60, "S": 1}
_CLOCK = ["T" + "".join(c) for n in (1, 2, 3) for c in combinations("HMS", n)]
_FORMS = ["PW", "PD", *(head + c for head in ("P", "PD") for c in _CLOCK)]


def duration(raw: Column | str) -> Column:
    """Seconds of a period's duration (weeks alone, or days and times), null unless over 0 and up to 90 days.

    Read as pairs of a number of up to nine digits and a unit, whose units in a row have to be a known form.
    """
    body = F.regexp_replace(_col(raw), r"^\+", "")
    pairs = F.regexp_extract_all(body, F.lit("[0-9]{1,9}[WDHMS]"), F.lit(0))
    number = lambda p: F.substr(p, F.lit(1), F.length(p) - 1).cast("bigint")
    factor = lambda p: F.element_at(F.create_map(*(F.lit(x) for kv in _UNITS.items() for x in kv)), F.right(p, F.lit(1)))
    total = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda t, p: t + number(p) * factor(p))
    form = F.regexp_replace(body, "[0-9]{1,9}([WDHMS])", "$1")
    return F.when(form.isin(_FORMS) & ~F.regexp_like(body, F.lit("[0-9]{10}")) & (F.size(pairs) == F.length(F.translate(form, "PT", ""))) & (total > 0) & (total <= 90 * DAY), total)


def hours(secs: Column | str) -> Column:
    return F.format_string("%.2f h", _col(secs) / F.lit(3600.0))
