"""Small calendars for tests, written from rows of properties."""

import datetime
import random
import zoneinfo


def event(uid, start=None, end=None, *more, summary=None):
    lines = ["BEGIN:VEVENT", f"UID:{uid}"]
    if summary is not None:
        lines.append(f"SUMMARY:{summary}")
    for name, value in (("DTSTART", start), ("DTEND", end)):
        if value is not None:
            lines.append(f"{name}{value}" if value[0] in ";:" else f"{name}:{value}")
    return [*lines, *more, "END:VEVENT"]


def calendar(*events, head=()):
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//Tests//EN", *head]
    for e in events:
        lines += e
    return "\r\n".join([*lines, "END:VCALENDAR", ""])


NY = ";TZID=America/New_York:"
BERLIN = ";TZID=Europe/Berlin:"


def seconds(local, zone="Europe/Berlin", fold=0):
    """UTC seconds of a civil time written like 2025-10-24 07:15."""
    return int(datetime.datetime.fromisoformat(local).replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=fold).timestamp())


class Sample:
    """A made-up calendar of one zone and what it occupies from day ``first`` for ``days`` days, worked out day by day.

    ``times`` are the occurrences with length (seconds), cut to the window; ``points`` those without; ``dates`` the civil dates of
    each all-day occurrence in the window; ``cancelled`` the cancelled instances.
    """

    def __init__(self, seed, first="2025-10-24", days=4, zone="Europe/Berlin", entries=14):
        self.rng, self.zone, self.tz = random.Random(seed), zone, zoneinfo.ZoneInfo(zone)
        self.first, self.days = datetime.date.fromisoformat(first), days
        self.lo, self.hi = (self._at(datetime.datetime.combine(self.first + datetime.timedelta(d), datetime.time())) for d in (0, days))
        self.times, self.dates, self.points, self.cancelled, events = [], [], 0, 0, []
        for k in range(entries):
            events += getattr(self, "_" + self.rng.choice(("single", "single", "daily", "weekly", "whole", "hidden")))(f"u{seed}-{k}")
        self.text = calendar(*events)

    def _at(self, local):
        return int(local.replace(tzinfo=self.tz).timestamp())

    def _local(self, spread=2):
        """A time off the hours at which clocks change."""
        day = self.first + datetime.timedelta(self.rng.randrange(-spread, self.days + spread))
        return datetime.datetime.combine(day, datetime.time(self.rng.randrange(4, 23), self.rng.choice((0, 5, 20, 45))))

    def _text(self, local):
        """A time property's parameters and value, in the zone, floating or in UTC."""
        kind = self.rng.choice(("zoned", "floating", "utc"))
        if kind == "utc":
            return datetime.datetime.fromtimestamp(self._at(local), datetime.timezone.utc).strftime(":%Y%m%dT%H%M%SZ")
        return (f";TZID={self.zone}:" if kind == "zoned" else ":") + local.strftime("%Y%m%dT%H%M%S")

    def _zoned(self, local):
        return f";TZID={self.zone}:" + local.strftime("%Y%m%dT%H%M%S")

    def _occupy(self, s, e):
        if s == e:
            self.points += self.lo <= s < self.hi
        elif max(s, self.lo) < min(e, self.hi):
            self.times.append((max(s, self.lo), min(e, self.hi)))

    def _single(self, uid):
        local, length = self._local(), datetime.timedelta(minutes=self.rng.choice((0, 5, 40, 90, 600, 1500)))
        start = self._text(local)
        self._occupy(self._at(local), self._at(local + length))
        if not length:
            return [event(uid, start)]
        return [event(uid, start, self._zoned(local + length) if start[0] == ";" else ":" + (local + length).strftime("%Y%m%dT%H%M%S") if start[-1] != "Z" else datetime.datetime.fromtimestamp(self._at(local + length), datetime.timezone.utc).strftime(":%Y%m%dT%H%M%SZ"), "COMMENT:not for others", summary="<b onclick=x()>Offer</b> \\; more")]

    def _series(self, uid, step, rule):
        """Some instances of a series are left out, moved, cancelled or made transparent."""
        local, length = self._local(9), datetime.timedelta(minutes=self.rng.choice((15, 60, 130)))
        count, out, more = self.rng.randint(1, 12), [], []
        for k in range(count):
            day = local + k * step
            fate = self.rng.choice(("stays",) * 5 + ("excluded", "moved", "cancelled", "transparent"))
            identity = "RECURRENCE-ID" + self._zoned(day)
            if fate == "excluded":
                more.append("EXDATE" + self._zoned(day))
            elif fate == "moved":
                new = self._local()
                out.append(event(uid, self._zoned(new), None, identity, summary="Moved"))
                self._occupy(self._at(new), self._at(new) + int(length.total_seconds()))
            elif fate == "cancelled":
                out.append(event(uid, None, None, identity, "STATUS:CANCELLED"))
                self.cancelled += 1
            elif fate == "transparent":
                out.append(event(uid, self._zoned(day), None, identity, "TRANSP:TRANSPARENT"))
            else:
                self._occupy(self._at(day), self._at(day) + int(length.total_seconds()))
        return [event(uid, self._zoned(local), self._zoned(local + length), f"RRULE:FREQ={rule};COUNT={count}", *more), *out]

    def _daily(self, uid):
        n = self.rng.randint(1, 3)
        return self._series(uid, datetime.timedelta(n), f"DAILY;INTERVAL={n}")

    def _weekly(self, uid):
        return self._series(uid, datetime.timedelta(7), "WEEKLY")

    def _whole(self, uid):
        day, n = self._local().date(), self.rng.randint(1, 3)
        self.dates.append([str(d) for k in range(n) for d in (day + datetime.timedelta(k),) if 0 <= (d - self.first).days < self.days])
        return [event(uid, day.strftime(";VALUE=DATE:%Y%m%d"), (day + datetime.timedelta(n)).strftime(";VALUE=DATE:%Y%m%d"))]

    def _hidden(self, uid):
        """What occupies nothing."""
        if self.rng.random() < 0.5:
            return [event(uid, None, None, "STATUS:CANCELLED")]
        local = self._local()
        return [event(uid, self._zoned(local), self._zoned(local + datetime.timedelta(hours=3)), "TRANSP:TRANSPARENT")]


def minutes(spans):
    """Every minute that a span holds."""
    return {m for s, e in spans for m in range(s // 60, e // 60)}


def runs(cells):
    """Lengths in seconds of the runs of consecutive minutes."""
    out, last = [], None
    for m in sorted(cells):
        if last is None or m > last + 1:
            out.append(0)
        out[-1] += 60
        last = m
    return out
