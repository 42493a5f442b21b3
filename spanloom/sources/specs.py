"""JSON specifications: working windows (versions 1 and 2) and the manifest of shared windows. They are small and read on the driver."""

from __future__ import annotations

import datetime
import hashlib
import json
import os
import re
import stat
import zoneinfo

from ..errors import InputError

WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
SPEC_BYTES, MANIFEST_BYTES = 16_384, 256 << 10
_CLOCK = re.compile("(?:[01][0-9]|2[0-3]):[0-5][0-9]|24:00")
_COMMON = ("start", "end", "timezone", "minimum_seconds", "all_day")


def need(ok: bool, message: str) -> None:
    if not ok:
        raise InputError(message)


def _opened(path: str):
    """A regular file, open for reading; pipes and devices aren't waited for."""
    try:
        f = open(os.open(path, os.O_RDONLY | getattr(os, "O_NONBLOCK", 0)), "rb")
    except OSError:
        raise InputError("the file can't be read") from None
    if not stat.S_ISREG(os.fstat(f.fileno()).st_mode):
        f.close()
        raise InputError("not a regular file")
    return f


def regular(path: str) -> None:
    """Raises for what isn't a readable regular file; nothing is read."""
    _opened(path).close()


def read_small(path: str, limit: int) -> bytes:
    """A regular file of at most ``limit`` bytes."""
    with _opened(path) as f:
        raw = f.read(limit + 1)
    need(len(raw) <= limit, f"the file has over {limit} bytes")
    return raw


def parse_json(raw: bytes) -> dict:
    """A JSON object in which no key occurs twice."""

    def unique(pairs: list) -> dict:
        need(len({k for k, _ in pairs}) == len(pairs), "a key occurs twice")
        return dict(pairs)

    try:
        out = json.loads(raw.decode(), object_pairs_hook=unique)
    except (ValueError, RecursionError):
        raise InputError("not a UTF-8 JSON object") from None
    need(isinstance(out, dict), "not a JSON object")
    return out


def exact(value: object, keys: tuple[str, ...], what: str) -> dict:
    need(isinstance(value, dict) and set(value) == set(keys), f"{what} has exactly the keys {', '.join(keys)}")
    return value


def _date(text: object) -> datetime.date:
    need(isinstance(text, str) and re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", text) is not None, "dates are YYYY-MM-DD")
    try:
        return datetime.date.fromisoformat(text)
    except ValueError:
        raise InputError("no such date") from None


def _zone(name: object) -> str:
    need(isinstance(name, str) and name in zoneinfo.available_timezones(), "unknown timezone")
    return name


def _minutes(text: object, end: bool) -> int:
    need(isinstance(text, str) and _CLOCK.fullmatch(text) is not None and (end or text != "24:00"), "clocks are HH:MM, an end up to 24:00")
    return int(text[:2]) * 60 + int(text[3:])


def _windows(value: object, overnight: bool = False) -> list[list[str]]:
    need(isinstance(value, list) and len(value) <= 16 and all(isinstance(w, list) and len(w) == 2 for w in value), "windows are at most 16 pairs of clocks")
    spans = [(_minutes(a, False), _minutes(b, True)) for a, b in value]
    need(all(a != b if overnight else a < b for a, b in spans), "a window ends after it begins")
    flat = sorted((a, b if a < b else b + 1440) for a, b in spans)
    need(all(x[1] <= y[0] for x, y in zip(flat, flat[1:], strict=False)), "windows of a day don't overlap")
    return sorted(value)


def _common(spec: dict, max_days: int) -> None:
    first, last = _date(spec["start"]), _date(spec["end"])
    need(1 <= (last - first).days <= min(90, max_days), f"the range has 1 to {min(90, max_days)} days")
    _zone(spec["timezone"])
    need(type(spec["minimum_seconds"]) is int and 1 <= spec["minimum_seconds"] <= 90 * 86_400, "minimum_seconds is a whole number from 1 to 7776000")
    need(spec["all_day"] in ("block", "ignore"), "all_day is block or ignore")


def validate_spec(spec: dict, max_days: int = 90) -> dict:
    """A checked working-window specification, with weekdays and exceptions in order."""
    need(type(max_days) is int and 1 <= max_days <= 90, "max_days is from 1 to 90")
    if isinstance(spec, dict) and type(spec.get("version")) is int and spec["version"] == 2:
        exact(spec, ("version", *_COMMON, "weekly", "exceptions"), "the schedule")
        _common(spec, max_days)
        need(isinstance(spec["weekly"], dict) and set(spec["weekly"]) <= set(WEEKDAYS), "weekly maps weekdays to windows")
        weekly = {d: _windows(spec["weekly"][d]) for d in WEEKDAYS if d in spec["weekly"]}
        need(isinstance(spec["exceptions"], list) and len(spec["exceptions"]) <= 90, "exceptions are at most 90")
        exceptions = [exact(x, ("date", "windows"), "an exception") for x in spec["exceptions"]]
        exceptions = [{"date": str(_date(x["date"])), "windows": _windows(x["windows"])} for x in exceptions]
        dates = [x["date"] for x in exceptions]
        need(len(set(dates)) == len(dates), "an exception's date occurs twice")
        need(all(spec["start"] <= d < spec["end"] for d in dates), "exceptions lie inside the range")
        need(sum(map(len, weekly.values())) + sum(len(x["windows"]) for x in exceptions) <= 256, "at most 256 windows are declared")
        return spec | {"weekly": weekly, "exceptions": sorted(exceptions, key=lambda x: x["date"])}
    exact(spec, ("version", *_COMMON, "weekdays", "work_start", "work_end"), "the specification")
    need(type(spec["version"]) is int and spec["version"] == 1, "the version is 1 or 2")
    _common(spec, max_days)
    days = spec["weekdays"]
    need(isinstance(days, list) and bool(days) and all(d in WEEKDAYS for d in days if isinstance(d, str)) and all(isinstance(d, str) for d in days) and len(set(days)) == len(days), "weekdays are different names from MO to SU")
    need(_minutes(spec["work_start"], False) < _minutes(spec["work_end"], True), "work_end is later than work_start")
    return spec | {"weekdays": sorted(days, key=WEEKDAYS.index)}


def load_spec(path: str, max_days: int = 90) -> tuple[dict, dict]:
    """(specification, fingerprint of its file)."""
    raw = read_small(path, SPEC_BYTES)
    return validate_spec(parse_json(raw), max_days), fingerprint(path, raw)


def fingerprint(path: str, raw: bytes) -> dict:
    return {"name": os.path.basename(path), "bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest()}


def _utc(text: object) -> int:
    need(isinstance(text, str) and re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z", text) is not None, "instants are like 2026-03-09T00:00:00Z")
    try:
        return int(datetime.datetime.strptime(text, "%Y-%m-%dT%H:%M:%S%z").timestamp())
    except ValueError:
        raise InputError("no such time") from None


def validate_manifest(m: dict) -> dict:
    """A checked manifest of participants, their shifts and sources."""
    exact(m, ("version", "start", "end", "duration_seconds", "participants"), "the manifest")
    need(type(m["version"]) is int and m["version"] == 1, "the version is 1")
    lo, hi = _utc(m["start"]), _utc(m["end"])
    need(0 < hi - lo <= 90 * 86_400, "the horizon is positive and at most 90 days")
    need(type(m["duration_seconds"]) is int and 1 <= m["duration_seconds"] <= 90 * 86_400, "duration_seconds is a whole number from 1 to 7776000")
    people = m["participants"]
    need(isinstance(people, list) and 1 <= len(people) <= 16, "there are 1 to 16 participants")
    out, files = [], 0
    for p in people:
        exact(p, ("alias", "timezone", "weekly", "sources"), "a participant")
        alias = p["alias"]
        need(isinstance(alias, str) and 0 < len(alias) <= 64 and alias.isprintable() and alias == alias.strip(), "an alias has 1 to 64 printable characters")
        _zone(p["timezone"])
        need(isinstance(p["weekly"], dict) and set(p["weekly"]) <= set(WEEKDAYS), "weekly maps weekdays to windows")
        need(isinstance(p["sources"], list) and len(p["sources"]) >= 1, "a participant has sources")
        for s in p["sources"]:
            exact(s, ("path", "complete_occupancy"), "a source")
            need(s["complete_occupancy"] is True, "complete_occupancy is asserted as true")
            need(isinstance(s["path"], str) and s["path"] != "" and not os.path.isabs(s["path"]) and ".." not in s["path"].split("/"), "paths are relative to the manifest")
        files += len(p["sources"])
        out.append(p | {"weekly": {d: _windows(p["weekly"][d], overnight=True) for d in WEEKDAYS if d in p["weekly"]}})
    need(files <= 32, "there are at most 32 files")
    need(len({p["alias"] for p in out}) == len(out), "aliases differ")
    return m | {"participants": out, "lo": lo, "hi": hi}
