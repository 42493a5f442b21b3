"""Free/busy calendars: merged busy periods, their lines, folding, and whole VFREEBUSY files."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LimitError
from ..functions import times
from ..operators import intervals as iv


class IncompleteExport(ValueError):
    """The sources weren't wholly understood, so busy time can't be vouched for."""


def periods(df: DataFrame, lo: int, hi: int, by: Sequence[str] = ()) -> DataFrame:
    """Minimal busy periods (by, s, e) within [lo, hi): only bounds leave, no names or ids; points occupy nothing."""
    return iv.islands(iv.clip(df, lo, hi).select(*by, "s", "e"), by)


def lines(merged: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, line_no, line): one FREEBUSY line for each period, numbered by its begin within its owner."""
    number = F.row_number().over(Window.partitionBy(*by).orderBy("s"))
    text = F.concat(F.lit("FREEBUSY;FBTYPE=BUSY:"), times.basic(times.instant("s")), F.lit("/"), times.basic(times.instant("e")))
    return merged.select(*by, number.alias("line_no"), text.alias("line"))


def _fold_ends(bytes_of: list[int]) -> list[int]:
    """Where, in characters, each part of a line ends whose characters have so many bytes: 75 bytes fit into the first and 74 into each further one."""
    ends, room = [], 75
    for k, n in enumerate(bytes_of):
        if n > room:
            ends.append(k)
            room = 74
        room -= n
    return [*ends, len(bytes_of)]


def fold_line(line: str) -> str:
    """A content line in parts of at most 75 octets, never cut inside a character; later parts begin with a space, which counts."""
    ends = _fold_ends([len(c.encode()) for c in line])
    return "\r\n ".join(line[a:b] for a, b in zip([0, *ends], ends, strict=False))


def fold(line: Column | str) -> Column:
    """:func:`fold_line` as a column, from built-in functions; null stays null.

    The line's bytes are looked at as Latin-1 characters: a part is the longest run that isn't
    followed by a byte inside a UTF-8 character.
    """
    raw = F.decode(F.encode(line, "UTF-8"), "ISO-8859-1")
    first = F.regexp_extract(raw, r"(?s)^.{1,75}(?![\x80-\xBF])", 0)
    further = F.regexp_extract_all(F.substr(raw, F.length(first) + 1), F.lit(r"(?s).{1,74}(?![\x80-\xBF])"), F.lit(0))
    folded = F.array_join(F.concat(F.array(first), further), "\r\n ")
    return F.decode(F.encode(folded, "ISO-8859-1"), "UTF-8")


def export_identity(uid: str | None = None, created_at: str | None = None) -> tuple[str, datetime.datetime]:
    """(urn:uuid UID, creation time): a canonical version-4 UUID and a time of whole seconds in UTC, new ones where none is given."""
    name = uid if uid is not None else str(uuid.uuid4())
    if not re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", name):
        raise ValueError("the UID is a lower-case version-4 UUID")
    if created_at is None:
        return f"urn:uuid:{name}", datetime.datetime.now(datetime.timezone.utc).replace(microsecond=0)
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z", created_at, re.ASCII):
        raise ValueError("the creation time is like 2026-01-31T12:00:00Z")
    return f"urn:uuid:{name}", datetime.datetime.strptime(created_at, "%Y-%m-%dT%H:%M:%S%z")


def calendar_bytes(merged: list[tuple[int, int]], lo: int, hi: int, uid: str, created: datetime.datetime, max_bytes: int | None = 8 << 20) -> bytes:
    """One owner's collected periods as a VFREEBUSY calendar. Periods have to be sorted, apart and inside [lo, hi)."""
    text = lambda t: datetime.datetime.fromtimestamp(t, datetime.timezone.utc).strftime("%Y%m%dT%H%M%SZ")
    edges = [t for period in merged for t in period]
    if edges and (edges[0] < lo or edges[-1] > hi) or any(a >= b for a, b in pairwise(edges)):
        raise ValueError("periods aren't sorted, apart and inside the horizon")
    body = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//Spanloom//Free Busy//EN", "METHOD:PUBLISH", "BEGIN:VFREEBUSY", f"UID:{uid}", f"DTSTAMP:{created:%Y%m%dT%H%M%SZ}", f"DTSTART:{text(lo)}", f"DTEND:{text(hi)}"]
    body += [f"FREEBUSY;FBTYPE=BUSY:{text(s)}/{text(e)}" for s, e in merged]
    raw = "".join(fold_line(x) + "\r\n" for x in [*body, "END:VFREEBUSY", "END:VCALENDAR"]).encode()
    if max_bytes is not None and len(raw) > max_bytes:
        raise LimitError(f"report_bytes limit exceeded ({max_bytes})")
    return raw
