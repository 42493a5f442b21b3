"""Reports of small, collected results: JSON and self-contained HTML, and a bundle folder that is never overwritten."""

from __future__ import annotations

import datetime
import html
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LimitError, undisturbed
from ..functions import times
from ..operators import scan
from ..plans.audit import Audit
from ..plans.availability import Availability, Shared
from ..tables import save


def iso(secs: int) -> str:
    return datetime.datetime.fromtimestamp(secs, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def _date(secs: int) -> str:
    return iso(secs)[:10]


def _span(r) -> dict:
    return {"start": iso(r.s), "end": iso(r.e), "seconds": r.e - r.s}


def occurrence_ids(audit: Audit) -> DataFrame:
    """(ord, recurrence_id, n, id): o1, o2 ... of an audit's occurrences: families in the order of their first record, instances in theirs.

    Numbers are dense over ranges of the order, so any number of occurrences has them without meeting in one task.
    """
    family = audit.records.where("uid is not null").groupBy("uid").agg(F.min("ord").alias("family_order"))
    rows = audit.occurrences.join(family, "uid").select("family_order", "ordinal", "ord", "recurrence_id")
    numbers = scan.numbered(rows, (), ["family_order", "ordinal"])
    return numbers.select("ord", "recurrence_id", "n", F.concat(F.lit("o"), F.col("n").cast("string")).alias("id"))


def occurrence_names(audit: Audit) -> dict[tuple[int, str], str]:
    """:func:`occurrence_ids` of a report that is collected."""
    return {(r.ord, r.recurrence_id): r.id for r in occurrence_ids(audit).collect()}


def audit_lists(audit: Audit, overlaps: bool = True) -> dict[str, DataFrame]:
    """The lists of an audit's report as tables, numbered like there; for audits of any size (:func:`spanloom.sinks.bundle.write`)."""
    text = lambda c: times.iso(times.instant(c))
    named = lambda letter, c="n": F.concat(F.lit(letter), F.col(c).cast("string"))
    events = save(scan.numbered(audit.records.select("ord", "uid", "summary", "source_ord", "no"), (), ["ord"]).withColumn("id", named("e")), "events")
    event = lambda c: events.select(F.col("ord").alias(c), F.col("id").alias(f"{c}_id"))
    names = save(occurrence_ids(audit), "names")
    whole = F.date_format(times.instant("s").cast("timestamp"), "yyyy-MM-dd"), F.date_format(times.instant("e").cast("timestamp"), "yyyy-MM-dd")
    found = audit.occurrences.join(names, ["ord", "recurrence_id"]).join(event("ord"), "ord").join(event("master"), "master").join(event("override"), "override", "left")
    span = [F.when(F.col("all_day"), w).otherwise(text(c)).alias(n) for w, c, n in zip(whole, ("s", "e"), ("start", "end"), strict=True)]
    out = {
        "sources": audit.sources.select(F.col("source_ord").alias("n"), named("s", "source_ord").alias("id"), "name", "sha256", "bytes"),
        "events": events.select("n", "id", F.coalesce("uid", F.lit("")).alias("uid"), F.coalesce("summary", F.lit("")).alias("summary"), named("s", "source_ord").alias("source"), F.col("no").alias("event")),
        "occurrences": found.select("n", "id", F.col("ord_id").alias("event"), F.col("master_id").alias("master"), F.col("override_id").alias("override"), "recurrence_id", "all_day", *span),
        "issues": scan.numbered(audit.issues, (), ["source_ord", "ord", "code", "message"]).join(event("ord"), "ord", "left").select("n", named("s", "source_ord").alias("source"), F.col("ord_id").alias("event"), "code", "message"),
        "daily": audit.daily.select(F.unix_date("date").alias("n"), F.col("date").cast("string").alias("date"), "day_seconds", "occupied_seconds", "timed_occurrences", "all_day_occurrences"),
    }
    if overlaps:
        key = lambda side: names.select(F.struct("ord", "recurrence_id").alias(side), F.col("id").alias(f"{side}_id"))
        pairs = audit.overlaps.join(key("left"), "left").join(key("right"), "right").select("s", "e", "seconds", "left_id", "right_id")
        out["overlaps"] = scan.numbered(pairs, (), ["s", "right_id", "left_id"]).select("n", named("p").alias("id"), F.col("left_id").alias("left"), F.col("right_id").alias("right"), text("s").alias("start"), text("e").alias("end"), "seconds")
    return out


def audit_report(audit: Audit, overlaps: bool = True) -> dict:
    """An audit as nested records, numbered s1, e1, o1 and p1 in the order of files, events, occurrences and overlaps.

    The audit counts its tables against its limits before they are collected here.
    """
    counters = audit.counters
    sources = audit.sources.orderBy("source_ord").collect()
    records = audit.records.select("ord", "no", "source_ord", "uid", "summary", "fingerprint").orderBy("ord").collect()
    event = {r.ord: f"e{k}" for k, r in enumerate(records, 1)}
    family: dict[str, int] = {}
    for r in records:
        family.setdefault(r.uid, len(family))
    found = sorted(audit.occurrences.collect(), key=lambda r: (family[r.uid], r.ordinal))
    name = occurrence_names(audit)
    copies: dict[tuple, list] = {}
    for r in records:
        copies.setdefault((r.uid, r.fingerprint), []).append(r)
    errors = {r.uid: r for r in audit.errors.collect()}
    role = {r.ord: "master" for r in audit.masters.select("ord").collect()} | {r.ord: "override" for r in audit.overrides.select("ord").collect()}
    state = {r.ord: "cancelled" if r.cancelled else "transparent" if r.transparent else "included" for df in (audit.masters, audit.overrides) for r in df.select("ord", "cancelled", "transparent").collect()}

    def disposition(r) -> str:
        if not r.uid:
            return "unsupported"
        if r.uid in errors:
            return "ambiguous" if errors[r.uid].coded else "unsupported"
        return state.get(r.ord, "duplicate")

    def described(r) -> dict:
        """A record; the first of equal ones names all their places, and the others name it."""
        same = copies[r.uid, r.fingerprint] if r.uid else [r]
        first = same[0].ord == r.ord
        out = {"id": event[r.ord], "uid": r.uid or "", "summary": r.summary or "", "sources": [{"source": f"s{x.source_ord}", "event": x.no} for x in (same if first else [r])], "disposition": disposition(r)}
        return out | ({"role": role[r.ord]} if r.ord in role else {}) | ({} if first else {"duplicate_of": event[same[0].ord]}) | basis.get(r.ord, {})

    basis = {r.ord: {k: v for k, v in (("time_basis", r.kind), ("timezone", r.zone if r.kind in ("zoned", "floating") else None)) if v} for r in audit.records.select("ord", "start.kind", "start.zone").collect()}
    for r in audit.overrides.select("ord", "inherited").collect():
        basis[r.ord] = basis.get(r.ord, {}) | {"inherited": r.inherited}
    events = [described(r) for r in records]
    issues = [{k: v for k, v in (("source", r.source_ord and f"s{r.source_ord}"), ("event", r.ord and event[r.ord]), ("code", r.code), ("message", r.message)) if v} for r in sorted(audit.issues.collect(), key=lambda r: (r.ord is not None and r.code not in ("invalid_identity",), r.source_ord or 0, r.ord or 0))]
    when = lambda r, s: _date(s) if r.all_day else iso(s)
    occurrences = [{"id": name[r.ord, r.recurrence_id], "event": event[r.ord], "master": event[r.master], "override": r.override and event[r.override], "recurrence_id": r.recurrence_id, "all_day": r.all_day, "start": when(r, r.s), "end": when(r, r.e), "clipped_start": when(r, r.cs), "clipped_end": when(r, r.ce)} for r in found]
    out = {
        "schema_version": 2 if overlaps else 1, "window": {"start": str(audit.first), "end": str(audit.last), "timezone": audit.zone, "start_utc": iso(audit.lo), "end_utc": iso(audit.hi)}, "complete": not issues, "issues": issues, "counters": counters,
        "sources": [{"id": f"s{r.source_ord}", "name": r.name, "sha256": r.sha256, "bytes": r.bytes} for r in sources], "events": events, "occurrences": occurrences,
        "cancellations": [{"master": event[r.master], "override": event[r.override], "recurrence_id": r.recurrence_id, "reason": "STATUS:CANCELLED"} for r in sorted(audit.cancellations.collect(), key=lambda r: (family[r.uid], r.ordinal))],
        "daily": [r.asDict() | {"date": str(r.date)} for r in audit.daily.orderBy("date").collect()], "occupied_seconds": audit.occupied_seconds(),
    }
    if overlaps:
        pairs = audit.overlaps.collect()
        out["counters"] = counters | {"pairs": len(pairs)}
        key = lambda i: name[i.ord, i.recurrence_id]
        out["overlaps"] = [{"id": f"p{k}", "left": key(r.left), "right": key(r.right)} | _span(r) for k, r in enumerate(sorted(pairs, key=lambda r: (r.s, key(r.right), key(r.left))), 1)]
    else:
        out["report_type"] = "occurrences"
    if audit.floating:
        out["floating_timezone"] = audit.floating
    return out


def availability_report(a: Availability, overlaps: bool = False) -> dict:
    """Windows w1, gaps g1 and, of a version-2 schedule, days; totals that aren't known are null."""
    windows = {(r.window.date, r.window.s): k for k, r in enumerate(a.windows.orderBy("s").collect(), 1)}
    key = lambda w: f"w{windows[w.date, w.s]}"
    name = occurrence_names(a.audit)
    # ids are texts and ordered as such: o10 stands before o2
    named = lambda ids: sorted(name[i.ord, i.recurrence_id] for i in ids)
    found = a.candidates().orderBy("s").collect()
    out = {
        "report_type": "availability", "schema_version": a.spec["version"] + (1 if a.spec["version"] == 2 else not overlaps), "spec": a.spec, "complete": a.complete, "audit": audit_report(a.audit, overlaps),
        "windows": [{"id": key(r.window), "date": str(r.date)} | _span(r) for r in a.windows.orderBy("s").collect()],
        "busy": [{"window": key(r.window), "members": named(r.members), "starting": named(r.starting), "ending": named(r.ending)} | _span(r) for r in a.busy().orderBy("s").collect()],
        "candidates": [{"id": f"g{k}", "window": key(r.window), "date": str(r.date), "before": named(r.before), "after": named(r.after)} | _span(r) for k, r in enumerate(found, 1)],
        "candidate_seconds": sum(r.seconds for r in found) if a.complete else None,
    }
    if a.spec["version"] == 2:
        days = a.days().orderBy("date").collect()
        out["days"] = [r.asDict() | {"id": f"d{r.date}", "date": str(r.date)} for r in days]
        for total in ("working_seconds", "observed_occupied_seconds", "occupied_seconds", "free_seconds"):
            values = [getattr(r, total) for r in days]
            out[total] = None if None in values else sum(values)
    return out


def shared_report(s: Shared) -> dict:
    local = {}
    for r in s.local().collect():
        local.setdefault(r.s, {})[r.pid] = {"participant": f"p{r.pid}", "start": r.start, "end": r.end, "latest_start": r.latest}
    people = [{"id": f"p{k}", "alias": p["alias"], "timezone": p["timezone"], "weekly": p["weekly"]} for k, p in enumerate(s.manifest["participants"], 1)]
    for r in s.sets.orderBy("pid", "s").collect():
        people[r.pid - 1].setdefault(r.kind, []).append(_span(r))
    for p in people:
        p["coverage_complete"] = not p.get("coverage_gaps")
    windows = s.windows.orderBy("s").collect()
    return {
        "schema_version": 1, "report_type": "shared-windows", "complete": True, "coverage_complete": s.coverage_complete, "duration_seconds": s.manifest["duration_seconds"], "manifest_source": s.manifest_source, "participants": people,
        "windows": [{"id": f"w{k}", "latest_start": iso(r.latest_start), "local": [local[r.s][p] for p in sorted(local[r.s])]} | _span(r) for k, r in enumerate(windows, 1)], "window_seconds": sum(r.seconds for r in windows),
    }


def json_bytes(report: dict, limit: int | None = None) -> bytes:
    """Sorted keys, two spaces, ASCII and a newline at the end; written piece by piece up to ``limit`` bytes."""
    out = bytearray()
    for part in json.JSONEncoder(indent=2, sort_keys=True).iterencode(report):
        out += part.encode()
        if limit is not None and len(out) >= limit:
            raise LimitError(f"report_bytes limit exceeded ({limit})")
    return bytes(out) + b"\n"


def hours(secs: int | None) -> str:
    return "unknown" if secs is None else f"{secs / 3600:.2f} h"


#: Lists whose records refer to others, by the list's field.
_REFERENCES = {"event", "master", "override", "left", "right", "source", "window", "duplicate_of", "members", "starting", "ending", "before", "after"}
_STYLE = "body{font:14px sans-serif;margin:2em}td,th{padding:2px 8px;text-align:left;border-bottom:1px solid #ccc}nav a{margin-right:1em}tr:target{background:#ffd}.card{border:1px solid #ccc;padding:.5em 1em;margin:.5em 0}"


def _cell(field: str, value) -> str:
    """A value as escaped text; ids of other records are links to them."""
    if value is None:
        return ""
    if field in _REFERENCES:
        ids = value if isinstance(value, list) else [value]
        if all(isinstance(x, str) for x in ids):
            return " ".join(f'<a href="#{html.escape(x)}">{html.escape(x)}</a>' for x in ids)
    if field == "sources" and isinstance(value, list) and all(isinstance(x, dict) and "source" in x for x in value):
        return ", ".join(f'<a href="#{html.escape(x["source"])}">{html.escape(x["source"])}</a> #{x.get("event", "")}' for x in value)
    if field.endswith("seconds"):
        return hours(value)
    return html.escape(json.dumps(value) if isinstance(value, (list, dict)) else str(value))


def _rows(key: str, rows: list[dict]) -> str:
    names = list(dict.fromkeys(n for r in rows for n in r))
    head = "".join(f"<th>{html.escape(n)}</th>" for n in names)
    body = "".join(f'<tr id="{html.escape(str(r.get("id", "")))}">' + "".join(f"<td>{_cell(n, r.get(n))}</td>" for n in names) + "</tr>" for r in rows)
    return f"<table><tr>{head}</tr>{body}</table>"


def _cards(rows: list[dict], by: str) -> str:
    """Records in cards, one group for each value of ``by``, to which the page's index leads."""
    out, last = [], None
    for r in rows:
        if r.get(by) != last:
            last = r.get(by)
            out.append(f'<h3 id="on-{html.escape(str(last))}">{html.escape(str(last))}</h3>')
        out.append(f'<div class="card" id="{html.escape(str(r["id"]))}">' + " &middot; ".join(f"<b>{html.escape(n)}</b> {_cell(n, v)}" for n, v in r.items()) + "</div>")
    return "".join(out)


def html_bytes(title: str, report: dict, limit: int | None = None) -> bytes:
    """One page without scripts or outside content, all text escaped: totals, an index, and a section for each list of records.

    Records are anchors, and ids in them links: from an overlap to its occurrences, from those to their
    events and from these to their files. Gaps are cards under their dates, which the index names (the date
    filter of a page without scripts), with what ends and begins at their edges.
    """
    flat = dict(report) | {k: v for k, v in report.get("audit", {}).items() if k not in report}
    lists = {k: v for k, v in flat.items() if isinstance(v, list) and v and isinstance(v[0], dict)}
    dates = sorted({r["date"] for r in lists.get("candidates", []) if "date" in r})
    esc = html.escape
    parts = ["<!DOCTYPE html><html lang=en><head><meta charset=utf-8><meta http-equiv=Content-Security-Policy content=\"default-src 'none'; style-src 'unsafe-inline'\">", f"<title>{esc(title)}</title><style>{_STYLE}</style></head><body><h1>{esc(title)}</h1><nav>"]
    parts += [f'<a href="#{esc(k)}">{esc(k)} ({len(v)})</a>' for k, v in lists.items()] + [f'<a href="#on-{esc(d)}">{esc(d)}</a>' for d in dates] + ["</nav><dl>"]
    parts += [f"<dt>{esc(k)}</dt><dd>{(hours(v) if k.endswith('_seconds') else _cell(k, v))}</dd>" for k, v in flat.items() if not isinstance(v, (list, dict)) or k in ("counters", "window")]
    parts.append("</dl>")
    for key, rows in lists.items():
        parts.append(f'<h2 id="{esc(key)}">{esc(key)}</h2>' + (_cards(rows, "date") if key == "candidates" else _rows(key, rows)))
    raw = "".join([*parts, "</body></html>\n"]).encode()
    if limit is not None and len(raw) > limit:
        raise LimitError(f"report_bytes limit exceeded ({limit})")
    return raw


def write_bundle(folder: str, files: dict[str, bytes]) -> None:
    """All files or none: they are written and synced beside ``folder``, which must not exist, and moved there in one step.

    Signals wait while the stage is made and while it is moved, so that an interrupted run leaves neither a stage nor an empty folder.
    """
    if os.path.lexists(folder):
        raise FileExistsError(folder)
    stage = None
    try:
        with undisturbed():
            stage = tempfile.mkdtemp(prefix=".bundle-", dir=os.path.dirname(os.path.abspath(folder)))
        for name, raw in files.items():
            with open(os.open(os.path.join(stage, name), os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "wb") as f:
                f.write(raw)
                f.flush()
                os.fsync(f.fileno())
        with undisturbed():
            os.mkdir(folder, 0o700)  # fails if another has made it meanwhile
            os.rename(stage, folder)
    finally:
        if stage is not None:
            shutil.rmtree(stage, ignore_errors=True)
