"""Command line: audit, availability, freebusy and shared. Exit 0: complete, 2: incomplete or (but for audit) a limit, 1: bad input or a limit of audit."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import fields

from pyspark.errors import PySparkException

from .errors import InputError, LimitError, Limits, deadline, terminable
from .plans.audit import Audit
from .plans.availability import Availability, Shared, busy_periods
from .session import session
from .sinks import bundle, freebusy, report
from .sources import specs


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom")
    sub = top.add_subparsers(dest="command", required=True)
    audit = sub.add_parser("audit", help="overlaps and occupancy of calendars")
    audit.add_argument("--floating-timezone")
    audit.add_argument("--no-overlaps", action="store_true")
    audit.add_argument("--lines", metavar="FOLDER", help="also write the report's lists as JSON lines from the executors, to a folder that they share")
    export = sub.add_parser("freebusy", help="a calendar of busy periods only")
    export.add_argument("--all-day", required=True, choices=("block", "ignore"))
    export.add_argument("--uid")
    export.add_argument("--created-at")
    export.add_argument("--max-intervals", type=int, default=20_000)
    for p in (audit, export):
        p.add_argument("--start", required=True)
        p.add_argument("--end", required=True)
        p.add_argument("--timezone", required=True)
    free = sub.add_parser("availability", help="free time inside working windows")
    free.add_argument("--spec", required=True)
    free.add_argument("--max-days", type=int, default=90)
    free.add_argument("--include-overlaps", action="store_true")
    for p in (audit, export, free):
        p.add_argument("calendars", nargs="+")
    shared = sub.add_parser("shared", help="windows shared by several participants")
    shared.add_argument("manifest")
    for p in (audit, export, free, shared):
        p.add_argument("--output", required=True)
        p.add_argument("--max-seconds", type=float, help="cancel the run after so long")
        for f in fields(Limits):
            if p is export and f.name == "intervals":
                continue  # it has its own
            p.add_argument("--max-" + f.name.replace("_", "-"), type=int, help=f"at most, and by default, {f.default}")
    return top


def _bundle(folder: str, title: str, content: dict, limits: Limits) -> None:
    report.write_bundle(folder, {"report.json": report.json_bytes(content, limits.report_bytes), "report.html": report.html_bytes(title, content, limits.report_bytes)})


def run(argv: list[str] | None = None, spark_of: Callable = session, limits: Limits | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        limits = limits or Limits.lowered(**{f.name: getattr(args, f"max_{f.name}") for f in fields(Limits)})
        with terminable(), deadline(spark_of(), args.max_seconds):
            return _run(args, spark_of, limits)
    except (LimitError, freebusy.IncompleteExport) as e:
        print(e, file=sys.stderr)
        return 1 if args.command == "audit" else 2
    except (InputError, ValueError, OSError, PySparkException) as e:
        print(e, file=sys.stderr)
        return 1
    except KeyboardInterrupt:
        return 130


def _run(args: argparse.Namespace, spark_of: Callable, limits: Limits) -> int:
    if args.command == "freebusy":
        uid, created = freebusy.export_identity(args.uid, args.created_at)
        lo, hi, found = busy_periods(spark_of(), args.calendars, args.start, args.end, args.timezone, args.all_day, limits, args.max_intervals)
        report.write_bundle(args.output, {"busy.ics": freebusy.calendar_bytes(found, lo, hi, uid, created, limits.report_bytes)})
        return 0
    if args.command == "audit":
        audit = Audit(spark_of(), args.calendars, args.start, args.end, args.timezone, args.floating_timezone, limits)
        content = report.audit_report(audit, not args.no_overlaps)
        if args.lines:
            bundle.write(report.audit_lists(audit, not args.no_overlaps), args.lines)
    elif args.command == "availability":
        spec, source = specs.load_spec(args.spec, args.max_days)
        content = report.availability_report(Availability(spark_of(), args.calendars, spec, limits, args.max_days), args.include_overlaps) | {"spec_source": source}
    else:
        content = report.shared_report(Shared(spark_of(), args.manifest, limits))
    _bundle(args.output, args.command, content, limits)
    return 0 if content["complete"] else 2


if __name__ == "__main__":
    sys.exit(run())
