import json
import os
import random
import signal
import time

import pytest
from calendars import Sample, calendar, event, minutes, runs, seconds
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.errors import LimitError, Limits
from spanloom.sinks import report
from spanloom.streaming import occupancy


def run(spark, *argv, **more):
    return cli.run(list(argv), lambda: spark, **more)


def test_audit_bundle(spark, tmp_path):
    x = Sample(1, entries=24)
    path, out = tmp_path / "m.ics", str(tmp_path / "out")
    path.write_text(x.text, newline="")
    window = ["--start", "2025-10-24", "--end", "2025-10-28", "--timezone", "Europe/Berlin"]
    assert run(spark, "audit", *window, "--output", out, str(path)) == 0
    got = json.loads((tmp_path / "out" / "report.json").read_text())
    names = [o["id"] for o in got["occurrences"]]
    assert (got["occupied_seconds"], len(got["cancellations"]), got["complete"]) == (60 * len(minutes(x.times)), x.cancelled, True) and len(names) > 10
    assert names == [f"o{k}" for k in range(1, len(names) + 1)] and {p[side] for p in got["overlaps"] for side in ("left", "right")} <= set(names)
    assert sorted(os.listdir(out)) == ["report.html", "report.json"] and os.stat(out).st_mode & 0o777 == 0o700
    assert run(spark, "audit", *window, "--output", out, str(path)) == 1  # never overwritten
    assert run(spark, "audit", *window, "--output", out + "2", str(path), limits=Limits(pairs=len(got["overlaps"]) - 1)) == 1 and not os.path.exists(out + "2")
    assert run(spark, "audit", *window, "--output", out + "3", str(tmp_path / "missing.ics")) == 1


def test_incomplete_exits_2_and_text_is_escaped(spark, tmp_path):
    path = tmp_path / "w.ics"
    path.write_text(calendar(event("u", "20260303T100000Z", None, "RRULE:FREQ=YEARLY", summary="<script>x</script>")))
    window = ["--start", "2026-03-03", "--end", "2026-03-06", "--timezone", "UTC"]
    assert run(spark, "audit", *window, "--output", str(tmp_path / "a"), str(path)) == 2
    page = (tmp_path / "a" / "report.html").read_text()
    assert "<script" not in page and "&lt;script&gt;" in page and "default-src 'none'" in page
    assert run(spark, "freebusy", *window, "--all-day", "ignore", "--output", str(tmp_path / "b"), str(path)) == 2 and not (tmp_path / "b").exists()
    assert run(spark, "freebusy", *window, "--all-day", "ignore", "--uid", "x", "--output", str(tmp_path / "b"), str(path)) == 1


def test_availability_bundle(spark, tmp_path):
    x = Sample(12)
    x.text = x.text.replace("END:VCALENDAR", "\r\n".join([*event("far", "20251029T100000Z"), "END:VCALENDAR"]))
    # twelve that begin together, so that a list of ids has two digits
    crowd = [event(f"crowd{k}", ";TZID=Europe/Berlin:20251024T140000", ";TZID=Europe/Berlin:20251024T150000") for k in range(12)]
    x.text = x.text.replace("END:VCALENDAR", "\r\n".join([line for e in crowd for line in e] + ["END:VCALENDAR"]))
    (tmp_path / "w.ics").write_text(x.text, newline="")
    spec = {"version": 1, "start": "2025-10-24", "end": "2025-10-28", "timezone": "Europe/Berlin", "weekdays": ["MO", "FR"], "work_start": "08:00", "work_end": "16:30", "minimum_seconds": 2400, "all_day": "ignore"}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    assert run(spark, "availability", "--spec", str(tmp_path / "s.json"), "--output", str(tmp_path / "o"), str(tmp_path / "w.ics")) == 0
    got = json.loads((tmp_path / "o" / "report.json").read_text())
    busy = minutes([*x.times, (seconds("2025-10-24 14:00"), seconds("2025-10-24 15:00"))])
    free = [minutes([(seconds(f"2025-10-{d} 08:00"), seconds(f"2025-10-{d} 16:30"))]) - busy for d in (24, 27)]
    assert got["candidate_seconds"] == sum(n for day in free for n in runs(day) if n >= 2400)
    lists = [b["members"] for b in got["busy"]]
    assert max(map(len, lists)) >= 12 and all(ids == sorted(ids) for ids in lists)  # as texts: o10 before o2


def test_bounded_json():
    with pytest.raises(LimitError):
        report.json_bytes({"a": list(range(1000))}, 100)
    assert report.json_bytes({"b": 1, "a": "é"}) == b'{\n  "a": "\\u00e9",\n  "b": 1\n}\n'


def test_streamed_islands_equal_batch(spark, tmp_path):
    from spanloom.operators import intervals as iv

    rows = [(k % 3, k, k * 977 % 5000, k * 977 % 5000 + 1 + k * 31 % 300) for k in range(60)] + [(0, 99, 10**7, 10**7 + 1)]
    df = spark.createDataFrame(rows, "owner int, id int, s long, e long")
    at = lambda c: F.timestamp_seconds(c)
    df.select("owner", "id", at("s").alias("begins"), at("e").alias("ends")).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("owner int, id int, begins timestamp, ends timestamp").parquet(str(tmp_path / "in"))
    query = occupancy.islands(stream, ["owner"], "1 minute").writeStream.format("memory").queryName("blocks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.owner, r.s, r.e) for r in spark.sql("select owner, unix_timestamp(begins) s, unix_timestamp(ends) e from blocks").collect()}
    want = {(r.owner, r.s, r.e) for r in iv.islands(df.where("id < 99"), ["owner"]).collect()}
    assert got == want


def test_streamed_days_add_up_to_the_batch_rollup(spark, tmp_path):
    import datetime

    from spanloom.operators.rollup import daily, day_spine

    rows = [(k % 2, k, k * 7_919 % 250_000, k * 7_919 % 250_000 + 1 + k * 997 % 60_000) for k in range(40)] + [(o, 99, 10**7, 10**7 + 1) for o in (0, 1)]
    df = spark.createDataFrame(rows, "owner int, id int, s long, e long")
    df.select("owner", "id", F.timestamp_seconds("s").alias("begins"), F.timestamp_seconds("e").alias("ends")).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("owner int, id int, begins timestamp, ends timestamp").parquet(str(tmp_path / "in"))
    query = occupancy.daily(stream, ["owner"], "1 minute").writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.owner, r.date): r.n for r in spark.sql("select owner, date, sum(seconds) n from days group by owner, date").collect()}
    want = daily(df.where("id < 99"), day_spine(spark, datetime.date(1970, 1, 1), datetime.date(1970, 1, 5)), ("owner",)).where("occupied_seconds > 0").collect()
    assert got == {(r.owner, r.date): r.occupied_seconds for r in want}


def _stream(spark, tmp_path, rows, parts):
    """A file stream that takes ``parts`` files in turn."""
    for k in range(parts):
        part = spark.createDataFrame(rows[k::parts], "owner int, id int, s long, e long")
        part.select("owner", "id", F.timestamp_seconds("s").alias("begins"), F.timestamp_seconds("e").alias("ends")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema("owner int, id int, begins timestamp, ends timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(spark, df, name, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    state = sum(x.numRowsTotal for x in query.lastProgress.stateOperators) if query.lastProgress else 0
    query.stop()
    return spark.table(name).collect(), state


def test_streamed_levels_equal_batch_and_their_state_is_emptied(spark, tmp_path):
    from spanloom.operators import intervals as iv
    from spanloom.streaming import levels

    rng = random.Random(3)
    rows = [(k % 2, k, s, s + 1 + rng.randrange(400)) for k in range(80) for s in (k * 30 + rng.randrange(300),)]
    rng.shuffle(rows)
    last = [(o, 99, 10**6, 10**6 + 1) for o in (0, 1)] + [(0, 98, 5, 50)]
    before = spark.conf.get(levels.STATE_STORE[0], None)
    spark.conf.set(*levels.STATE_STORE)
    try:
        # every order of arrival is within the watermark; then time moves on, and a row comes too late
        stream = _stream(spark, tmp_path, [*rows], 2)
        spark.createDataFrame(last[:2], "owner int, id int, s long, e long").select("owner", "id", F.timestamp_seconds("s").alias("begins"), F.timestamp_seconds("e").alias("ends")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        spark.createDataFrame(last[2:], "owner int, id int, s long, e long").select("owner", "id", F.timestamp_seconds("s").alias("begins"), F.timestamp_seconds("e").alias("ends")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        cells, state = _run(spark, levels.concurrency(stream, "owner", "1 hour"), "levels", tmp_path)
    finally:
        spark.conf.unset(levels.STATE_STORE[0]) if before is None else spark.conf.set(levels.STATE_STORE[0], before)
    got = {}
    for r in cells:
        got[r.owner, r.level] = got.get((r.owner, r.level), 0) + (r.e - r.s) // 1000
    want = {(r.owner, r.level): r.seconds for r in iv.concurrency(spark.createDataFrame(rows, "owner int, id int, s long, e long"), ["owner"]).collect()}
    assert got == want
    assert state <= 20  # two open edges an owner, their timers and a level


def test_streamed_daily_bound(spark, tmp_path):
    rows = [(k % 2, k, k * 7_919 % 250_000, k * 7_919 % 250_000 + 1 + k * 997 % 60_000) for k in range(40)]
    stream = _stream(spark, tmp_path, [*rows, (0, 99, 10**7, 10**7 + 1)], 1)
    found, _ = _run(spark, occupancy.daily_bound(stream, ["owner"], "1 minute"), "bound", tmp_path)
    want = {}
    for owner, _, s, e in rows:
        n, secs = want.get((owner, s // 86_400), (0, 0))
        want[owner, s // 86_400] = (n + 1, secs + e - s)
    assert {(r.owner, r.date.toordinal() - 719_163): (r.intervals, r.seconds) for r in found} == want


def test_lists_are_written_by_executors_or_not_at_all(spark, tmp_path):
    from spanloom.plans.audit import Audit
    from spanloom.sinks import bundle

    x = Sample(1, entries=24)
    (tmp_path / "w.ics").write_text(x.text, newline="")
    window = ["--start", "2025-10-24", "--end", "2025-10-28", "--timezone", "Europe/Berlin"]
    out, lines = tmp_path / "out", tmp_path / "lines"
    assert run(spark, "audit", *window, "--output", str(out), "--lines", str(lines), str(tmp_path / "w.ics")) == 0
    report_, manifest = json.loads((out / "report.json").read_text()), json.loads((lines / "manifest.json").read_text())
    for section in ("sources", "events", "occurrences", "overlaps", "daily"):
        found = [json.loads(line) for f in manifest["sections"][section]["files"] for line in (lines / section / f["name"]).read_text().splitlines()]
        assert len(found) == manifest["sections"][section]["rows"] == len(report_[section])
        for small, large in zip(report_[section], sorted(found, key=lambda r: int(r["id"][1:]) if "id" in r else r["date"]), strict=True):
            assert all(small[k] == v for k, v in large.items() if k in small and k not in ("event", "source") or section in ("occurrences", "overlaps"))
    assert sorted(p.name for p in lines.iterdir()) == sorted([*manifest["sections"], "manifest.json"])
    with pytest.raises(Exception, match="lines"):
        bundle.write({"x": spark.range(3).select(F.col("id").alias("n"), "id")}, str(lines))  # never overwritten
    broken = spark.range(100).select(F.col("id").alias("n"), F.when(F.col("id") == 77, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="killed"):
        bundle.write({"x": broken}, str(tmp_path / "broken"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["lines", "out", "w.ics"]
    audit = Audit(spark, [str(tmp_path / "w.ics")], "2025-10-24", "2025-10-28", "Europe/Berlin")
    assert audit.counters == {k: v for k, v in report_["counters"].items() if k != "pairs"} and audit.counters["events"] == audit.records.count() and audit.counters["occurrences"] == audit.occurrences.count()


def test_input_is_refused_before_it_is_read(spark, tmp_path):
    path = tmp_path / "huge.ics"
    with open(path, "wb") as f:
        f.truncate(10 << 30)  # takes no room
    began = time.monotonic()
    assert run(spark, "audit", "--start", "2025-10-24", "--end", "2025-10-28", "--timezone", "UTC", "--output", str(tmp_path / "o"), str(path)) == 1
    assert time.monotonic() - began < 30 and not (tmp_path / "o").exists()


def test_signals_and_deadline(spark, tmp_path):
    from spanloom import errors

    with pytest.raises(KeyboardInterrupt), errors.terminable():
        os.kill(os.getpid(), signal.SIGTERM)
        time.sleep(5)
    began = time.monotonic()
    with pytest.raises(LimitError, match="seconds"), errors.deadline(spark, 0.2):
        time.sleep(20)  # the driver's own work, without a job
    assert time.monotonic() - began < 10
    seen = []
    with pytest.raises(KeyboardInterrupt), errors.terminable():
        with errors.undisturbed():
            os.kill(os.getpid(), signal.SIGTERM)
            seen.append("whole")
        time.sleep(5)
    assert seen == ["whole"]


def test_freebusy_and_shared_limits(spark, tmp_path):
    (tmp_path / "w.ics").write_text(calendar(*(event(f"u{k}", f"20251024T{k:02}0000Z", f"20251024T{k:02}3000Z") for k in range(20))), newline="")
    window = ["--start", "2025-10-24", "--end", "2025-10-25", "--timezone", "UTC", "--all-day", "ignore"]
    assert run(spark, "freebusy", *window, "--output", str(tmp_path / "a"), "--max-report-bytes", "300", str(tmp_path / "w.ics")) == 2 and not (tmp_path / "a").exists()
    assert run(spark, "freebusy", *window, "--output", str(tmp_path / "a"), str(tmp_path / "w.ics")) == 0
    source = {"path": "a/busy.ics", "complete_occupancy": True}
    manifest = {"version": 1, "start": "2025-10-24T00:00:00Z", "end": "2025-10-25T00:00:00Z", "duration_seconds": 600, "participants": [{"alias": "A", "timezone": "UTC", "weekly": {"FR": [["00:00", "24:00"]]}, "sources": [source]}, {"alias": "B", "timezone": "UTC", "weekly": {"FR": [["00:00", "24:00"]]}, "sources": [source | {"path": "b.ics"}]}]}
    (tmp_path / "b.ics").write_bytes((tmp_path / "a" / "busy.ics").read_bytes())
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    size = (tmp_path / "b.ics").stat().st_size
    for name, least in (("periods", 40), ("intervals", 60), ("windows", 20), ("input_bytes", 2 * size)):
        flag = ["--max-" + name.replace("_", "-")]
        assert run(spark, "shared", "--output", str(tmp_path / f"s-{name}"), *flag, str(least - 1), str(tmp_path / "m.json")) == 2, name
    assert run(spark, "shared", "--output", str(tmp_path / "s"), "--max-periods", "40", "--max-input-bytes", str(2 * size), str(tmp_path / "m.json")) == 0
