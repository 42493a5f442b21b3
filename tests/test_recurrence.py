"""Recurrence against a day-by-day walk in Python's own zones, and families, schedules and shared windows against cells, over many seeds."""

import datetime
import random
import zoneinfo
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from spanloom.operators import families, intervals, recurrence, scheduling

ZONES = ("America/New_York", "Europe/Berlin", "Australia/Lord_Howe", "UTC")


def walk(local, zone, freq, interval, byday, wkst, count, until, horizon):
    """Occurrences by looking at every day in turn."""
    tz, utc = zoneinfo.ZoneInfo(zone), zoneinfo.ZoneInfo("UTC")
    out, day = [], local
    first_week = local.date() - datetime.timedelta((local.weekday() - wkst) % 7)
    while day <= horizon and (count is None or len(out) < count):
        at = day.replace(tzinfo=tz).astimezone(utc).replace(tzinfo=None)
        back = at.replace(tzinfo=utc).astimezone(tz).replace(tzinfo=None)
        week = (day.date() - first_week).days // 7
        named = (day - local).days % interval == 0 if freq == "DAILY" else week % interval == 0 and day.weekday() in (byday or [local.weekday()])
        if day == local or named and back == day and (until is None or at <= until):
            out.append((len(out) + 1, day, at))
        day += datetime.timedelta(1)
    return out


def test_rules_over_changes_of_the_clock(spark):
    rows, want = [], []
    for seed in range(256):
        rng = random.Random(seed)
        zone = ZONES[seed % 4]
        near = datetime.datetime(2024, *rng.choice(((3, 1), (3, 25), (10, 1), (10, 25), (4, 1))))
        local = near + datetime.timedelta(rng.randrange(10), rng.choice((0, 1800, 5400, 7200, 9000, 12_600, 82_800)))
        freq, interval = rng.choice(("DAILY", "WEEKLY")), rng.randint(1, 3)
        byday = sorted(rng.sample(range(7), rng.randint(1, 4))) if freq == "WEEKLY" and seed % 3 else None
        wkst = rng.randrange(7) if freq == "WEEKLY" else 0
        count = rng.randint(1, 12) if seed % 2 else None
        until = None if count else local + datetime.timedelta(rng.randint(0, 40), 3600) if seed % 4 else None
        horizon = local + datetime.timedelta(rng.randint(0, 45))
        rows.append((seed, local, zone, freq, interval, byday, wkst, count, until, horizon))
        want += [(seed, *x) for x in walk(local, zone, freq, interval, byday, wkst, count, until, horizon)]
    df = spark.createDataFrame(rows, "family int, local timestamp_ntz, zone string, freq string, interval int, byday array<int>, wkst int, count int, until_utc timestamp_ntz, horizon timestamp_ntz")
    got = recurrence.expand(df, F.col("horizon")).collect()
    assert sorted((r.family, r.ordinal, r.local, r.utc) for r in got) == sorted(want)


def test_family_checks_equal_a_plain_count(spark):
    rows = []
    for seed in range(256):
        rng = random.Random(seed)
        for k in range(rng.randint(1, 5)):
            rows.append((f"u{seed}", rng.choice("ab"), rng.randint(1, 2), rng.random() < 0.5, rng.randint(0, 1), seed * 10 + k))
    df = spark.createDataFrame(rows, "uid string, fingerprint string, source int, is_override boolean, identity int, ord int")
    want, sets, first = {}, defaultdict(lambda: defaultdict(set)), defaultdict(list)
    for uid in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == uid]
        masters, overrides = [r for r in own if not r[3]], Counter(r[4] for r in own if r[3])
        code = "orphan_override" if not masters else "conflicting_masters" if len(masters) > 1 else "conflicting_overrides" if max(overrides.values(), default=0) > 1 else None
        if code:
            want[uid] = code
    for uid, f, source, _, _, o in rows:
        sets[uid][source].add(f)
        first[uid, f].append(o)
    assert {r.uid: r.code for r in families.cardinality_errors(df).collect()} == want
    assert {r.uid for r in families.snapshot_conflicts(df).collect()} == {u for u, by in sets.items() if len({frozenset(x) for x in by.values()}) > 1}
    assert {(r.uid, r.fingerprint): (r.canonical, r.duplicates) for r in families.dedup(df).collect()} == {k: (min(v), len(v) - 1) for k, v in first.items()}


def test_shared_windows_equal_one_second_cells(spark):
    people, busy, want = [], [], {}
    for seed in range(256):
        rng = random.Random(seed)
        n, free_of = rng.randint(1, 5), []
        for p in range(n):
            cells = set()
            for _ in range(rng.randint(1, 3)):
                s = rng.randrange(600)
                people.append((seed, p, s, min(600, s + rng.randint(1, 300))))
                cells |= set(range(s, people[-1][3]))
            for _ in range(rng.randint(0, 3)):
                s = rng.randrange(600)
                busy.append((seed, p, s, s + rng.randint(1, 120)))
                cells -= set(range(s, busy[-1][3]))
            free_of.append(cells)
        want[seed] = (n, set.intersection(*free_of))
    work, held = (spark.createDataFrame(x, "seed int, pid int, s long, e long") for x in (people, busy))
    free = intervals.subtract(work, held, ["seed", "pid"], 100)
    size = spark.createDataFrame([(k, n) for k, (n, _) in want.items()], "seed int, n int")
    got = defaultdict(set)
    for n in range(1, 6):
        for r in intervals.common(free.join(size.where(F.col("n") == n), "seed").select("seed", "pid", "s", "e"), "pid", n, ["seed"], 100).collect():
            assert not got[r.seed] & set(range(r.s - 1, r.e + 1))  # apart, so each is whole
            got[r.seed] |= set(range(r.s, r.e))
    assert all(got[k] == cells for k, (_, cells) in want.items())


def test_schedules_equal_minute_cells(spark):
    rows, cells = [], {}
    for seed in range(200):  # a date each, all in Berlin's summer
        rng, date, spans = random.Random(seed), datetime.date(2024, 4, 2) + datetime.timedelta(seed), []
        for _ in range(rng.randint(0, 4)):
            lo = rng.randrange(0, 1380, 15)
            spans.append((lo, min(1440, lo + 15 * rng.randint(1, 20))))
        apart = []
        for a, b in sorted(spans):
            if not apart or a >= apart[-1][1]:
                apart.append((a, b))
        rows.append((date, apart))
        cells[date] = {m for a, b in apart for m in range(a, b)}
    found = scheduling.merge_windows(spark.createDataFrame(rows, "date date, windows array<struct<lo:int,hi:int>>"), "Europe/Berlin").collect()
    got = defaultdict(set)
    for r in found:
        midnight = int(datetime.datetime.combine(r.date, datetime.time(), zoneinfo.ZoneInfo("Europe/Berlin")).timestamp())
        own = set(range((r.s - midnight) // 60, (r.e - midnight) // 60))
        assert r.error is None and not got[r.date] & {min(own) - 1, *own, max(own) + 1}  # windows that touch are one
        got[r.date] |= own
    assert all(got[d] == own for d, own in cells.items())


def test_a_window_far_from_the_start_makes_only_its_own_candidates(spark):
    """Rules from 1900, over a window of 90 days: the same rows as from the start on, without making those before."""
    rng, rows = random.Random(8), []
    begin, horizon = datetime.datetime(2024, 2, 20), datetime.datetime(2024, 5, 20)
    for k in range(40):
        local = datetime.datetime(1900, 1, 1) + datetime.timedelta(rng.randrange(400), rng.choice((0, 7200, 9000)))
        freq = rng.choice(("DAILY", "WEEKLY"))
        rows.append((k, local, ZONES[k % 4], freq, rng.randint(1, 3), sorted(rng.sample(range(7), 2)) if freq == "WEEKLY" else None, rng.randrange(7), rng.choice((None, 2000, 45_000))))
    df = spark.createDataFrame(rows, "family int, local timestamp_ntz, zone string, freq string, interval int, byday array<int>, wkst int, count int")
    key = lambda r: (r.family, r.ordinal, r.local, r.utc)
    every = recurrence.expand(df, F.lit(horizon)).where(F.col("local") >= F.lit(begin)).collect()
    part = recurrence.expand(df, F.lit(horizon), from_local=F.lit(begin))
    assert sorted(map(key, part.collect())) == sorted(map(key, every)) and len(every) > 500
    daily = df.where("freq = 'DAILY' and interval = 1 and count is null").limit(1)
    assert 85 <= recurrence.expand(daily, F.lit(horizon), from_local=F.lit(begin)).count() <= 91


def test_zone_periods_equal_conversions_one_by_one(spark):
    from spanloom.functions import times, zones

    names = ["America/New_York", "Europe/Dublin", "Australia/Lord_Howe", "Pacific/Apia", "Asia/Kathmandu", "Africa/Monrovia", "UTC"]
    first, last = (datetime.date(y, 1, 1).toordinal() - 719_163 for y in (1900, 2040))
    table = zones.periods(spark, names, first, last)
    at = F.lit(first * 86_400) + F.pmod(F.xxhash64("id"), F.lit((last - first) * 86_400))
    some = spark.range(60_000).select(at.alias("t"), F.get(F.array(*map(F.lit, names)), (F.col("id") % 7).cast("int")).alias("zone"))
    near = table.where("hi < 4000000000000").select("zone", F.explode(F.array("shown", "hi")).alias("x")).select("zone", F.explode(F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda k: F.col("x") + k * 900)).alias("t")).select("t", "zone").where(F.col("t").between(first * 86_400, last * 86_400))
    rows = some.unionByName(near).distinct().join(table, "zone").where("t >= lo and t < hi")
    local = times.instant("t")
    wrong = rows.where((times.seconds(times.to_utc(local, F.col("zone"))) != F.col("t") - F.col("offset")) | (times.exists(local, F.col("zone")) != (F.col("t") < F.col("shown"))))
    assert wrong.collect() == [] and rows.count() == some.unionByName(near).distinct().count()
    assert table.where("zone = 'Pacific/Apia' and hi - shown = 86400").count() == 1
