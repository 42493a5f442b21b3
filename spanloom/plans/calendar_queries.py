"""Queries over recurrence rules, families, schedules, shared windows and free/busy lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import families, recurrence, scheduling
from ..operators import intervals as iv
from ..sinks import freebusy
from .registry import EVENTS, HI, LO, gaps_sql, intervals, islands_sql, level_sql, query, table

_RULES = ("FREQ=DAILY;INTERVAL=2;COUNT=5", "freq=weekly;byday=mo,we;wkst=su", "FREQ=MONTHLY", "FREQ=DAILY;COUNT=3;UNTIL=20240101T000000Z", "FREQ=WEEKLY;BYDAY=XX", "FREQ=DAILY;BYDAY=MO", "FREQ=DAILY;FREQ=DAILY", "FREQ=WEEKLY;INTERVAL=0", "FREQ=DAILY;UNTIL=20240301T000000Z;X=1", "FREQ=WEEKLY;COUNT=12;BYDAY=SU,TU;INTERVAL=3")


@query(
    f"""WITH r AS (SELECT o_orderkey id, upper(list_extract({list(_RULES)}, CAST(o_custkey % 10 AS INTEGER) + 1)) r FROM orders),
p AS (SELECT id, regexp_extract(r, 'FREQ=([A-Z]+)', 1) f, regexp_extract(r, 'INTERVAL=([0-9]+)', 1) i, regexp_extract(r, 'COUNT=([0-9]+)', 1) c, regexp_extract(r, 'UNTIL=([0-9TZ]+)', 1) u, regexp_extract(r, 'BYDAY=([A-Z,]+)', 1) b, regexp_extract(r, 'WKST=([A-Z]+)', 1) w, r FROM r),
x AS (SELECT *, CASE WHEN r LIKE '%FREQ=%FREQ=%' THEN 'duplicate part' WHEN r LIKE '%;X=%' THEN 'unsupported part' WHEN f NOT IN ('DAILY', 'WEEKLY') THEN 'unsupported frequency' WHEN f = 'DAILY' AND (b <> '' OR w <> '') THEN 'weekly part of a daily rule'
WHEN i = '0' THEN 'bad interval' WHEN c <> '' AND u <> '' THEN 'count and until' WHEN b = 'XX' THEN 'bad weekday' END error FROM p)
SELECT id, CASE WHEN error IS NULL THEN f END AS freq, CASE WHEN error IS NULL THEN coalesce(TRY_CAST(i AS INTEGER), 1) END AS "interval", CASE WHEN error IS NULL THEN TRY_CAST(c AS INTEGER) END AS "count", CASE WHEN error IS NULL AND u <> '' THEN u END AS "until",
CASE WHEN error IS NULL AND b <> '' THEN array_to_string(list_sort(list_transform(string_split(b, ','), lambda d: list_position(['MO', 'TU', 'WE', 'TH', 'FR', 'SA', 'SU'], d) - 1)), ',') END AS byday,
CASE WHEN error IS NULL THEN CASE WHEN w = 'SU' THEN 6 ELSE 0 END END::INTEGER AS wkst, error FROM x"""
)
def rrule_parse(spark: SparkSession, d: str) -> DataFrame:
    rules = F.array(*map(F.lit, _RULES))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.get(rules, (F.col("o_custkey") % 10).cast("int")).alias("rule"))
    return rows.select("id", recurrence.parse_rule("rule").alias("r")).select("id", "r.freq", "r.interval", "r.count", "r.until", F.array_join("r.byday", ",").alias("byday"), "r.wkst", "r.error")


def _masters(spark: SparkSession, d: str) -> DataFrame:
    """Orders as families: each begins at nine on its order's date, in UTC."""
    start = F.timestamp_add("HOUR", F.lit(9), F.col("o_orderdate").cast("timestamp_ntz"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("family"), start.alias("local"), F.lit("UTC").alias("zone"), F.col("o_custkey").alias("k"))


_START = "CAST(o_orderdate AS TIMESTAMP) + INTERVAL 9 HOUR"
_DAILY = f"occ AS (SELECT o_orderkey AS family, CAST(x + 1 AS INTEGER) AS ordinal, {_START} + to_days(CAST(x * (1 + o_custkey % 3) AS INTEGER)) AS utc FROM (SELECT *, unnest(range(2 + o_custkey % 5)) x FROM orders))"


def _daily(spark: SparkSession, d: str) -> DataFrame:
    masters = _masters(spark, d).select("family", "local", "zone", F.lit("DAILY").alias("freq"), (1 + F.col("k") % 3).cast("int").alias("interval"), (2 + F.col("k") % 5).cast("int").alias("count"))
    return recurrence.expand(masters, F.timestamp_add("DAY", F.lit(90), "local")).select("family", "ordinal", "utc")


@query(f"WITH {_DAILY} SELECT * FROM occ")
def recur_daily(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d)


@query(
    """WITH m AS (SELECT o_orderkey family, TIMESTAMP '1900-01-01 09:30:00' + to_days(CAST(o_orderkey % 1000 AS INTEGER)) start, 1 + o_custkey % 7 n, CAST(o_orderdate AS DATE) d FROM orders),
i AS (SELECT *, unnest(range((date_diff('day', CAST(start AS DATE), d) + n - 1) // n, date_diff('day', CAST(start AS DATE), d) // n + 40)) x FROM m)
SELECT family, CAST(x + 1 AS INTEGER) AS ordinal, start + to_days(CAST(x * n AS INTEGER)) - INTERVAL 345 MINUTE AS utc FROM i WHERE start + to_days(CAST(x * n AS INTEGER)) <= d + INTERVAL 30 DAY"""
)
def recur_window(spark: SparkSession, d: str) -> DataFrame:
    """Rules of Kathmandu that began in 1900, over the 30 days from an order's date: numbers count from the start, candidates are those of the window."""
    start = F.timestamp_add("DAY", (F.col("o_orderkey") % 1000).cast("int"), F.lit("1900-01-01 09:30:00").cast("timestamp_ntz"))
    begin = F.col("o_orderdate").cast("date").cast("timestamp_ntz")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("family"), start.alias("local"), F.lit("Asia/Kathmandu").alias("zone"), F.lit("DAILY").alias("freq"), (1 + F.col("o_custkey") % 7).cast("int").alias("interval"), begin.alias("begin"))
    return recurrence.expand(rows, F.timestamp_add("DAY", F.lit(30), "begin"), from_local=F.col("begin")).select("family", "ordinal", "utc")


@query(
    """WITH m AS (SELECT o_orderkey family, 1 + o_custkey % 2 n, CASE o_custkey % 3 WHEN 0 THEN TIMESTAMP '2024-03-01 02:30:00' WHEN 1 THEN TIMESTAMP '2024-10-25 01:30:00' ELSE TIMESTAMP '2024-03-03 23:45:00' END + to_days(CAST(o_orderkey % 12 AS INTEGER)) start FROM orders),
c AS (SELECT family, x, start + to_days(CAST(x * n AS INTEGER)) l FROM (SELECT *, unnest(range(20)) x FROM m)),
f AS (SELECT family, l, l + to_hours(CASE WHEN l >= TIMESTAMP '2024-03-10 03:00:00' AND l < TIMESTAMP '2024-11-03 02:00:00' THEN 4 ELSE 5 END) utc FROM c WHERE x = 0 OR NOT (l >= TIMESTAMP '2024-03-10 02:00:00' AND l < TIMESTAMP '2024-03-10 03:00:00'))
SELECT family, ordinal, l AS "local", utc FROM (SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY l) AS INTEGER) ordinal, l, utc FROM f) WHERE ordinal <= 9"""
)
def recur_daily_dst(spark: SparkSession, d: str) -> DataFrame:
    """Daily rules of New York over both changes of the clock: a time that the zone skips is no occurrence and takes no number."""
    k = F.col("o_custkey") % 3
    first = F.when(k == 0, "2024-03-01 02:30:00").when(k == 1, "2024-10-25 01:30:00").otherwise("2024-03-03 23:45:00").cast("timestamp_ntz")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("family"), F.timestamp_add("DAY", (F.col("o_orderkey") % 12).cast("int"), first).alias("local"), F.lit("America/New_York").alias("zone"), F.lit("DAILY").alias("freq"), (1 + F.col("o_custkey") % 2).cast("int").alias("interval"), F.lit(9).alias("count"))
    return recurrence.expand(rows, F.timestamp_add("DAY", F.lit(60), "local"))


@query(
    f"""WITH m AS (SELECT o_orderkey family, {_START} start, 1 + o_custkey % 2 n, CASE o_custkey % 3 WHEN 0 THEN [6, 1] WHEN 1 THEN [0, 2, 4] ELSE [isodow(o_orderdate) - 1] END wd, CASE WHEN o_custkey % 3 = 0 THEN 6 ELSE 0 END w FROM orders),
c AS (SELECT family, x, start + to_days(CAST(x AS INTEGER)) utc, n, wd, (isodow(start) - 1 - w + 7) % 7 off FROM (SELECT *, unnest(range(57)) x FROM m)),
f AS (SELECT family, utc FROM c WHERE x = 0 OR ((x + off) // 7 % n = 0 AND list_contains(wd, isodow(utc) - 1)))
SELECT family, ordinal, utc FROM (SELECT family, CAST(row_number() OVER (PARTITION BY family ORDER BY utc) AS INTEGER) ordinal, utc FROM f) WHERE ordinal <= 6"""
)
def recur_weekly(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 3
    days = F.when(k == 0, F.array(F.lit(6), F.lit(1))).when(k == 1, F.array(F.lit(0), F.lit(2), F.lit(4)))
    masters = _masters(spark, d).select("family", "local", "zone", F.lit("WEEKLY").alias("freq"), (1 + F.col("k") % 2).cast("int").alias("interval"), days.alias("byday"), F.when(k == 0, 6).otherwise(0).alias("wkst"), F.lit(6).alias("count"))
    return recurrence.expand(masters, F.timestamp_add("DAY", F.lit(56), "local")).select("family", "ordinal", "utc")


@query(f"SELECT o_orderkey AS family, CAST(x + 1 AS INTEGER) AS ordinal, {_START} + to_days(CAST(x * 3 AS INTEGER)) AS utc FROM (SELECT *, unnest(range(o_custkey % 20 // 3 + 1)) x FROM orders)")
def recur_until(spark: SparkSession, d: str) -> DataFrame:
    """The end is included."""
    masters = _masters(spark, d).select("family", "local", "zone", F.lit("DAILY").alias("freq"), F.lit(3).alias("interval"), F.timestamp_add("DAY", F.col("k") % 20, "local").alias("until_utc"))
    return recurrence.expand(masters, F.timestamp_add("DAY", F.lit(60), "local")).select("family", "ordinal", "utc")


_LINES = f"ex AS (SELECT DISTINCT l_orderkey AS family, {_START} + to_days(CAST(l_linenumber AS INTEGER)) AS utc FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'), ov AS (SELECT l_orderkey AS family, {_START} + to_days(CAST(l_linenumber AS INTEGER)) AS utc, max(l_linestatus = 'F') AS cancelled FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2)"


def _lines(spark: SparkSession, d: str, flag: str) -> DataFrame:
    """Lines of an order name instances of its family."""
    lines = table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("family"), F.col("l_linenumber").alias("n"), (F.col("l_linestatus") == "F").alias("cancelled"))
    return lines.join(_masters(spark, d).select("family", "local"), "family").groupBy("family", F.timestamp_add("DAY", F.col("n"), "local").alias("utc")).agg(F.max("cancelled").alias("cancelled"))


@query(f"WITH {_DAILY}, {_LINES} SELECT * FROM occ WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.family = occ.family AND ex.utc = occ.utc)")
def exdate_anti(spark: SparkSession, d: str) -> DataFrame:
    return recurrence.without(_daily(spark, d), _lines(spark, d, "N"))


@query(f"WITH {_DAILY}, {_LINES} SELECT occ.family, ordinal, CASE WHEN cancelled IS NULL THEN occ.utc ELSE occ.utc + INTERVAL 2 HOUR END AS starts, cancelled IS NOT NULL AS overridden FROM occ LEFT JOIN ov ON occ.family = ov.family AND occ.utc = ov.utc WHERE NOT coalesce(cancelled, false)")
def override_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Overridden instances begin two hours later; cancelled ones are gone."""
    found = recurrence.resolve(_daily(spark, d), _lines(spark, d, "R")).where(~F.coalesce("cancelled", F.lit(False)))
    moved = F.col("cancelled").isNotNull()
    return found.select("family", "ordinal", F.when(moved, F.timestamp_add("HOUR", F.lit(2), "utc")).otherwise(F.col("utc")).alias("starts"), moved.alias("overridden"))


@query(f"WITH {_DAILY}, {_LINES} SELECT family, utc FROM ov WHERE NOT EXISTS (SELECT 1 FROM occ WHERE ov.family = occ.family AND ov.utc = occ.utc)")
def orphan_overrides(spark: SparkSession, d: str) -> DataFrame:
    return recurrence.orphans(_lines(spark, d, "R"), _daily(spark, d)).select("family", "utc")


@query(f"WITH {_LINES} SELECT family, utc FROM ov WHERE EXISTS (SELECT 1 FROM ex WHERE ex.family = ov.family AND ex.utc = ov.utc)")
def exdate_override_collision(spark: SparkSession, d: str) -> DataFrame:
    return recurrence.collisions(_lines(spark, d, "R"), _lines(spark, d, "N")).select("family", "utc")


@query(f"WITH {_DAILY}, {_LINES} SELECT occ.family, ordinal, occ.utc FROM occ JOIN ov ON occ.family = ov.family AND occ.utc = ov.utc WHERE cancelled")
def cancellations(spark: SparkSession, d: str) -> DataFrame:
    return recurrence.resolve(_daily(spark, d), _lines(spark, d, "R")).where("cancelled").select("family", "ordinal", "utc")


_RECORDS = "r AS (SELECT user_id AS uid, event_id AS ord, event_id % 3 AS source, sha256(event_type || ':' || (event_id % 4)) AS fingerprint, event_id % 5 = 0 AS is_override, CAST(ts AS DATE) AS identity FROM events)"


def _records(spark: SparkSession, d: str) -> DataFrame:
    fingerprint = F.sha2(F.concat("event_type", F.lit(":"), (F.col("event_id") % 4).cast("string")), 256)
    return table(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("ord"), (F.col("event_id") % 3).alias("source"), fingerprint.alias("fingerprint"), (F.col("event_id") % 5 == 0).alias("is_override"), F.to_date("ts").alias("identity"))


@query(f"WITH {_RECORDS} SELECT uid, fingerprint, min(ord) AS canonical, string_agg(CAST(source AS VARCHAR), ',' ORDER BY ord) AS sources, count(*) - 1 AS duplicates FROM r GROUP BY 1, 2")
def dedup_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    found = families.dedup(_records(spark, d))
    return found.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


@query(f"WITH {_RECORDS}, x AS (SELECT uid, source, string_agg(DISTINCT fingerprint, ',' ORDER BY fingerprint) f FROM r GROUP BY 1, 2) SELECT uid, count(DISTINCT f) AS snapshots FROM x GROUP BY 1 HAVING count(DISTINCT f) > 1")
def snapshot_conflict(spark: SparkSession, d: str) -> DataFrame:
    return families.snapshot_conflicts(_records(spark, d))


@query(
    f"""WITH {_RECORDS}, g AS (SELECT uid * 100 + ord % 100 AS uid, is_override, identity FROM r), m AS (SELECT uid, count(*) FILTER (WHERE NOT is_override) masters FROM g GROUP BY 1), t AS (SELECT uid, max(n) most FROM (SELECT uid, identity, count(*) n FROM g WHERE is_override GROUP BY 1, 2) GROUP BY 1)
SELECT uid, CASE WHEN masters = 0 THEN 'orphan_override' WHEN masters > 1 THEN 'conflicting_masters' ELSE 'conflicting_overrides' END AS code FROM m LEFT JOIN t USING (uid) WHERE masters <> 1 OR most > 1"""
)
def family_errors(spark: SparkSession, d: str) -> DataFrame:
    return families.cardinality_errors(_records(spark, d).withColumn("uid", F.col("uid") * 100 + F.col("ord") % 100))


@query(f"WITH {_RECORDS} SELECT uid, ord, min(ord) OVER (PARTITION BY uid) AS family_order FROM r")
def family_order(spark: SparkSession, d: str) -> DataFrame:
    return families.first_seen(_records(spark, d)).select("uid", "ord", "family_order")


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.to_date("ts").alias("date")).distinct()


@query("SELECT date, epoch(date + INTERVAL 14 HOUR)::BIGINT s, epoch(date + INTERVAL 22 HOUR)::BIGINT e FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events) WHERE isodow(date) <= 5")
def working_windows(spark: SparkSession, d: str) -> DataFrame:
    """Nine to five in New York on the working days that have events."""
    return scheduling.working_windows(_dates(spark, d), [0, 1, 2, 3, 4], "09:00", "17:00", "America/New_York").select("date", "s", "e")


def _schedule(spark: SparkSession, d: str) -> DataFrame:
    """Split shifts from Monday to Friday; dates of three hundred events or fewer close, every seventh of the month has its own windows."""
    span = lambda lo, hi: F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
    split = F.array(span(540, 600), span(600, 720), span(780, 1020))
    weekly = spark.range(5).select(F.col("id").cast("int").alias("weekday"), split.alias("windows"))
    busy = table(spark, d, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    own = busy.where((F.dayofmonth("date") % 7 == 0) | (F.col("n") % 5 == 0)).select("date", F.when(F.dayofmonth("date") % 7 == 0, F.array(span(600, 660), span(720, 1440))).otherwise(none).alias("windows"))
    return scheduling.effective(_dates(spark, d), weekly, own)


_SCHEDULE = """n AS (SELECT CAST(ts AS DATE) AS date, count(*) n FROM events GROUP BY 1), sched AS (SELECT date, isodow(date) - 1 weekday, CASE WHEN day(date) % 7 = 0 THEN [[600, 660], [720, 1440]] WHEN n % 5 = 0 THEN [] WHEN isodow(date) <= 5 THEN [[540, 600], [600, 720], [780, 1020]] ELSE [] END windows, day(date) % 7 = 0 OR n % 5 = 0 applied FROM n),
flat AS (SELECT date, epoch(date)::BIGINT + w[1] * 60 s, epoch(date)::BIGINT + w[2] * 60 e FROM (SELECT date, unnest(windows) w FROM sched))"""


@query(f"WITH {_SCHEDULE} SELECT date, CAST(weekday AS INTEGER) AS weekday, applied AS applied_exception, array_to_string(list_transform(windows, lambda w: w[1] || '-' || w[2]), ',') AS windows FROM sched")
def schedule_effective(spark: SparkSession, d: str) -> DataFrame:
    return _schedule(spark, d).withColumn("windows", F.array_join(F.transform("windows", lambda w: F.concat_ws("-", w["lo"], w["hi"])), ","))


@query(f"WITH {_SCHEDULE} {islands_sql('SELECT date, s, e FROM flat', 'date')}")
def schedule_merge(spark: SparkSession, d: str) -> DataFrame:
    return scheduling.merge_windows(_schedule(spark, d), "UTC").select("date", "s", "e")


@query(f"WITH {EVENTS} SELECT id, owner, s, e FROM (SELECT *, max(e) OVER (PARTITION BY owner ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) r FROM ev WHERE kind = 'purchase') WHERE s < r")
def schedule_overlap_guard(spark: SparkSession, d: str) -> DataFrame:
    return scheduling.overlapping_windows(intervals(spark, d).where("kind = 'purchase'").select("id", "owner", "s", "e"), "owner")


_TEAM_WINDOWS = "w AS (SELECT team, date, s, e FROM (SELECT DISTINCT team FROM ev), (SELECT date, epoch(date)::BIGINT + 32400 s, epoch(date)::BIGINT + 61200 e FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)))"


#: How long each team's windows are.
_SHIFT = (8 * 3600,)


def _team_windows(spark: SparkSession, d: str) -> DataFrame:
    """Nine to five of each team on each date that has events."""
    day = F.unix_date("date").cast("bigint") * times.DAY
    return intervals(spark, d).select("team").distinct().join(F.broadcast(_dates(spark, d)), F.lit(True)).select("team", "date", (day + 32400).alias("s"), (day + 61200).alias("e"))


def _team_busy(kinds: str = "kind IS NOT NULL") -> str:
    return f"held AS (SELECT ev.team, date, id, greatest(ev.s, w.s) s, least(ev.e, w.e) e FROM ev JOIN w ON ev.team = w.team AND ev.s < w.e AND ev.e > w.s AND ev.e > ev.s WHERE {kinds}), busy AS ({islands_sql('SELECT team, date, s, e FROM held', 'team, date')})"


@query(f"WITH {EVENTS}, {_TEAM_WINDOWS}, {_team_busy()}, g AS ({gaps_sql('SELECT * FROM w', 'SELECT * FROM busy', 'team, date', 600)}) SELECT *, e - s AS seconds FROM g")
def complement_gaps(spark: SparkSession, d: str) -> DataFrame:
    return iv.gaps(_team_windows(spark, d), intervals(spark, d), "date", ["team"], 600, lengths=_SHIFT)


@query(
    f"""WITH {EVENTS}, {_TEAM_WINDOWS}, {_team_busy()}, g AS ({gaps_sql('SELECT * FROM w', 'SELECT * FROM busy', 'team, date', 600)})
SELECT g.team, g.date, g.s, g.e, g.e - g.s AS seconds, coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FROM held h WHERE h.team = g.team AND h.date = g.date AND h.e = g.s), '') AS before,
coalesce((SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FROM held h WHERE h.team = g.team AND h.date = g.date AND h.s = g.e), '') AS after FROM g"""
)
def gap_witnesses(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d).withColumn("id", F.col("id").cast("string"))
    found = iv.witnessed_gaps(_team_windows(spark, d), rows, "date", ["team"], minimum=600, lengths=_SHIFT)
    return found.withColumns({c: F.array_join(c, ",") for c in ("before", "after")})


@query(
    f"""WITH {EVENTS}, {_TEAM_WINDOWS}, {_team_busy()}, g AS ({gaps_sql('SELECT * FROM w', 'SELECT * FROM busy', 'team, date', 600)})
SELECT date, count(*) AS shown, sum(e - s)::BIGINT AS shown_seconds, (SELECT count(*) FROM g) AS gaps, (SELECT sum(e - s)::BIGINT FROM g) AS gap_seconds FROM g GROUP BY date"""
)
def filter_gap_dates(spark: SparkSession, d: str) -> DataFrame:
    """What each choice of the availability date filter shows, beside the totals, which stay unfiltered."""
    found = iv.gaps(_team_windows(spark, d), intervals(spark, d), "date", ["team"], 600, lengths=_SHIFT)
    shown = found.groupBy("date").agg(F.count("*").alias("shown"), F.sum("seconds").alias("shown_seconds"))
    total = shown.agg(F.sum("shown").alias("gaps"), F.sum("shown_seconds").alias("gap_seconds"))
    return shown.join(F.broadcast(total), F.lit(True))


@query(f"WITH {EVENTS}, {_TEAM_WINDOWS.replace('FROM events)))', 'FROM events) WHERE isodow(date) <= 5))')}, {_team_busy(kinds=chr(107) + 'ind NOT IN ($$view$$, $$error$$)')}, g AS ({gaps_sql('SELECT * FROM w', 'SELECT * FROM busy', 'team, date', 1800)}) SELECT *, e - s AS seconds FROM g")
def availability_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of half an hour in working windows beside what is opaque and not cancelled."""
    opaque = intervals(spark, d).where(~F.col("kind").isin("view", "error"))
    return iv.gaps(_team_windows(spark, d).where(times.weekday("date") < 5), opaque, "date", ["team"], 1800, lengths=_SHIFT)


@query(
    f"""WITH {EVENTS}, {_TEAM_WINDOWS}, {_team_busy()}, g AS ({gaps_sql('SELECT * FROM w', 'SELECT * FROM busy', 'team, date', 1)}), f AS (SELECT team, date, sum(e - s) free, coalesce(sum(e - s) FILTER (WHERE e - s >= 1800), 0) cand FROM g GROUP BY 1, 2), o AS (SELECT team, date, sum(e - s) occ FROM busy GROUP BY 1, 2),
x AS (SELECT team, date, CASE WHEN isodow(date) <= 5 THEN 28800 ELSE 0 END wk, coalesce(occ, 0) occ, coalesce(free, 0) free, coalesce(cand, 0) cand, team <> 3 complete FROM w LEFT JOIN f USING (team, date) LEFT JOIN o USING (team, date))
SELECT team, date, wk::BIGINT AS working_seconds, CASE WHEN wk > 0 THEN occ ELSE 0 END::BIGINT AS occupied_seconds, CASE WHEN complete THEN CASE WHEN wk > 0 THEN free ELSE 0 END END::BIGINT AS free_seconds, CASE WHEN complete THEN CASE WHEN wk > 0 THEN cand ELSE 0 END END::BIGINT AS candidate_seconds, complete,
CASE WHEN wk = 0 THEN 'closed' WHEN NOT complete THEN 'incomplete' WHEN free = 0 THEN 'fully_booked' WHEN cand >= 1800 THEN 'available' ELSE 'below_minimum' END AS status FROM x"""
)
def schedule_days(spark: SparkSession, d: str) -> DataFrame:
    """A team's days explained; team 3 counts as incompletely read, so its free time is unknown."""
    windows, rows = _team_windows(spark, d), intervals(spark, d)
    open_ = windows.where(times.weekday("date") < 5)
    keys = ["team", "date"]
    occupied = iv.union_seconds(iv.assign(rows.select("team", "s", "e"), open_, ["team"], _SHIFT), keys).withColumnRenamed("seconds", "occ")
    free = iv.gaps(open_, rows, "date", ["team"], 1, lengths=_SHIFT).groupBy(*keys).agg(F.sum("seconds").alias("free"), F.sum(F.when(F.col("seconds") >= 1800, F.col("seconds"))).alias("cand"))
    zero = F.lit(0).cast("bigint")
    days = windows.join(occupied, keys, "left").join(free, keys, "left").withColumn("complete", F.col("team") != 3)
    known = lambda c: F.when(F.col("complete"), F.coalesce(c, zero))
    days = days.select(*keys, F.when(times.weekday("date") < 5, F.col("e") - F.col("s")).otherwise(zero).alias("working_seconds"), F.coalesce("occ", zero).alias("occupied_seconds"), known("free").alias("free_seconds"), known("cand").alias("candidate_seconds"), "complete")
    return scheduling.day_status(days, 1800)


_SHIFTS = "z AS (SELECT min(s) // 86400 * 86400 lo, max(s) // 86400 * 86400 + 86400 hi FROM ev), d AS (SELECT DATE '1970-01-01' + CAST(k AS INTEGER) AS date FROM (SELECT unnest(range(lo // 86400 - 1, hi // 86400)) k FROM z)), sh AS (SELECT team, greatest(epoch(date)::BIGINT + 22 * 3600 + 18000, lo) s, least(epoch(date)::BIGINT + 30 * 3600 + 18000, hi) e FROM (SELECT DISTINCT team FROM ev), d, z WHERE isodow(date) - 1 <= 2 + team % 3)"


@query(f"WITH {EVENTS}, {_SHIFTS} {islands_sql('SELECT team AS pid, s, e FROM sh', 'pid')}")
def overnight_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Ten at night to six in New York, from Monday for three to five days, through all days that have events."""
    rows = intervals(spark, d)
    teams = rows.select(F.col("team").alias("pid")).distinct()
    days = F.explode(F.sequence(F.lit(0), (2 + F.col("pid") % 3).cast("int")))
    people = teams.select("pid", F.lit("America/New_York").alias("zone"), days.alias("weekday"), F.lit(22 * 60).alias("lo"), F.lit(6 * 60).alias("hi"))
    first, last = (x // times.DAY for x in rows.agg(F.min("s"), F.max("s")).first())
    dates = spark.range(first - 1, last + 1).select(F.date_from_unix_date(F.col("id").cast("int")).alias("date"))
    return scheduling.shifts(people, dates, first * times.DAY, (last + 1) * times.DAY)


@query(
    f"""WITH {EVENTS}, {_TEAM_WINDOWS}, cov AS (SELECT team, min(s) // 86400 * 86400 lo, max(s) // 86400 * 86400 hi FROM ev GROUP BY 1),
k AS (SELECT w.team, greatest(w.s, lo) s, least(w.e, hi) e FROM w JOIN cov USING (team) WHERE greatest(w.s, lo) < least(w.e, hi)), b AS ({islands_sql('SELECT team, s, e FROM ev WHERE kind IN ($$click$$, $$purchase$$)', 'team')}),
free AS (SELECT team, s, e FROM ({gaps_sql('SELECT team, s w, s, e FROM k', 'SELECT k.team, k.s w, greatest(b.s, k.s) s, least(b.e, k.e) e FROM k JOIN b ON k.team = b.team AND b.s < k.e AND b.e > k.s', 'team, w')})),
c AS ({level_sql('SELECT team % 4 g, s, e FROM free', 'g')}), x AS ({islands_sql('SELECT g, s, e FROM c WHERE n >= 4 AND e IS NOT NULL', 'g')})
SELECT g, s, e, e - s AS seconds, e - 900 AS latest_start FROM x WHERE e - s >= 900"""
)
def shared_windows(spark: SparkSession, d: str) -> DataFrame:
    """Where all four participants of a group are known to work and to be free, for a quarter of an hour or more."""
    rows = intervals(spark, d)
    day = F.floor(F.col("s") / times.DAY) * times.DAY
    coverage = rows.groupBy("team").agg(F.min(day).alias("s"), F.max(day).alias("e"))
    known = iv.intersect(_team_windows(spark, d), coverage, ["team"])
    free = iv.subtract(known, rows.where("kind in ('click', 'purchase')"), ["team"])
    found = iv.common(free.withColumn("g", F.col("team") % 4), "team", 4, ["g"]).withColumn("seconds", F.col("e") - F.col("s")).where("seconds >= 900")
    return found.withColumn("latest_start", F.col("e") - 900)


_PERIODS = f"per AS ({islands_sql(f'SELECT owner, greatest(s, {LO}) s, least(e, {HI}) e FROM ev WHERE kind NOT IN ($$view$$, $$error$$)', 'owner')})"


def _periods(spark: SparkSession, d: str) -> DataFrame:
    return freebusy.periods(intervals(spark, d).where(~F.col("kind").isin("view", "error")), LO, HI, ["owner"])


@query(f"WITH {EVENTS}, {_PERIODS} SELECT * FROM per")
def freebusy_periods(spark: SparkSession, d: str) -> DataFrame:
    return _periods(spark, d)


@query(f"WITH {EVENTS}, {_PERIODS} SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY s) AS INTEGER) AS line_no, 'FREEBUSY;FBTYPE=BUSY:' || strftime(make_timestamp(s * 1000000), '%Y%m%dT%H%M%SZ') || '/' || strftime(make_timestamp(e * 1000000), '%Y%m%dT%H%M%SZ') AS line FROM per")
def freebusy_lines(spark: SparkSession, d: str) -> DataFrame:
    return freebusy.lines(_periods(spark, d), ["owner"])


@query(
    r"""WITH RECURSIVE l AS (SELECT doc_id, 'DESCRIPTION:' || regexp_replace(text, '[\r\n]+', '\\n', 'g') line FROM documents),
p AS (SELECT doc_id, line rest, 75 room, 0 n, '' part FROM l UNION ALL
SELECT doc_id, substr(rest, k + 1), 74, n + 1, left(rest, k) FROM (SELECT *, list_max(list_filter(range(1, 76), lambda x: strlen(left(rest, x)) <= room))::INTEGER k FROM p WHERE rest <> ''))
SELECT l.doc_id, f.folded FROM l LEFT JOIN (SELECT doc_id, string_agg(part, chr(13) || chr(10) || ' ' ORDER BY n) folded FROM p WHERE n > 0 GROUP BY doc_id) f USING (doc_id)"""
)
def ics_fold(spark: SparkSession, d: str) -> DataFrame:
    """``documents`` as folded content lines (tests compare with a byte-wise fold)."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("DESCRIPTION:"), F.regexp_replace("text", "[\\r\\n]+", "\\\\n")).alias("line"))
    return rows.select("doc_id", freebusy.fold("line").alias("folded"))
