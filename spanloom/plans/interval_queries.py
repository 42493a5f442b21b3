"""Queries over ``events`` as intervals: scalars, interval algebra, rollups."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..operators import intervals as iv
from ..operators.rollup import daily, day_spine
from .registry import EVENTS, HI, LO, gaps_sql, intervals, islands_sql, level_sql, query, table

_FIRST, _LAST = datetime.date(2024, 1, 5), datetime.date(2024, 1, 20)


def _spine(rows: DataFrame, zone: str = "UTC") -> DataFrame:
    """The days of a zone from the first to the last that ``rows`` meet."""
    date = lambda t: F.to_date(times.from_utc(times.instant(t), zone))
    first, last = rows.agg(F.min(date(F.col("s"))), F.max(date(F.greatest("s", F.col("e") - 1)))).first()
    return day_spine(rows.sparkSession, first, last + datetime.timedelta(1), zone)


def _spine_sql(offset: int) -> str:
    return f"k AS (SELECT unnest(range((SELECT min(s) - {offset} FROM ev) // 86400, (SELECT max(greatest(s, e - 1)) - {offset} FROM ev) // 86400 + 1)) k), d AS (SELECT DATE '1970-01-01' + CAST(k AS INTEGER) AS date, k * 86400 + {offset} lo, k * 86400 + {offset} + 86400 hi FROM k)"


@query(
    f"""WITH {EVENTS}, r AS (SELECT id, CASE WHEN id % 4 = 2 AND id % 3 = 0 THEN 'America/New_York' WHEN id % 7 = 3 THEN 'America/New_York' END tz, CASE id % 6 WHEN 0 THEN strftime(make_timestamp(s * 1000000), '%Y%m%d') WHEN 1 THEN strftime(make_timestamp(s * 1000000), '%Y%m%dT%H%M%SZ')
WHEN 5 THEN strftime(make_timestamp(s * 1000000), '%Y-%m-%d') WHEN 4 THEN '20241301T000000' ELSE strftime(make_timestamp(s * 1000000), '%Y%m%dT%H%M%S') END raw FROM ev),
k AS (SELECT id, raw, CASE WHEN id % 6 = 0 AND tz IS NULL THEN 'date' WHEN id % 6 = 1 AND tz IS NULL THEN 'utc' WHEN id % 6 IN (2, 3) THEN CASE WHEN tz IS NULL THEN 'floating' ELSE 'zoned' END END kind FROM r)
SELECT id, kind, CASE kind WHEN 'date' THEN strptime(raw, '%Y%m%d') WHEN 'utc' THEN strptime(raw, '%Y%m%dT%H%M%SZ') WHEN 'floating' THEN strptime(raw, '%Y%m%dT%H%M%S') WHEN 'zoned' THEN strptime(raw, '%Y%m%dT%H%M%S') END "value" FROM k"""
)
def decode_time(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d)
    at = times.instant("s").cast("timestamp")
    k = F.col("id") % 6
    raw = F.when(k == 0, F.date_format(at, "yyyyMMdd")).when(k == 1, times.basic("at")).when(k == 5, F.date_format(at, "yyyy-MM-dd")).when(k == 4, "20241301T000000").otherwise(F.date_format(at, "yyyyMMdd'T'HHmmss"))
    tz = F.when((F.col("id") % 4 == 2) & (F.col("id") % 3 == 0) | (F.col("id") % 7 == 3), "America/New_York")
    rows = rows.withColumn("at", times.instant("s")).select("id", raw.alias("raw"), tz.alias("tz"))
    kind, value = times.decode_time("raw", "tz")
    return rows.select("id", kind.alias("kind"), value.alias("value"))


@query(f"WITH {EVENTS} SELECT id, strftime(make_timestamp(s * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS starts, strftime(make_timestamp(e * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS ends FROM ev")
def iso_text(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("id", times.iso(times.instant("s")).alias("starts"), times.iso(times.instant("e")).alias("ends"))


@query(
    f"""WITH {EVENTS}, r AS (SELECT id, (e - s) % 60 x, CASE id % 8 WHEN 0 THEN 'P' || (id % 14) || 'W' WHEN 1 THEN 'P' || (id % 100) || 'D' WHEN 2 THEN 'PT' || ((e - s) % 60) || 'M' WHEN 3 THEN 'P1DT2H' || ((e - s) % 60) || 'M4S' WHEN 4 THEN 'P1W1D' WHEN 5 THEN 'PT' || ((e - s) % 60) || 'H5S' WHEN 6 THEN 'PT' || ((e - s) % 60) || 'S' ELSE 'T5M' END raw FROM ev),
v AS (SELECT id, CASE id % 8 WHEN 0 THEN (id % 14) * 604800 WHEN 1 THEN (id % 100) * 86400 WHEN 2 THEN x * 60 WHEN 3 THEN 86400 + 7200 + x * 60 + 4 WHEN 5 THEN x * 3600 + 5 WHEN 6 THEN x END secs FROM r)
SELECT id, CASE WHEN secs > 0 AND secs <= 7776000 THEN secs END::BIGINT AS seconds FROM v"""
)
def duration_parse(spark: SparkSession, d: str) -> DataFrame:
    rows, k, x = intervals(spark, d), F.col("id") % 8, ((F.col("e") - F.col("s")) % 60).cast("string")
    text = lambda *p: F.concat(*(F.lit(v) if isinstance(v, str) else v for v in p))
    raw = F.when(k == 0, text("P", (F.col("id") % 14).cast("string"), "W")).when(k == 1, text("P", (F.col("id") % 100).cast("string"), "D")).when(k == 2, text("PT", x, "M")).when(k == 3, text("P1DT2H", x, "M4S")).when(k == 4, "P1W1D").when(k == 5, text("PT", x, "H5S")).when(k == 6, text("PT", x, "S")).otherwise("T5M")
    return rows.select("id", raw.alias("raw")).select("id", times.duration("raw").alias("seconds"))


@query(f"WITH {EVENTS} SELECT id, make_timestamp((s + 18000) * 1000000) AS new_york, make_timestamp((s - 20700) * 1000000) AS kathmandu FROM ev")
def local_to_utc(spark: SparkSession, d: str) -> DataFrame:
    at = times.instant("s")
    return intervals(spark, d).select("id", times.to_utc(at, "America/New_York").alias("new_york"), times.to_utc(at, "Asia/Kathmandu").alias("kathmandu"))


@query(f"WITH {EVENTS} SELECT id, strftime(make_timestamp((s - 18000) * 1000000), '%Y-%m-%dT%H:%M:%S-05:00') AS new_york, strftime(make_timestamp((s + 20700) * 1000000), '%Y-%m-%dT%H:%M:%S+05:45') AS kathmandu FROM ev")
def local_projection(spark: SparkSession, d: str) -> DataFrame:
    at = times.instant("s")
    return intervals(spark, d).select("id", times.local_text(at, "America/New_York").alias("new_york"), times.local_text(at, "Asia/Kathmandu").alias("kathmandu"))


@query(
    f"""WITH {EVENTS}, r AS (SELECT id, id % 4 k, s % 1800 x FROM ev)
SELECT id, CASE k WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END::INTEGER AS instants,
CASE k WHEN 2 THEN epoch(TIMESTAMP '2026-03-08 08:00:00')::BIGINT + x WHEN 3 THEN epoch(TIMESTAMP '2026-06-01 16:00:00')::BIGINT + x END AS at,
CASE k WHEN 0 THEN 'Nonexistent' WHEN 1 THEN 'Ambiguous' END AS error FROM r"""
)
def strict_boundary(spark: SparkSession, d: str) -> DataFrame:
    """Civil times of New York in a gap, in a fold, and after either."""
    k = F.col("id") % 4
    base = F.when(k == 0, F.lit("2026-03-08 02:00:00")).when(k == 1, "2026-11-01 01:00:00").when(k == 2, "2026-03-08 04:00:00").otherwise("2026-06-01 12:00:00")
    rows = intervals(spark, d).select("id", times.instant(times.seconds(base.cast("timestamp_ntz")) + F.col("s") % 1800).alias("local"))
    at, error = times.strict("local", "America/New_York")
    return rows.select("id", F.size(times.boundaries("local", "America/New_York")).alias("instants"), at.alias("at"), error.alias("error"))


@query(f"WITH {EVENTS} SELECT id, owner, s, e FROM ev WHERE kind NOT IN ('view', 'error')")
def filter_opaque(spark: SparkSession, d: str) -> DataFrame:
    """Transparent (view) and cancelled (error) entries occupy nothing."""
    return intervals(spark, d).where(~F.col("kind").isin("view", "error")).select("id", "owner", "s", "e")


@query(f"WITH {EVENTS} SELECT id, owner, greatest(s, {LO}) s, least(e, {HI}) e FROM ev WHERE greatest(s, {LO}) < least(e, {HI}) OR (s = e AND s >= {LO} AND s < {HI})")
def clip_timed(spark: SparkSession, d: str) -> DataFrame:
    return iv.clip(intervals(spark, d), LO, HI).select("id", "owner", "s", "e")


@query(
    """WITH a AS (SELECT o_orderkey id, CAST(o_orderdate AS DATE) ds, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER) de FROM orders)
SELECT id, greatest(ds, DATE '1996-01-01') ds, least(de, DATE '1999-01-01') de FROM a WHERE greatest(ds, DATE '1996-01-01') < least(de, DATE '1999-01-01')"""
)
def clip_all_day(spark: SparkSession, d: str) -> DataFrame:
    ds = F.col("o_orderdate").cast("date")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), ds.alias("ds"), F.date_add(ds, (F.col("o_orderkey") % 9).cast("int")).alias("de"))
    lo, hi = (F.lit(datetime.date(y, 1, 1)) for y in (1996, 1999))
    return rows.select("id", F.greatest("ds", lo).alias("ds"), F.least("de", hi).alias("de")).where("ds < de")


@query(
    f"""WITH {EVENTS}, b AS (SELECT team, s, e FROM ev WHERE kind NOT IN ('view', 'error', 'signup')
UNION ALL SELECT team, s // 86400 * 86400, s // 86400 * 86400 + 86400 FROM ev WHERE kind = 'signup' AND team % 2 = 0), i AS ({islands_sql("SELECT team, s, e FROM b", "team")})
SELECT team, sum(e - s)::BIGINT AS seconds FROM i GROUP BY team"""
)
def all_day_policy(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups are all-day entries; even teams let them block their date, the others ignore them."""
    rows = intervals(spark, d)
    day = F.floor(F.col("s") / times.DAY) * times.DAY
    whole = rows.where("kind = 'signup' and team % 2 = 0").select("team", day.alias("s"), (day + times.DAY).alias("e"))
    timed = rows.where(~F.col("kind").isin("view", "error", "signup")).select("team", "s", "e")
    return iv.union_seconds(timed.unionByName(whole), ["team"])


@query(f"WITH {EVENTS} {islands_sql('SELECT owner, s, e FROM ev', 'owner')}")
def union_islands(spark: SparkSession, d: str) -> DataFrame:
    return iv.islands(intervals(spark, d), ["owner"])


@query(f"WITH {EVENTS} {islands_sql('SELECT s, e FROM ev', '')}")
def union_islands_global(spark: SparkSession, d: str) -> DataFrame:
    return iv.islands(intervals(spark, d))


@query(f"WITH {EVENTS}, i AS ({islands_sql('SELECT owner, s, e FROM ev', 'owner')}) SELECT owner, sum(e - s)::BIGINT AS seconds FROM i GROUP BY owner")
def union_seconds(spark: SparkSession, d: str) -> DataFrame:
    return iv.union_seconds(intervals(spark, d), ["owner"])


@query(
    f"""WITH {EVENTS}, i AS ({islands_sql('SELECT owner, s, e FROM ev', 'owner')})
SELECT i.owner, i.s, i.e, string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) AS members,
coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FILTER (WHERE ev.s = i.s), '') AS starting, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY CAST(id AS VARCHAR)) FILTER (WHERE ev.e = i.e), '') AS ending
FROM i JOIN ev ON ev.owner = i.owner AND ev.s < i.e AND ev.e > i.s AND ev.e > ev.s GROUP BY ALL"""
)
def busy_blocks(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d).withColumn("id", F.col("id").cast("string"))
    return iv.blocks(rows, ["owner"]).withColumns({c: F.array_join(c, ",") for c in ("members", "starting", "ending")})


def _daily_sql(offset: int) -> str:
    return f"""WITH {EVENTS}, {_spine_sql(offset)},
t AS (SELECT DISTINCT team FROM ev), h AS (SELECT team, date, greatest(s, lo) s, least(e, hi) e FROM ev JOIN d ON s < hi AND e > lo AND e > s),
u AS (SELECT team, date, sum(e - s) secs FROM ({islands_sql('SELECT team, date, s, e FROM h', 'team, date')}) GROUP BY 1, 2),
c AS (SELECT team, date, count(*) n FROM ev JOIN d ON (s < hi AND e > lo AND e > s) OR (s = e AND s >= lo AND s < hi) GROUP BY 1, 2)
SELECT team, date, (hi - lo)::BIGINT AS day_seconds, coalesce(secs, 0)::BIGINT AS occupied_seconds, coalesce(n, 0)::BIGINT AS timed_occurrences, 0::BIGINT AS all_day_occurrences FROM t CROSS JOIN d LEFT JOIN u USING (team, date) LEFT JOIN c USING (team, date)"""


@query(_daily_sql(0))
def daily_occupancy(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d)
    return daily(rows, _spine(rows), ("team",))


@query(_daily_sql(18000))
def daily_occupancy_local(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d)
    return daily(rows, _spine(rows, "America/New_York"), ("team",))


#: 55 days, which bring the events over the change to summer time on 10 March 2024.
_TO_MARCH = 55 * times.DAY
_NY_SUMMER = "CASE WHEN {0} >= TIMESTAMP '2024-03-10 03:00:00' AND {0} < TIMESTAMP '2024-11-03 02:00:00' THEN 4 ELSE 5 END"


@query(
    f"""WITH ev AS (SELECT team, s + {_TO_MARCH} s, e + {_TO_MARCH} e FROM (WITH {EVENTS} SELECT * FROM ev)), k AS (SELECT unnest(range((SELECT min(s) - 18000 FROM ev) // 86400, (SELECT max(greatest(s, e - 1)) - 14400 FROM ev) // 86400 + 1)) k),
d AS (SELECT date, epoch(date)::BIGINT + 3600 * CASE WHEN date <= DATE '2024-03-10' THEN 5 ELSE 4 END lo, epoch(date)::BIGINT + 86400 + 3600 * CASE WHEN date < DATE '2024-03-10' THEN 5 ELSE 4 END hi FROM (SELECT DATE '1970-01-01' + CAST(k AS INTEGER) AS date FROM k)),
h AS (SELECT date, greatest(s, lo) s, least(e, hi) e FROM ev JOIN d ON s < hi AND e > lo AND e > s), u AS (SELECT date, sum(e - s) secs FROM ({islands_sql('SELECT date, s, e FROM h', 'date')}) GROUP BY 1),
c AS (SELECT date, count(*) n FROM ev JOIN d ON (s < hi AND e > lo AND e > s) OR (s = e AND s >= lo AND s < hi) GROUP BY 1)
SELECT date, (hi - lo)::BIGINT AS day_seconds, coalesce(secs, 0)::BIGINT AS occupied_seconds, coalesce(n, 0)::BIGINT AS timed_occurrences, 0::BIGINT AS all_day_occurrences FROM d LEFT JOIN u USING (date) LEFT JOIN c USING (date)"""
)
def daily_occupancy_dst(spark: SparkSession, d: str) -> DataFrame:
    """Days of New York in spring, one of which has 23 hours."""
    rows = intervals(spark, d).select("team", (F.col("s") + _TO_MARCH).alias("s"), (F.col("e") + _TO_MARCH).alias("e"))
    return daily(rows, _spine(rows, "America/New_York"))


@query(f"WITH {EVENTS}, l AS (SELECT id, make_timestamp((s + id % 366 * 86400) * 1000000) l FROM ev) SELECT id, l + to_hours({_NY_SUMMER.format('l')}) AS utc, NOT (l >= TIMESTAMP '2024-03-10 02:00:00' AND l < TIMESTAMP '2024-03-10 03:00:00') AS is_real FROM l")
def local_to_utc_dst(spark: SparkSession, d: str) -> DataFrame:
    """Civil times of New York through a year: the gap takes the offset before it, the fold its first instant."""
    at = intervals(spark, d).select("id", times.instant(F.col("s") + F.col("id") % 366 * times.DAY).alias("l"))
    return at.select("id", times.to_utc("l", "America/New_York").alias("utc"), times.exists("l", F.lit("America/New_York")).alias("is_real"))


@query(
    f"""WITH {EVENTS}, u AS (SELECT id, make_timestamp((s + id % 366 * 86400) * 1000000) u FROM ev), o AS (SELECT id, u, CASE WHEN u >= TIMESTAMP '2024-03-10 07:00:00' AND u < TIMESTAMP '2024-11-03 06:00:00' THEN 4 ELSE 5 END h FROM u)
SELECT id, strftime(u - to_hours(h), '%Y-%m-%dT%H:%M:%S') || '-0' || h || ':00' AS new_york FROM o"""
)
def local_projection_dst(spark: SparkSession, d: str) -> DataFrame:
    return intervals(spark, d).select("id", times.local_text(times.instant(F.col("s") + F.col("id") % 366 * times.DAY), "America/New_York").alias("new_york"))


@query(
    f"""WITH {EVENTS}, {_spine_sql(0)},
x AS (SELECT s, CASE WHEN id % 10 = 0 THEN s ELSE e END e FROM ev WHERE kind <> 'signup'),
h AS (SELECT date, greatest(s, lo) s, least(e, hi) e FROM x JOIN d ON s < hi AND e > lo AND e > s), u AS (SELECT date, sum(e - s) secs FROM ({islands_sql('SELECT date, s, e FROM h', 'date')}) GROUP BY 1),
c AS (SELECT date, count(*) n FROM x JOIN d ON (s < hi AND e > lo AND e > s) OR (s = e AND s >= lo AND s < hi) GROUP BY 1),
a AS (SELECT date, count(*) a FROM (SELECT s // 86400 * 86400 f, 1 + id % 3 n FROM ev WHERE kind = 'signup') y JOIN d ON lo >= f AND lo < f + n * 86400 GROUP BY 1)
SELECT date, 86400::BIGINT AS day_seconds, coalesce(secs, 0)::BIGINT AS occupied_seconds, coalesce(n, 0)::BIGINT AS timed_occurrences, coalesce(a, 0)::BIGINT AS all_day_occurrences FROM d LEFT JOIN u USING (date) LEFT JOIN c USING (date) LEFT JOIN a USING (date)"""
)
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """With points (every tenth event has no length) and all-day entries of one to three dates."""
    rows = intervals(spark, d)
    timed = rows.where("kind <> 'signup'").withColumn("e", F.when(F.col("id") % 10 == 0, F.col("s")).otherwise(F.col("e")))
    ds = F.to_date(times.instant("s"))
    all_day = rows.where("kind = 'signup'").select(ds.alias("ds"), F.date_add(ds, (1 + F.col("id") % 3).cast("int")).alias("de"))
    return daily(timed, _spine(intervals(spark, d)), (), all_day)


def _pairs_sql(by: str) -> str:
    return f"""SELECT l.{by}, l.id AS "left", r.id AS "right", greatest(l.s, r.s) s, least(l.e, r.e) e, least(l.e, r.e) - greatest(l.s, r.s) AS seconds FROM ev l JOIN ev r ON l.{by} = r.{by} AND l.s < r.e AND r.s < l.e AND l.e > l.s AND r.e > r.s AND (l.s, l.e, l.id) < (r.s, r.e, r.id)"""


@query(f"WITH {EVENTS} {_pairs_sql('owner')}")
def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return iv.overlap_pairs(intervals(spark, d), ["owner"])


@query(f"WITH {EVENTS} {_pairs_sql('team')}")
def overlap_pairs_global(spark: SparkSession, d: str) -> DataFrame:
    """The pairs of sixteen dense calendars."""
    return iv.overlap_pairs(intervals(spark, d), ["team"])


@query(f"""WITH {EVENTS}, p AS ({_pairs_sql('team')}) SELECT * FROM p ORDER BY seconds DESC, "left", "right" LIMIT 25""")
def topk_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return iv.longest_overlaps(intervals(spark, d), 25, ["team"])


def _nine_to_five(spark: SparkSession) -> DataFrame:
    return day_spine(spark, _FIRST, _LAST).select("date", (F.col("s") + 9 * 3600).alias("s"), (F.col("s") + 17 * 3600).alias("e"))


_ASSIGNED = f"""WITH {EVENTS}, w AS (SELECT DATE '2024-01-05' + CAST(k AS INTEGER) AS date, {LO} + k * 86400 + 32400 w_s, {LO} + k * 86400 + 61200 w_e FROM range(15) r(k))
SELECT id, owner, date, w_s, w_e, greatest(s, w_s) s, least(e, w_e) e FROM ev JOIN w ON s < w_e AND e > w_s AND e > s"""


@query(_ASSIGNED)
def window_assign(spark: SparkSession, d: str) -> DataFrame:
    return iv.assign(intervals(spark, d).select("id", "owner", "s", "e"), _nine_to_five(spark)).select("id", "owner", "date", "w_s", "w_e", "s", "e")


@query(_ASSIGNED)
def window_assign_asof(spark: SparkSession, d: str) -> DataFrame:
    """The same by counting windows' ends and begins along the time line."""
    return iv.assign_disjoint(intervals(spark, d).select("id", "owner", "s", "e"), _nine_to_five(spark)).select("id", "owner", "date", "w_s", "w_e", "s", "e")


@query(f"WITH {EVENTS}, l AS ({islands_sql('SELECT team, s, e FROM ev WHERE kind = $$purchase$$', 'team')}), r AS ({islands_sql('SELECT team, s, e FROM ev WHERE kind = $$click$$', 'team')}) SELECT l.team, greatest(l.s, r.s) s, least(l.e, r.e) e FROM l JOIN r ON l.team = r.team AND l.s < r.e AND r.s < l.e")
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d)
    return iv.intersect(rows.where("kind = 'purchase'"), rows.where("kind = 'click'"), ["team"])


@query(
    f"""WITH {EVENTS}, l AS ({islands_sql('SELECT team, s, e FROM ev WHERE kind = $$click$$', 'team')}), r AS ({islands_sql('SELECT team, s, e FROM ev WHERE kind = $$view$$', 'team')}),
b AS (SELECT l.team, l.s lo, greatest(l.s, r.s) s, least(l.e, r.e) e FROM l JOIN r ON l.team = r.team AND l.s < r.e AND r.s < l.e) SELECT team, s, e FROM ({gaps_sql('SELECT team, s lo, s, e FROM l', 'SELECT team, lo, s, e FROM b', 'team, lo').replace('PARTITION BY team, lo, lo', 'PARTITION BY team, lo').replace('w.lo, w.s lo', 'w.lo').replace('GROUP BY team, lo, lo, hi', 'GROUP BY team, lo, hi')})"""
)
def interval_subtract(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d)
    return iv.subtract(rows.where("kind = 'click'"), rows.where("kind = 'view'"), ["team"])


@query(f"WITH {EVENTS}, i AS ({islands_sql(f'SELECT owner, greatest(s, {LO}) s, least(e, {HI}) e FROM ev', 'owner')}), w AS (SELECT DISTINCT owner, {LO}::BIGINT s, {HI}::BIGINT e FROM ev) {gaps_sql('SELECT * FROM w', 'SELECT * FROM i', 'owner')}")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What of the horizon no interval of an owner covers."""
    rows = intervals(spark, d)
    horizon = rows.select("owner").distinct().select("owner", F.lit(LO).alias("s"), F.lit(HI).alias("e"))
    return iv.subtract(horizon, rows, ["owner"])


@query(f"WITH {EVENTS}, i AS ({islands_sql(f'SELECT owner, greatest(s, {LO}) s, least(e, {HI}) e FROM ev', 'owner')}) SELECT owner, coalesce(sum(i.e - i.s), 0)::BIGINT AS covered_seconds, coalesce(sum(i.e - i.s), 0) = {HI - LO} AS complete FROM (SELECT DISTINCT owner FROM ev) o LEFT JOIN i USING (owner) GROUP BY owner")
def coverage_complete(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d)
    covered = iv.union_seconds(iv.clip(rows, LO, HI), ["owner"])
    seconds = F.coalesce("seconds", F.lit(0).cast("bigint"))
    return rows.select("owner").distinct().join(covered, "owner", "left").select("owner", seconds.alias("covered_seconds"), (seconds == HI - LO).alias("complete"))


_COMMON = f"m AS ({islands_sql('SELECT team % 4 g, team, s, e FROM ev', 'g, team')}), c AS ({level_sql('SELECT g, s, e FROM m', 'g')}), common AS ({islands_sql('SELECT g, s, e FROM c WHERE n >= 4 AND e IS NOT NULL', 'g')})"


@query(f"WITH {EVENTS}, {_COMMON} SELECT * FROM common")
def common_free(spark: SparkSession, d: str) -> DataFrame:
    """Time that all four teams of a group hold."""
    return iv.common(intervals(spark, d).withColumn("g", F.col("team") % 4), "team", 4, ["g"])


@query(f"WITH {EVENTS}, {_COMMON} SELECT * FROM common WHERE s < {LO + 5 * 86400} AND e > {LO} AND e - s >= 900")
def filter_shared_windows(spark: SparkSession, d: str) -> DataFrame:
    """Shared windows that meet a range of dates and are long enough."""
    found = iv.common(intervals(spark, d).withColumn("g", F.col("team") % 4), "team", 4, ["g"])
    return found.where((F.col("s") < LO + 5 * times.DAY) & (F.col("e") > LO) & (F.col("e") - F.col("s") >= 900))


@query(f"WITH {EVENTS}, c AS ({level_sql('SELECT team, s, e FROM ev', 'team')}) SELECT team, n::BIGINT AS level, sum(e - s)::BIGINT AS seconds FROM c WHERE n > 0 AND e IS NOT NULL GROUP BY 1, 2")
def concurrency_profile(spark: SparkSession, d: str) -> DataFrame:
    return iv.concurrency(intervals(spark, d), ["team"])


@query("SELECT user_id AS owner, count(*) FILTER (WHERE event_type IN ('click', 'error')) AS busy, count(*) FILTER (WHERE event_type = 'purchase') AS busy_unavailable, count(*) FILTER (WHERE event_type = 'signup') AS busy_tentative, count(*) FILTER (WHERE event_type = 'view') AS free FROM events GROUP BY 1")
def fbtype_counts(spark: SparkSession, d: str) -> DataFrame:
    """Periods by type, the four types always there."""
    kinds = {"view": "free", "signup": "busy_tentative", "purchase": "busy_unavailable"}
    kind = F.coalesce(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))[F.col("kind")], F.lit("busy"))
    counted = intervals(spark, d).withColumn("type", kind).groupBy("owner").pivot("type", ["busy", "busy_unavailable", "busy_tentative", "free"]).count()
    return counted.fillna(0)


@query("SELECT props AS identity, count(DISTINCT user_id)::BIGINT AS owners FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1")
def owner_conflict(spark: SparkSession, d: str) -> DataFrame:
    """Source identities that more than one participant claims."""
    return table(spark, d, "events").groupBy(F.col("props").alias("identity")).agg(F.countDistinct("user_id").alias("owners")).where("owners > 1")


@query("SELECT event_id AS id, event_type || ' ' || props AS summary FROM events WHERE contains(lower(event_type || ' ' || props), lower('Sign')) OR contains(lower(event_type || ' ' || props), ': 42')")
def search_occurrences(spark: SparkSession, d: str) -> DataFrame:
    """Case-folded substring search."""
    text = F.concat_ws(" ", "event_type", "props")
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), text.alias("summary"))
    low = F.lower("summary")
    return rows.where(low.contains("sign") | low.contains(": 42"))


@query(f"""WITH {EVENTS}, p AS ({_pairs_sql('team')}), hit AS (SELECT id FROM ev WHERE contains(kind, 'sign')) SELECT * FROM p WHERE "left" IN (SELECT id FROM hit) OR "right" IN (SELECT id FROM hit)""")
def search_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A pair shows if either side matches."""
    return iv.overlap_pairs(intervals(spark, d), ["team"], marked=F.lower("kind").contains("sign"))


@query(
    f"""WITH {EVENTS}, p AS ({_pairs_sql('owner')}), x AS (SELECT "left" id, seconds, "right" other FROM p UNION ALL SELECT "right", seconds, "left" FROM p)
SELECT ev.id, owner, c_custkey AS source, c_name AS source_name, count(*) AS findings, sum(seconds)::BIGINT AS seconds, string_agg(CAST(other AS VARCHAR), ',' ORDER BY CAST(other AS VARCHAR)) AS others FROM x JOIN ev USING (id) LEFT JOIN customer ON c_custkey = owner GROUP BY ALL"""
)
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """From findings back to occurrence, owner and source."""
    rows = intervals(spark, d)
    pairs = iv.overlap_pairs(rows, ["owner"])
    both = pairs.select(F.col("left").alias("id"), "seconds", F.col("right").alias("other")).union(pairs.select("right", "seconds", "left"))
    found = both.groupBy("id").agg(F.count("*").alias("findings"), F.sum("seconds").alias("seconds"), F.array_join(F.array_sort(F.collect_list(F.col("other").cast("string"))), ",").alias("others"))
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_name").alias("source_name"))
    return found.join(rows.select("id", "owner"), "id").join(sources, F.col("owner") == F.col("source"), "left").select("id", "owner", "source", "source_name", "findings", "seconds", "others")
