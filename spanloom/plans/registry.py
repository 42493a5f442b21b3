"""Named queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import times
from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: 2024-01-05 and 2024-01-20, the horizon of queries that cut to one.
LO, HI = 1_704_412_800, 1_705_708_800

EVENTS = "ev AS (SELECT event_id id, user_id AS owner, user_id % 16 AS team, event_type kind, epoch(date_trunc('second', ts))::BIGINT s, epoch(date_trunc('second', ts))::BIGINT + CAST(round(value * 60) AS BIGINT) e FROM events)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as intervals: each begins at ts and lasts value minutes (id, owner, team, kind, s, e)."""
    s = times.seconds("ts")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("owner"), (F.col("user_id") % 16).alias("team"), F.col("event_type").alias("kind"), s.alias("s"), (s + F.round(F.col("value") * 60).cast("bigint")).alias("e"))


def islands_sql(source: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    # equal rows are taken once, as two windows may order ties differently
    return f"""SELECT {keys}min(s) s, max(e) e FROM (SELECT *, sum(n) OVER ({part}ORDER BY s, e ROWS UNBOUNDED PRECEDING) island FROM (
SELECT {keys}s, e, CASE WHEN coalesce(s > max(e) OVER ({part}ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END n FROM (SELECT DISTINCT {keys}s, e FROM ({source}) WHERE e > s))) GROUP BY {keys}island"""


def gaps_sql(windows: str, busy: str, keys: str, minimum: int = 1) -> str:
    """Free time of ``windows`` (keys, s, e) beside ``busy`` (keys, s, e; disjoint and inside their windows)."""
    on = " AND ".join(f"w.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"w.{k.strip()}" for k in keys.split(","))
    both = f"SELECT {own}, w.s lo, w.e hi, b.s, b.e FROM ({windows}) w LEFT JOIN ({busy}) b ON {on} AND b.s < w.e AND b.e > w.s"
    return f"""SELECT * FROM (SELECT {keys}, coalesce(lag(e) OVER (PARTITION BY {keys}, lo ORDER BY s), lo) s, s e FROM ({both}) WHERE s IS NOT NULL
UNION ALL SELECT {keys}, coalesce(max(e), lo) s, hi e FROM ({both}) GROUP BY {keys}, lo, hi) WHERE e - s >= {minimum}"""


def level_sql(source: str, by: str) -> str:
    """Cells (by, s, e, n) between boundaries with the number of open intervals."""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f"""SELECT {keys}t s, lead(t) OVER ({part}ORDER BY t) e, sum(d) OVER ({part}ORDER BY t ROWS UNBOUNDED PRECEDING) n FROM (
SELECT {keys}t, sum(d) d FROM (SELECT {keys}s t, 1 d FROM ({source}) WHERE e > s UNION ALL SELECT {keys}e t, -1 d FROM ({source}) WHERE e > s) GROUP BY {keys}t)"""
