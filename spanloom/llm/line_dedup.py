"""Lines that too large a part of a site's pages repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, unused

#: A line is boilerplate if over this percentage of its site's pages have it, and so many that differ otherwise.
MOST_PERCENT, LEAST_PAGES = 10, 3


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _filled(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r")) != ""


def _key(line: Column) -> Column:
    """96 bits of hash; a line without anything but white space has no key."""
    return F.when(_filled(line), F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g")))


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: int = MOST_PERCENT, least: int = LEAST_PAGES) -> DataFrame:
    """(host, lines): each site's boilerplate lines, as an array of hashes.

    Copies of a page prove nothing about its lines: pages that have a line count once for each different longest line
    besides it (of equal ones the last in order), all that have none besides it count once, and a line that a page repeats counts once.
    Pages are compared with all of the site's. Counts are summed before the shuffle and a site's rows are never gathered; the array
    holds fewer lines than a page of the site has on average times 100 / percent.
    """
    pages = docs.where(F.col(host).isNotNull() & F.col(text).isNotNull())
    sized = F.transform(F.filter(F.array_distinct(_lines(text)), _filled), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("line")))
    rows = pages.select(F.col(host).alias("host"), sized.alias("sized")).withColumn("top", F.array_max("sized"))
    rows = rows.withColumn("next", F.xxhash64(F.array_max(F.filter("sized", lambda x: x != F.col("top")))["line"])).withColumn("first", F.xxhash64("top.line"))
    seen = rows.select("host", F.explode(F.transform("sized", lambda x: F.struct(_key(x["line"]).alias("line"), F.when(x == F.col("top"), F.col("next")).otherwise(F.col("first")).alias("besides")))).alias("x"))
    often = seen.select("host", "x.line", "x.besides").distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    total = docs.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    return often.join(total, "host").where(100 * F.col("n") > percent * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", percent: int = MOST_PERCENT, least: int = LEAST_PAGES, count: str | None = None) -> DataFrame:
    """``docs`` with its boilerplate lines cut from ``text``; every row and all other columns stay.

    Lines are what \\n separates, compared as they are; those of white space alone are never cut. A
    text of boilerplate alone becomes empty; a null text or host, and every line of a site with
    fewer than ``least`` different pages, stays. Copies of a page, repeated rows among them, keep their lines unless other pages have
    them. With ``count`` a column of that
    name tells how many lines went.
    """
    theirs, found, kept = (unused(docs, name) for name in ("_host", "_lines", "_kept"))
    lines = boilerplate(docs, host, text, percent, least).withColumnsRenamed({"host": theirs, "lines": found})
    cells = lines.select(F.sum(F.size(found) * 24 + 64)).first()[0] or 0
    joined = docs.join(F.broadcast(lines) if cells <= BROADCAST_BYTES else lines, F.col(host) == F.col(theirs), "left")
    left = F.filter(_lines(text), lambda x: ~F.coalesce(F.array_contains(found, _key(x)), F.lit(False)))
    joined = joined.withColumn(kept, F.when(F.col(found).isNotNull() & F.col(text).isNotNull(), left))
    out = {c: F.coalesce(F.array_join(kept, "\n"), F.col(c)) if c == text else F.col(c) for c in docs.columns}
    if count:
        out[count] = F.coalesce(F.size(_lines(text)) - F.size(kept), F.lit(0)).cast("long")
    return joined.select(*(v.alias(k) for k, v in out.items()))
