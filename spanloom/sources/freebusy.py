"""Free/busy files: coverage and periods, from a strict subset of the format, read by column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions import times
from ..tables import save
from . import lines as text_lines

KINDS = ("BUSY", "BUSY-TENTATIVE", "BUSY-UNAVAILABLE", "FREE")
MAX_SECONDS = 90 * times.DAY
#: Order of a file's component boundaries; a property's section is the number of them before it.
_BOUNDARIES = ("BEGIN:VCALENDAR", "BEGIN:VFREEBUSY", "END:VFREEBUSY", "END:VCALENDAR")
#: Properties of section 1 with the only value that is supported (null: any), and of section 2 with what their value is.
_CALENDAR = {"VERSION": "2.0", "PRODID": None, "CALSCALE": "GREGORIAN", "METHOD": "PUBLISH"}
_BUSY = {"FREEBUSY": "periods", "DTSTAMP": "time", "DTSTART": "time", "DTEND": "time", "UID": "text", "ORGANIZER": "text", "CONTACT": "text", "URL": "text", "COMMENT": "text"}
_REPEATED = ("FREEBUSY", "COMMENT")
_REQUIRED = ("VERSION", "PRODID", "UID", "DTSTAMP", "DTSTART", "DTEND")
_STRICT = r'^[A-Za-z][A-Za-z0-9-]*+(?:;[A-Za-z][A-Za-z0-9-]*+=(?:[A-Za-z0-9-]++|"[A-Za-z0-9-]++"))*+:'


def _upper(text: Column) -> Column:
    """a-z as A-Z; other letters, some of which a general upper case turns into these, stay as they are."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _utc(text: Column) -> Column:
    kind, value = times.decode_time(text, F.lit(None).cast("string"))
    return F.when(kind == "utc", times.seconds(value))


def _period(kind: Column, text: Column) -> Column:
    """A period of two times, or of one and a duration; null bounds for what is neither."""
    ends = F.split(text, "/")
    s, last = _utc(F.get(ends, F.lit(0))), F.get(ends, F.lit(1))
    e = F.coalesce(_utc(last), s + times.duration(last))
    fits = (F.size(ends) == 2) & (s < e)
    return F.struct(kind.alias("kind"), F.when(fits, s).alias("s"), F.when(fits, e).alias("e"))


def _lines(files: DataFrame, line_bytes: int) -> DataFrame:
    """A row per content line with its section; unfolded as bytes (a character of Latin-1 each), as a fold may part a character."""
    raw = F.regexp_replace(F.regexp_replace(F.decode("content", "ISO-8859-1"), "\r\n", "\n"), r"\n\z", "")
    physical = F.split(raw, "\n")
    whole = F.transform(F.split(F.regexp_replace(raw, "\n[ \t]", ""), "\n"), lambda x: F.encode(x, "ISO-8859-1").cast("string"))
    fault = (
        F.when(F.contains(raw, F.lit("\r")), "a bare CR ends no line")
        .when(F.exists(physical, lambda x: x == ""), "an empty line")
        .when(F.regexp_like(raw, F.lit(r"[\x00-\x08\x0B-\x1F\x7F]")), "a control character")
        .when(F.regexp_like(raw, F.lit("^[ \t]")), "a continuation of nothing")
        .when(F.exists(whole, lambda x: ~F.is_valid_utf8(x)), "not UTF-8")
        .when(F.exists(whole, lambda x: F.octet_length(x) > line_bytes), "line_bytes limit exceeded")
    )
    rows = files.select("source_ord", fault.alias("unreadable"), F.when(fault.isNull(), whole).alias("lines")).select("source_ord", "unreadable", F.posexplode_outer("lines").alias("pos", "line"))
    rows = rows.withColumns(text_lines.head(F.col("line"))).withColumn("params", _upper(F.regexp_replace("params", '"', "")))
    boundary = F.when(F.col("name").isin("BEGIN", "END"), F.concat("name", F.lit(":"), _upper(F.col("value"))))
    order = Window.partitionBy("source_ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("boundary", boundary).withColumn("section", F.count("boundary").over(order))


def _fault(rows: DataFrame) -> Column:
    """What is wrong with a line by itself."""
    name, value, params, section = F.col("name"), F.col("value"), F.col("params"), F.col("section")
    names = text_lines.param_names(params)
    only = lambda *known: F.size(F.array_except(names, F.array(*map(F.lit, known)))) == 0
    wanted = F.get(F.array(*map(F.lit, _BOUNDARIES)), section.cast("int") - 1)
    top = F.lit(False)
    for known, needed in _CALENDAR.items():
        top = top | (name == known) & ((value != "") if needed is None else _upper(value) == needed)
    kind = lambda what: name.isin([k for k, v in _BUSY.items() if v == what])
    busy = (
        kind("periods") & only("FBTYPE", "VALUE") & F.coalesce(text_lines.param(params, "FBTYPE").isin(*KINDS), F.lit(True)) & F.coalesce(text_lines.param(params, "VALUE") == "PERIOD", F.lit(True)) & ~F.exists("periods", lambda p: p["s"].isNull())
        | kind("time") & only("VALUE") & F.coalesce(text_lines.param(params, "VALUE") == "DATE-TIME", F.lit(True)) & F.col("time").isNotNull()
        | kind("text") & (params == "") & (value != "")
    )
    return (
        F.when(~F.regexp_like("line", F.lit(_STRICT)), "not a content line")
        .when(F.size(names) != F.size(F.array_distinct(names)), "a parameter twice")
        .when(F.col("boundary").isNotNull(), F.when((params != "") | ~F.coalesce(F.col("boundary") == wanted, F.lit(False)), "not one VCALENDAR with one VFREEBUSY"))
        .when(section == 1, F.when(~top | (params != ""), "unsupported calendar property"))
        .when(section == 2, F.when(~busy, "unsupported free/busy property or value"))
        .otherwise("a property outside the components")
    )


def parsed(files: DataFrame, line_bytes: int = 65_536) -> DataFrame:
    """One row per file of :func:`lines.files`: its coverage [lo, hi) and periods, or its error.

    Free periods are there too, but block nothing. A file's lines are one partition of a window.
    """
    rows = _lines(files, line_bytes)
    kind = F.coalesce(text_lines.param(F.col("params"), "FBTYPE"), F.lit("BUSY"))
    rows = rows.withColumn("kind", kind).withColumn("periods", F.when(F.col("name") == "FREEBUSY", F.transform(F.split("value", ","), lambda v: _period(F.col("kind"), v))).otherwise(F.array().cast("array<struct<kind:string, s:bigint, e:bigint>>"))).withColumn("time", _utc(F.col("value")))
    rows = save(rows.withColumn("fault", F.when(F.col("line").isNotNull(), _fault(rows))), "freebusy_lines")
    once = F.when(F.col("boundary").isNull() & ~F.col("name").isin(*_REPEATED), F.concat("section", F.lit(" "), "name"))
    time = lambda name: F.max(F.when((F.col("section") == 2) & (F.col("name") == name), F.col("time")))
    seen = rows.groupBy("source_ord").agg(
        F.max("unreadable").alias("unreadable"), F.min(F.when(F.col("fault").isNotNull(), F.struct("pos", "fault"))).alias("fault"), F.max("section").alias("sections"), (F.count(once) > F.count_distinct(once)).alias("twice"),
        F.collect_set(F.when(F.col("name").isin(*_REQUIRED), F.col("name"))).alias("present"), time("DTSTART").alias("lo"), time("DTEND").alias("hi"),
        F.array_sort(F.collect_list(F.when(F.col("name") == "FREEBUSY", F.struct("pos", "periods")))).alias("lists"),
    )
    periods = F.flatten(F.transform("lists", lambda x: x["periods"]))
    outside = F.exists(periods, lambda p: (p["s"] < F.col("lo")) | (p["e"] > F.col("hi")))
    length = F.col("hi") - F.col("lo")
    error = F.coalesce(F.col("unreadable"), F.col("fault.fault"), F.when(F.col("sections") < len(_BOUNDARIES), "not one VCALENDAR with one VFREEBUSY").when(F.col("twice"), "a property twice").when(F.size("present") < len(_REQUIRED), "a required property is missing").when((length <= 0) | (length > MAX_SECONDS) | outside, "periods lie inside a coverage of at most 90 days"))
    good = lambda c: F.when(error.isNull(), c)
    known = files.select("source_ord", "name", "bytes", "sha256").join(seen, "source_ord")
    return known.select("source_ord", "name", "bytes", "sha256", error.alias("error"), good(F.col("lo")).alias("lo"), good(F.col("hi")).alias("hi"), F.coalesce(good(periods), F.array()).cast("array<struct<kind:string, s:bigint, e:bigint>>").alias("periods"))


def read(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """:func:`parsed` rows of single files, in the order given."""
    return parsed(text_lines.files(spark, paths))


def require(files: DataFrame) -> DataFrame:
    """``files``; raises for the first that was rejected."""
    bad = files.where("error is not null").orderBy("source_ord").select("name", "error").first()
    if bad is not None:
        raise InputError(f"{bad['name']}: {bad['error']}")
    return files


def counts(files: DataFrame) -> DataFrame:
    """Periods of each file by type, the four types always there."""
    kinds = F.explode_outer("periods")
    return files.select("source_ord", kinds.alias("p")).groupBy("source_ord").agg(*(F.count_if(F.col("p.kind") == k).alias(k) for k in KINDS))
