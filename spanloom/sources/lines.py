"""Content lines of calendar files as rows: reading, unfolding and splitting with column functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a line of text: all that Unicode calls a line boundary.
BREAK = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ])"
_VALUE = r'(?:"[^"]*+"|[^";:,]*+)'
_PARAM = rf";([A-Za-z0-9-]++)=({_VALUE}(?:,{_VALUE})*+)"
_HEAD = rf"^([A-Za-z0-9-]++)((?:{_PARAM})*+):"


def _escaped(path: str) -> str:
    """``path`` with what a reader would take for a pattern taken literally."""
    return "".join("\\" + c if c in "\\[]{}*?" else c for c in path)


def _qualified(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def _listed(spark: SparkSession, paths: Sequence[str], column: str) -> DataFrame:
    """(source_ord, name, column) of single files, numbered from 1 in the order given; null for empty ones, which the reader skips."""
    given = [(k, _qualified(spark, p), p.rstrip("/").rsplit("/", 1)[-1]) for k, p in enumerate(paths, 1)]
    known = spark.createDataFrame(given, "source_ord int, path string, name string")
    found = spark.read.format("binaryFile").load(sorted({_escaped(path) for _, path, _ in given})).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), column)
    return known.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(found, "path", "left").select("source_ord", "name", column)


def sizes(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_ord, name, bytes) of single files, from their listing: no content is read."""
    return _listed(spark, paths, "length").select("source_ord", "name", F.coalesce("length", F.lit(0).cast("bigint")).alias("bytes"))


def files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source_ord, name, bytes, sha256, content) of single files, read in one scan and numbered from 1 in the order given.

    Names are literal, whatever characters they hold. A file given twice comes twice; empty files, which
    the reader skips, are there too.
    """
    content = F.coalesce("content", F.lit(b""))
    return _listed(spark, paths, "content").select("source_ord", "name", F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("sha256"), content.alias("content"))


def head(line: Column) -> dict[str, Column]:
    """``well`` formed or not, upper-case ``name``, ``params`` as they stand (each after a semicolon) and ``value`` of a content line."""
    return {
        "well": F.regexp_like(line, F.lit(_HEAD)),
        "name": F.upper(F.regexp_extract(line, _HEAD, 1)),
        "params": F.regexp_extract(line, _HEAD, 2),
        "value": F.substr(line, F.length(F.regexp_extract(line, _HEAD, 0)) + 1),
    }


def _pairs(params: Column) -> Column:
    return F.regexp_extract_all(params, F.lit(_PARAM), F.lit(0))


def param_names(params: Column) -> Column:
    """Upper-case names of a line's parameters, in order."""
    return F.transform(_pairs(params), lambda p: F.upper(F.substring_index(F.substr(p, F.lit(2)), "=", 1)))


def param(params: Column, name: str) -> Column:
    """Value of the last parameter of that name, without quotes; null if there is none."""
    own = F.filter(_pairs(params), lambda p: F.upper(F.substring_index(F.substr(p, F.lit(2)), "=", 1)) == name)
    return F.regexp_replace(F.substr(F.try_element_at(own, F.lit(-1)), F.lit(len(name) + 3)), '"', "")


def plain_text(value: Column) -> Column:
    """Text without its backslash escapes."""
    parts = F.regexp_extract_all(value, F.lit(r"(?s)\\[nN,;\\]|[^\\]++|\\"), F.lit(0))
    one = lambda p: F.when(p.isin("\\n", "\\N"), "\n").when((F.length(p) == 2) & p.startswith("\\") & ~F.substr(p, F.lit(2)).rlike("[a-zA-Z0-9]"), F.substr(p, F.lit(2))).otherwise(p)
    return F.array_join(F.transform(parts, one), "")
