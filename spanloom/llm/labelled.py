"""Bounded, reproducible samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id: str) -> Column:
    """True for the third of the documents (by the checksum of the id as text) that no fit may see."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, label) of at most ``bound`` labelled documents outside the held-out third.

    The labels taken are those with the smallest hash of their id, so they don't follow the
    table's order and are the same in every run. Labels that are null or of a null id, and ids
    labelled both ways, are left out. Rows that repeat an id are one document, with the smallest of their
    texts, so that ``bound`` holds for rows too.
    """
    known = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").where(~held_out("id"))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    known = known.orderBy(F.xxhash64("id"), "id").limit(bound)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    return rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")
