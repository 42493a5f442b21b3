"""Families of calendar records that share a UID: repeats, snapshots and cardinality, all by grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedup(records: DataFrame, uid: str = "uid", fingerprint: str = "fingerprint", order: str = "ord", source: str = "source") -> DataFrame:
    """One row per UID and fingerprint: the first by ``order``, with all its source references in order and how many more there were.

    A null fingerprint or UID is a value of its own.
    """
    refs = F.array_sort(F.collect_list(F.struct(order, source)))
    return records.groupBy(uid, fingerprint).agg(F.min(order).alias("canonical"), F.transform(refs, lambda x: x[source]).alias("sources"), (F.count("*") - 1).alias("duplicates"))


def snapshot_conflicts(records: DataFrame, uid: str = "uid", fingerprint: str = "fingerprint", source: str = "source") -> DataFrame:
    """UIDs whose sources hold different sets of fingerprints."""
    sets = records.groupBy(uid, source).agg(F.array_sort(F.collect_set(fingerprint)).alias("_set"))
    return sets.groupBy(uid).agg(F.countDistinct("_set").alias("snapshots")).where("snapshots > 1")


def cardinality_errors(records: DataFrame, uid: str = "uid", is_override: str = "is_override", identity: str = "identity") -> DataFrame:
    """(uid, code) of families without exactly one master or with two overrides of one instance, from distinct records.

    Of several errors the first counts: orphan_override, conflicting_masters, conflicting_overrides.
    """
    over = F.col(is_override)
    masters = records.groupBy(uid).agg(F.count_if(~over).alias("masters"), F.count_if(over).alias("overrides"))
    double = records.where(over).groupBy(uid, identity).agg(F.count("*").alias("n")).groupBy(uid).agg(F.max("n").alias("most"))
    code = F.when(F.col("masters") == 0, "orphan_override").when(F.col("masters") > 1, "conflicting_masters").when(F.col("most") > 1, "conflicting_overrides")
    return masters.join(double, uid, "left").select(uid, code.alias("code")).where("code is not null")


def first_seen(records: DataFrame, uid: str = "uid", order: str = "ord") -> DataFrame:
    """``records`` with ``family_order``: the order of the family's first record."""
    return records.withColumn("family_order", F.min(order).over(Window.partitionBy(uid)))
