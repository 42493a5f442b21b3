"""Running values over groups of any size, in two levels.

A window over a group needs its rows in one task. Here rows are dealt out by ranges of (by, order), so
that a group may lie in many blocks: values run within a block, each block's first and last group are
totalled, totals run over blocks, and every row adds what the blocks before its own had. A group with a
third of all rows, or one group of all rows, is worked off by as many tasks as it fills blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import save

#: A running value's window function, and how a block's own value is joined to what came before (null: nothing).
_KINDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0))),
    "xor": (F.bit_xor, lambda before, own: F.coalesce(before, F.lit(0)).bitwiseXOR(F.coalesce(own, F.lit(0)))),
    "max": (F.max, F.greatest),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def blocks(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df``, written to the shared folder, with the number of each row's block (``_block``) and a ``_tie`` that parts equal rows.

    Blocks follow each other in (by, order), ascending with nulls first; rows equal in both may lie in any
    order, which is the same for everything that reads the table.
    """
    rows = df.withColumn("_tie", F.monotonically_increasing_id())
    return save(rows.repartitionByRange(*by, *order, "_tie").withColumn("_block", F.spark_partition_id()), "blocks")


def running(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: dict[str, tuple[str, Column]], own_row: bool = True) -> DataFrame:
    """``rows`` of :func:`blocks` with a running value for each name: of its kind (sum, xor, max or last that isn't null), up to and with the row.

    With own_row=False up to the row before; a group's first row then has a sum of 0, and null else.
    ``rows`` are read three times, so should be a table; they may have lost rows since they were dealt out, and
    have more columns, but lie in their blocks still. Nulls are skipped; a null key is a group of its own.
    """
    own = Window.partitionBy("_block", *by).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, 0 if own_row else -1)
    inside = rows.select("*", *(_KINDS[kind][0](value).over(own).alias(name) for name, (kind, value) in values.items()))
    key = F.struct(*by, F.lit(0))
    spans = rows.groupBy(F.col("_block").alias("_of")).agg(F.min(key).alias("_first"), F.max(key).alias("_end"))
    # one row a block, two groups of each: as many as there are partitions, however many rows they hold
    edges = rows.join(F.broadcast(spans), F.col("_block") == F.col("_of")).where((key == F.col("_first")) | (key == F.col("_end")))
    place = F.struct(*order, "_tie")
    total = lambda kind, value: F.max_by(value, F.when(value.isNotNull(), place)) if kind == "last" else _KINDS[kind][0](value)
    totals = edges.groupBy("_block", *by).agg(*(total(kind, value).alias(name) for name, (kind, value) in values.items()))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col("_block").alias("_of"), *(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), *(_KINDS[kind][0](F.col(name)).over(earlier).alias(f"_before_{name}") for name, (kind, _) in values.items()))
    same = F.col("_block") == F.col("_of")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    both = inside.join(F.broadcast(carried), same, "left")
    return both.select(*rows.columns, *(_KINDS[kind][1](F.col(f"_before_{name}"), F.col(name)).alias(name) for name, (kind, _) in values.items()))


def numbered(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """``df`` with dense numbers from 1 in each group's order (in that of the whole table, if ``by`` is empty)."""
    return running(blocks(df, by, order), by, order, {name: ("sum", F.lit(1).cast("bigint"))}).drop("_block", "_tie")
