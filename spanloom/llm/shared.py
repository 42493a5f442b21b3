"""What the text operators share: intermediate tables, joins whose broadcasts are size-checked, free column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import drop, save, shared_dir

__all__ = ["BROADCAST_BYTES", "drop", "save", "shared_dir", "small", "unused"]

#: A side is broadcast only if its rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to stay under BROADCAST_BYTES, else unchanged (a shuffled join)."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
