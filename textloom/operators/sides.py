"""Sides of joins that are small enough to be sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows, and most bytes of them as text, that are broadcast.
ROWS, BYTES = 200_000, 32 << 20


def small(df: DataFrame, rows: int = ROWS, size: int = BYTES) -> DataFrame:
    """df marked for broadcast if it was counted and measured to be small, else as it is (a shuffle join)."""
    as_text = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(as_text), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= size else df
