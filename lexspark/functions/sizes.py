"""Broadcast only what has been measured."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a side is broadcast.
LIMIT_BYTES = 24 << 20


def bounded(df: DataFrame, row_bytes: int | Column = 200, limit: int = LIMIT_BYTES) -> DataFrame:
    """`df` marked for broadcast if its size is within the limit: rows counted where all are as wide, else
    their bytes summed. Beyond it a plain join side, which adaptive execution may still split where keys
    are hot."""
    if isinstance(row_bytes, int):
        most = max(1, limit // row_bytes)
        fits = df.limit(most + 1).count() <= most
    else:
        fits = (df.agg(F.sum(row_bytes)).first()[0] or 0) <= limit
    return F.broadcast(df) if fits else df


def text_bytes(*columns: str) -> Column:
    """Bytes of a row with these texts, and some for what stands around them."""
    total = F.lit(96)
    for c in columns:
        total = total + F.coalesce(F.octet_length(c), F.lit(0))
    return total
