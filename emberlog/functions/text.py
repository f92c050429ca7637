"""Message search helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_contains(col: Column | str, q: str) -> Column:
    """Case-insensitive literal substring test, the same as ILIKE '%q%' with escapes.

    Both sides are lower-cased by the JVM, so case folding is consistent.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(c).contains(F.lower(F.lit(q)))
