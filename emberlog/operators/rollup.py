"""One-second rollup: additive partial counts per (second, service, level, tenant).

Partials from different batches may hold the same key; readers sum them, and
``compact`` folds them into one row per key. Map-side partial aggregation
keeps a hot key from ever concentrating raw rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.timefns import bucket_start

ROLLUP_KEYS = ["bucket_ts", "service", "level", "tenant_id"]


def build_rollup(logs: DataFrame, *keep: str) -> DataFrame:
    """``keep``: further columns that tell partials apart (batch and day)."""
    return logs.groupBy(
        bucket_start("ts", 1).alias("bucket_ts"), "service", "level", "tenant_id", *keep
    ).agg(F.count(F.lit(1)).alias("n"))


def compact(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*ROLLUP_KEYS).agg(F.sum("n").alias("n"))
