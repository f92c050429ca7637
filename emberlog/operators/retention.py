"""Retention: expire logs older than ``as_of - hours`` and keep the rollup in step.

On the store, day folders before the cutoff day are dropped by their name; only
the day holding the cutoff is rewritten, each batch in its own place.
Rollup partials follow the same cutoff: seconds wholly before it go, and the
second that holds the cutoff is recounted from kept rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog import schema as S
from emberlog.functions.timefns import ceil_second
from emberlog.functions.written import written
from emberlog.operators.rollup import build_rollup
from emberlog.spec import to_utc


def check_hours(hours: int) -> int:
    if isinstance(hours, bool) or not isinstance(hours, int) or not (
        S.RETENTION_HOURS_MIN <= hours <= S.RETENTION_HOURS_MAX
    ):
        raise ValueError("retention hours must be an integer between 1 and 8760")
    return hours


def cutoff_of(as_of: datetime, hours: int = S.RETENTION_HOURS_DEFAULT) -> datetime:
    return to_utc(as_of) - timedelta(hours=check_hours(hours))


def expire(logs: DataFrame, counts: DataFrame | None, as_of: datetime,
           hours: int = S.RETENTION_HOURS_DEFAULT):
    """(kept logs, kept rollup or None, expired logs) as lazy DataFrames."""
    cut = cutoff_of(as_of, hours)
    kept = logs.where(F.col("ts") >= F.lit(cut))
    expired = logs.where(F.col("ts") < F.lit(cut))
    kept_counts = None
    if counts is not None:
        keys = ["bucket_ts", "service", "level", "tenant_id", "n"]
        lo = ceil_second(cut)
        kept_counts = counts.where(F.col("bucket_ts") >= F.lit(lo)).select(*keys)
        if lo != cut:  # the second holding the cutoff is recounted from kept rows
            edge = kept.where(F.col("ts") < F.lit(lo))
            kept_counts = kept_counts.unionByName(build_rollup(edge).select(*keys))
    return kept, kept_counts, expired


def expired_count(logs: DataFrame, as_of: datetime, hours: int = S.RETENTION_HOURS_DEFAULT) -> DataFrame:
    """One row: the number of rows the sweep removes."""
    cut = cutoff_of(as_of, hours)
    return logs.where(F.col("ts") < F.lit(cut)).agg(F.count(F.lit(1)).alias("expired"))


def expire_store(store, as_of: datetime, hours: int = S.RETENTION_HOURS_DEFAULT,
                 spark: SparkSession | None = None) -> int:
    """Apply retention to a ``LogStore``; returns the number of log rows removed.

    The kept rows and partials of the cutoff day are first written to the checkpoint folder, then put in the place of
    the day's batches by dynamic partition overwrite; batches of which nothing is kept lose their folder of that day.
    Every step gives the same again, so a sweep that was interrupted is completed by the next one.
    """
    spark = spark or SparkSession.getActiveSession()
    cut = cutoff_of(as_of, hours)
    day = cut.date().isoformat()
    on_day = F.col("dt") == F.lit(day).cast("date")
    logs = store.logs(spark)
    removed = int(logs.where((F.col("dt") <= F.lit(day).cast("date")) & (F.col("ts") < F.lit(cut))).count())
    for table in ("logs", "log_counts"):
        for d in store.values(spark, store.path(table), "dt"):
            if d < day:
                store.drop(spark, f"{store.path(table)}/dt={d}")
    lo = ceil_second(cut)
    kept = written(store.raw_logs(spark).where(on_day & (F.col("ts") >= F.lit(cut))), "kept-logs")
    counts = store.raw_counts(spark).where(on_day & (F.col("bucket_ts") >= F.lit(lo)))
    if lo != cut:  # the second holding the cutoff, recounted from kept rows
        edge = build_rollup(kept.where(F.col("ts") < F.lit(lo)), "dt", "batch_id")
        counts = counts.unionByName(edge.select(counts.columns))
    counts = written(counts, "kept-counts")
    for table, rows, order in (("logs", kept, "ts"), ("log_counts", counts, "bucket_ts")):
        store.write_partitions(rows, table, ["dt", "batch_id"], order)
        # Batches of one day: those whose rows are all gone have no partition to overwrite theirs.
        held = {str(r["batch_id"]) for r in rows.select("batch_id").distinct().collect()}
        for b in store.values(spark, f"{store.path(table)}/dt={day}", "batch_id"):
            if b not in held:
                store.drop(spark, f"{store.path(table)}/dt={day}/batch_id={b}")
    return removed


__all__ = ["check_hours", "cutoff_of", "expire", "expired_count", "expire_store"]
