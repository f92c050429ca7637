"""Per-bucket counts: by scan, or from the one-second rollup plus raw edges.

The rollup answers whole seconds [ceil(since), floor(until)); the two
sub-second edges come from the raw rows. Every bucket width is a whole
number of seconds, so re-binning seconds is exact. When both bounds fall in
one second the window is a plain scan (no edge is counted twice).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.timefns import bucket_start, ceil_second, floor_second, iso_ms
from emberlog.operators.predicates import apply_filter, day_bounds
from emberlog.spec import ALL_TENANTS, AggregateSpec, LogFilter

BUCKET_COLUMNS = ["bucket_start", "group_name", "count"]


def _group(spec: AggregateSpec):
    return (F.col(spec.group_by) if spec.group_by else F.lit(None).cast("string")).alias("group_name")


def _count_rows(df: DataFrame, spec: AggregateSpec) -> DataFrame:
    return df.groupBy(
        bucket_start("ts", spec.width_seconds).alias("bucket_start"), _group(spec)
    ).agg(F.count(F.lit(1)).alias("count"))


def scan_counts(logs: DataFrame, spec: AggregateSpec, tenant=ALL_TENANTS) -> DataFrame:
    """Filter the window, bucket, count (any filter, including attr and q)."""
    return _count_rows(apply_filter(logs, spec.window_filter(), tenant), spec)


def rollup_counts(logs: DataFrame, counts: DataFrame, spec: AggregateSpec,
                  tenant=ALL_TENANTS) -> DataFrame:
    """Exact window from the rollup interior and raw edges (service/level filters only)."""
    if spec.filter.needs_scan:
        raise ValueError("attribute and text filters need the scan path")
    since, until = spec.since, spec.until
    lo, hi = ceil_second(since), floor_second(until)
    if lo >= hi:
        return scan_counts(logs, spec, tenant)
    shared = LogFilter(service=spec.filter.service, level=spec.filter.level)
    interior = apply_filter(counts, shared, tenant).where(
        (F.col("bucket_ts") >= F.lit(lo)) & (F.col("bucket_ts") < F.lit(hi))
    )
    if "dt" in counts.columns:  # prune day partitions of the stored rollup
        interior = interior.where(reduce(lambda a, b: a & b, day_bounds(lo, hi)))
    parts = [
        interior.select(
            bucket_start("bucket_ts", spec.width_seconds).alias("bucket_start"),
            _group(spec),
            F.col("n").alias("count"),
        )
    ]
    for a, b in ((since, lo), (hi, until)):
        if a < b:
            edge = apply_filter(logs, LogFilter(spec.filter.service, spec.filter.level, a, b), tenant)
            parts.append(_count_rows(edge, spec))
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("bucket_start", "group_name").agg(F.sum("count").alias("count"))


def bucket_counts(logs: DataFrame, counts: DataFrame | None, spec: AggregateSpec,
                  tenant=ALL_TENANTS) -> DataFrame:
    """Path choice: attr or q filters (or no rollup) → scan, else rollup + edges."""
    if counts is None or spec.filter.needs_scan:
        return scan_counts(logs, spec, tenant)
    return rollup_counts(logs, counts, spec, tenant)


def render_buckets(df: DataFrame) -> DataFrame:
    """Buckets as the API shows them, oldest first then by group."""
    return df.select(iso_ms("bucket_start").alias("bucket_start"), "group_name", "count").orderBy(
        "bucket_start", "group_name"
    )


__all__ = ["scan_counts", "rollup_counts", "bucket_counts", "render_buckets"]
