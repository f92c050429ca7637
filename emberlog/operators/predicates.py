"""LogFilter + tenant scope + bookmark → one boolean Column.

Clauses are ANDed; the simple ones (time, service, level, tenant) are plain
comparisons that Catalyst pushes into the Parquet scan and, on the store,
into partition pruning of ``dt``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from emberlog.functions.attrs import attr_equals, promoted_columns, promoted_equals
from emberlog.functions.text import message_contains
from emberlog.spec import ALL_TENANTS, Bookmark, LogFilter


def tenant_column(scope) -> Column | None:
    """ALL_TENANTS → no clause; None → rows without tenant; str → that tenant."""
    if scope is ALL_TENANTS:
        return None
    if scope is None:
        return F.col("tenant_id").isNull()
    return F.col("tenant_id") == F.lit(str(scope))


def bookmark_column(bm: Bookmark) -> Column:
    """Rows strictly after the bookmark in (ts desc, id desc) order.

    The redundant ``ts <= bm.ts`` is a plain range that reaches the scan.
    """
    ts, i = F.lit(bm.ts), F.lit(bm.id)
    return (F.col("ts") <= ts) & ((F.col("ts") < ts) | ((F.col("ts") == ts) & (F.col("id") < i)))


def day_bounds(since=None, until=None, ts_upper=None) -> list[Column]:
    """Partition-pruning clauses on the store's ``dt`` (UTC day) column that
    follow from the time bounds; redundant with the ts clauses, so exact."""
    out: list[Column] = []
    if since is not None:
        out.append(F.col("dt") >= F.lit(since.date()))
    for upper in (until, ts_upper):
        if upper is not None:
            out.append(F.col("dt") <= F.lit(upper.date()))
    return out


def filter_clauses(flt: LogFilter, tenant=ALL_TENANTS, bookmark: Bookmark | None = None,
                   with_time: bool = True, has_day: bool = False,
                   attrs_variant: bool = False, columns: frozenset = frozenset()) -> list[Column]:
    out: list[Column] = []
    if has_day:
        out += day_bounds(flt.since if with_time else None, flt.until if with_time else None,
                          bookmark.ts if bookmark is not None else None)
    if with_time and flt.since is not None:
        out.append(F.col("ts") >= F.lit(flt.since))
    if with_time and flt.until is not None:
        out.append(F.col("ts") < F.lit(flt.until))
    if flt.service is not None:
        out.append(F.col("service") == F.lit(flt.service))
    if flt.level is not None:
        out.append(F.col("level") == F.lit(flt.level))
    for key, value in flt.attrs:
        if attrs_variant and columns.issuperset(promoted_columns(key).values()):
            out.append(promoted_equals("attributes", key, value))
        else:
            out.append(attr_equals("attributes", key, value, is_variant=attrs_variant))
    if flt.q is not None:
        out.append(message_contains("message", flt.q))
    tc = tenant_column(tenant)
    if tc is not None:
        out.append(tc)
    if bookmark is not None:
        out.append(bookmark_column(bookmark))
    return out


def attributes_are_variant(df) -> bool:
    """The store keeps attributes as VARIANT; views and fixtures as JSON text."""
    return "attributes" in df.columns and isinstance(df.schema["attributes"].dataType, VariantType)


def apply_filter(df, flt: LogFilter, tenant=ALL_TENANTS, bookmark: Bookmark | None = None,
                 with_time: bool = True):
    """Filter ``df``; on a stored table with a ``dt`` column the time bounds
    also become ``dt`` bounds, which prune whole day partitions, and probes of
    promoted attribute keys become comparisons of their stored columns."""
    clauses = filter_clauses(flt, tenant, bookmark, with_time, has_day="dt" in df.columns,
                             attrs_variant=attributes_are_variant(df), columns=frozenset(df.columns))
    return df.where(reduce(lambda a, b: a & b, clauses)) if clauses else df
