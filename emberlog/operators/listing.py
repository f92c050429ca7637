"""Newest-first listings, keyset pages and the whole-table page index."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from emberlog.functions.timefns import iso_ms
from emberlog.operators.predicates import apply_filter, attributes_are_variant
from emberlog.operators.ranking import with_rank
from emberlog.spec import ALL_TENANTS, Bookmark, ListSpec, LogFilter

LIST_COLUMNS = ["id", "ts", "level", "service", "message", "attributes"]  # tenant_id stays hidden


def newest_first():
    return [F.col("ts").desc(), F.col("id").desc()]


def list_rows(logs: DataFrame, spec: ListSpec, tenant=ALL_TENANTS) -> DataFrame:
    """Top ``limit + 1`` rows newest first; the extra row proves another page.

    Planned as TakeOrderedAndProject: each task keeps its own top rows, so
    only (limit + 1) x tasks rows ever move.
    """
    df = apply_filter(logs, spec.filter, tenant, spec.bookmark)
    return df.select(*LIST_COLUMNS).orderBy(*newest_first()).limit(spec.limit + 1)


def page_rows(logs: DataFrame, spec: ListSpec, tenant=ALL_TENANTS) -> DataFrame:
    """The page itself: top ``limit`` rows."""
    df = apply_filter(logs, spec.filter, tenant, spec.bookmark)
    return df.select(*LIST_COLUMNS).orderBy(*newest_first()).limit(spec.limit)


def next_bookmark(logs: DataFrame, spec: ListSpec, tenant=ALL_TENANTS) -> DataFrame:
    """0 or 1 row (ts, id): the last row of the page when another page exists.

    The window runs over the at most 1,001 look-ahead rows only.
    """
    top = list_rows(logs, spec, tenant)
    w = Window.orderBy(*newest_first())
    ranked = top.withColumn("_rn", F.row_number().over(w)).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy())
    )
    return ranked.where((F.col("_rn") == spec.limit) & (F.col("_n") > spec.limit)).select("ts", "id")


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _collect(page: DataFrame) -> tuple[list[Row], list[Bookmark]]:
    """Rows of a page and the bookmark of each. The time travels as a number: a collected
    datetime is in the zone of the Python process, which need not be UTC."""
    keyed = page.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).collect()
    shape = Row(*page.columns)
    rows = [shape(*[r[c] for c in page.columns]) for r in keyed]
    return rows, [Bookmark(_EPOCH + timedelta(microseconds=r["_us"]), r["id"]) for r in keyed]


def fetch_page(logs: DataFrame, spec: ListSpec, tenant=ALL_TENANTS):
    """(rows, next bookmark or None) for one page; collects at most 1,001 rows."""
    rows, marks = _collect(list_rows(logs, spec, tenant))
    return rows[: spec.limit], marks[spec.limit - 1] if len(rows) > spec.limit else None


def fetch_page_by_days(logs: DataFrame, days: list[str], spec: ListSpec, tenant=ALL_TENANTS):
    """``fetch_page`` on a day-partitioned store without scanning every day.

    Every row of a newer day sorts before every row of an older day, so the
    newest page can be read from the newest days alone: days inside the
    query's time bounds are tried newest first in chunks that double
    (1, 2, 4, ... days) until limit + 1 rows are found. Each step is one
    distributed top-k over the chunk's partitions; at most 1,001 rows per
    step reach the driver. The result equals ``fetch_page`` on all rows.
    """
    flt = spec.filter
    upper = min([t for t in (flt.until, spec.bookmark.ts if spec.bookmark else None) if t is not None],
                default=None)
    cand = [d for d in days
            if (upper is None or d <= upper.date().isoformat())
            and (flt.since is None or d >= flt.since.date().isoformat())]
    want = spec.limit + 1
    rows, marks, i, step = [], [], 0, 1
    while i < len(cand) and len(rows) < want:
        chunk = cand[i:i + step]
        part = logs.where(F.col("dt").isin([F.lit(d).cast("date") for d in chunk]))
        need = ListSpec(flt, min(want - len(rows), 1000), spec.bookmark)
        got, keys = _collect(list_rows(part, need, tenant))
        marks += keys[: want - len(rows)]
        rows += got[: want - len(rows)]
        i, step = i + len(chunk), step * 2
    return rows[: spec.limit], marks[spec.limit - 1] if len(rows) > spec.limit else None


def attributes_text(df: DataFrame):
    """The attributes as JSON object text, whichever way they are stored."""
    return F.to_json("attributes") if attributes_are_variant(df) else F.col("attributes")


def render_rows(df: DataFrame) -> DataFrame:
    """Listing as the API shows it: id as text, ts as ISO-8601 ms UTC, attributes as JSON."""
    return df.select(
        F.col("id").cast("string").alias("id"),
        iso_ms("ts").alias("ts"),
        "level",
        "service",
        "message",
        attributes_text(df).alias("attributes"),
    )


def page_index(logs: DataFrame, flt: LogFilter, page_size: int, tenant=ALL_TENANTS) -> DataFrame:
    """Every page of a full keyset walk in one job: page number (0-based),
    row count and the first and last (ts, id) of each page."""
    if page_size < 1:
        raise ValueError("limit must be between 1 and 1000")
    df = apply_filter(logs, flt, tenant).select("ts", "id")
    ranked = with_rank(df, ["-ts", "-id"], rank_col="_rank")
    paged = ranked.withColumn("page_no", F.floor(F.col("_rank") / F.lit(page_size)).cast("bigint"))
    agg = paged.groupBy("page_no").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min_by("ts", "_rank").alias("first_ts"),
        F.min_by("id", "_rank").alias("first_id"),
        F.max_by("ts", "_rank").alias("last_ts"),
        F.max_by("id", "_rank").alias("last_id"),
    )
    return agg
