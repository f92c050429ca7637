"""Query catalog: every operator as a (spark, sf_dir) → DataFrame callable,
plus the DuckDB SQL that must give the same rows.

All queries read the driver tables (the ``events`` table seen as ``logs``)
over their whole extent; parameters are fixed so results are reproducible.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.timefns import bucket_start, iso_ms
from emberlog.operators import aggregate as A
from emberlog.operators import listing as L
from emberlog.operators.rollup import build_rollup, compact
from emberlog.plans import oracle as O
from emberlog.session import checkpoint_dir, configure
from emberlog.sources.events import logs_from_events
from emberlog.spec import ALL_TENANTS, AggregateSpec, Bookmark, ListSpec, LogFilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _utc(*a) -> datetime:
    return datetime(*a, tzinfo=timezone.utc)


# Whole data range of the driver tables (January 2024).
MONTH = (_utc(2024, 1, 1), _utc(2024, 2, 1))
# A window with sub-second bounds, so the rollup path has two raw edges.
EDGED = ("2024-01-02T03:04:05.678Z", "2024-01-28T21:10:11.123Z")


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def logs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return logs_from_events(spark, sf_dir)


# ---------------------------------------------------------------------------
# Aggregates by scan (A1-A3, A8) and from the rollup (A4-A6, A9)
# ---------------------------------------------------------------------------
def _agg_oracle_scan(spec: AggregateSpec, tenant=ALL_TENANTS) -> str:
    g = spec.group_by or "CAST(NULL AS VARCHAR)"
    b = O.bucket_sql("ts", spec.width_seconds)
    return O.with_logs(
        f"SELECT {O.iso(b)} AS bucket_start, {g} AS group_name, count(*) AS count\n"
        f"FROM logs {O.where_sql(spec.window_filter(), tenant)}\nGROUP BY 1, 2"
    )


_ROLLUPS: dict[tuple, str] = {}


def stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-second rollup of the view, written once per application as a
    day-partitioned table in the shared checkpoint folder and read back (the
    rollup path reads stored partials, as on a live store)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROLLUPS:
        path = f"{checkpoint_dir(spark)}/rollup-{uuid.uuid4().hex}"
        counts = build_rollup(logs_of(spark, sf_dir)).withColumn("dt", F.to_date("bucket_ts"))
        counts.write.partitionBy("dt").parquet(path)
        _ROLLUPS[key] = path
    # The schema is known: no job to find it.
    return spark.read.schema("bucket_ts timestamp, service string, level string, tenant_id string, n bigint, dt date").parquet(_ROLLUPS[key])


def _register_agg(name: str, spec: AggregateSpec, tenant=ALL_TENANTS, rollup: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = logs_of(spark, sf_dir)
        counts = stored_rollup(spark, sf_dir) if rollup else None
        return A.render_buckets(A.bucket_counts(logs, counts, spec, tenant))

    register(name, _agg_oracle_scan(spec, tenant))(run)


_register_agg("agg_scan_1m", AggregateSpec(*MONTH, "1m"))
_register_agg("agg_scan_5m", AggregateSpec(*MONTH, "5m", "service"))
_register_agg("agg_scan_1h", AggregateSpec(*MONTH, "1h", "level", LogFilter(service="svc-3")))
_register_agg("agg_scan_1d", AggregateSpec(*MONTH, "1d", None, LogFilter(level="error")))
_register_agg("agg_scan_by_service", AggregateSpec(*EDGED, "1h", "service"))
_register_agg("agg_scan_by_level", AggregateSpec(*MONTH, "1d", "level"))
_register_agg("agg_attr", AggregateSpec(*MONTH, "5m", "level", LogFilter(attrs=(("k", "42"),))))
_register_agg("agg_attr_typed", AggregateSpec(*MONTH, "1h", "service", LogFilter(attrs=(("k", "7.0"),))))
_register_agg("agg_q", AggregateSpec(*MONTH, "1m", None, LogFilter(q="BY USER 1")))
_register_agg("agg_empty", AggregateSpec("2025-08-01T00:00:00Z", "2025-08-02T00:00:00Z", "1m"))
_register_agg("agg_rollup_1m", AggregateSpec(*EDGED, "1m", "level"), rollup=True)
_register_agg("agg_rollup_5m", AggregateSpec(*EDGED, "5m", "service"), rollup=True)
_register_agg("agg_rollup_1h", AggregateSpec(*EDGED, "1h", None, LogFilter(service="svc-5")), rollup=True)
_register_agg("agg_rollup_1d", AggregateSpec(*MONTH, "1d", "level"), rollup=True)
_register_agg(
    "agg_rollup_edges",
    AggregateSpec("2024-01-03T10:00:00.001Z", "2024-01-20T10:00:59.999Z", "1m", "service",
                  LogFilter(level="info")),
    rollup=True,
)
# Both bounds in one second: answered by a plain scan, never counted twice.
_register_agg(
    "agg_same_second",
    AggregateSpec("2024-01-05T12:00:00.100Z", "2024-01-05T12:00:00.900Z", "1m"),
    rollup=True,
)
_register_agg("tenant_agg", AggregateSpec(*MONTH, "1h", "level"), tenant="a", rollup=True)
_register_agg("tenant_agg_null", AggregateSpec(*MONTH, "1d", "service"), tenant=None, rollup=True)


@register(
    "rollup_1s",
    O.with_logs(
        f"SELECT {O.iso(O.bucket_sql('ts', 1))} AS bucket_ts, service, level, tenant_id, count(*) AS n\n"
        "FROM logs GROUP BY 1, 2, 3, 4"
    ),
)
def q_rollup_1s(spark, sf_dir):
    r = build_rollup(logs_of(spark, sf_dir))
    return r.select(iso_ms("bucket_ts").alias("bucket_ts"), "service", "level", "tenant_id", "n")


@register(
    "rollup_compact",
    O.with_logs(
        f"SELECT {O.iso(O.bucket_sql('ts', 1))} AS bucket_ts, service, level, tenant_id, count(*) AS n\n"
        "FROM logs GROUP BY 1, 2, 3, 4"
    ),
)
def q_rollup_compact(spark, sf_dir):
    """Partials written by four interleaved arrival batches, folded into one row per key."""
    logs = logs_of(spark, sf_dir).withColumn("batch", F.col("id") % 4)
    partials = logs.groupBy(
        "batch", bucket_start("ts", 1).alias("bucket_ts"), "service", "level", "tenant_id"
    ).agg(F.count(F.lit(1)).alias("n"))
    folded = compact(partials.drop("batch"))
    return folded.select(iso_ms("bucket_ts").alias("bucket_ts"), "service", "level", "tenant_id", "n")


@register(
    "attr_text",
    O.with_logs(
        "SELECT CAST(id AS VARCHAR) AS id, '{\"k\":\"' || json_extract_string(attributes, '$.k') || '\"}' AS attr_text\n"
        "FROM logs"
    ),
)
def q_attr_text(spark, sf_dir):
    """Historic string-coerced copy of the attributes (P7)."""
    from emberlog.functions.attrs import attributes_as_text

    logs = logs_of(spark, sf_dir)
    return logs.select(F.col("id").cast("string").alias("id"), attributes_as_text("attributes").alias("attr_text"))


# ---------------------------------------------------------------------------
# Listings (F1-F9, P1-P3, K1-K4)
# ---------------------------------------------------------------------------
def _list_oracle(spec: ListSpec, tenant=ALL_TENANTS, limit: int | None = None) -> str:
    n = spec.limit + 1 if limit is None else limit
    return O.with_logs(
        f"SELECT CAST(id AS VARCHAR) AS id, {O.iso('ts')} AS ts, level, service, message, attributes\n"
        f"FROM logs {O.where_sql(spec.filter, tenant, spec.bookmark)}\n"
        f"ORDER BY logs.ts DESC, logs.id DESC LIMIT {n}"
    )


def _register_list(name: str, spec: ListSpec, tenant=ALL_TENANTS):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return L.render_rows(L.list_rows(logs_of(spark, sf_dir), spec, tenant))

    register(name, _list_oracle(spec, tenant))(run)


_register_list("list_all", ListSpec())
_register_list("list_since", ListSpec(LogFilter(since="2024-01-29T12:00:00.000Z"), limit=1000))
_register_list("list_until", ListSpec(LogFilter(until="2024-01-01T06:00:00.000Z"), limit=1000))
_register_list("list_window", ListSpec(LogFilter(since="2024-01-10T00:00:00Z", until="2024-01-10T06:00:00Z"), 1000))
_register_list("list_service", ListSpec(LogFilter(service="svc-2"), limit=250))
_register_list("list_level", ListSpec(LogFilter(level="warn"), limit=50))
_register_list("list_service_level", ListSpec(LogFilter(service="svc-1", level="error"), limit=1000))
_register_list("list_attr", ListSpec(LogFilter(attrs=(("k", "42"),)), limit=1000))
_register_list("list_attr_typed", ListSpec(LogFilter(attrs=(("k", " 0x2A "),)), limit=1000))
_register_list("list_attr_conj", ListSpec(LogFilter(service="svc-4", attrs=(("k", "17"), ("k", "17.0"))), 1000))
_register_list("list_attr_none", ListSpec(LogFilter(attrs=(("k", "forty-two"),)), limit=1000))
_register_list("list_q", ListSpec(LogFilter(q="PURCHASE by USER 2"), limit=1000))
_register_list("list_q_wildcard", ListSpec(LogFilter(q="%"), limit=1000))
_register_list("list_top", ListSpec(LogFilter(service="svc-6"), limit=1000))
_register_list("list_render", ListSpec(LogFilter(level="debug"), limit=10))
_register_list("list_empty", ListSpec(LogFilter(service="does-not-exist")))
_register_list("tenant_list", ListSpec(LogFilter(level="info"), limit=500), tenant="a")
_register_list("tenant_list_null", ListSpec(LogFilter(level="warn"), limit=500), tenant=None)
_register_list(
    "list_bookmark",
    ListSpec(LogFilter(level="error"), limit=100, bookmark=Bookmark(_utc(2024, 1, 15, 12), 5000)),
)


PAGE_SPEC = ListSpec(LogFilter(level="error"), limit=50)


@register(
    "page_next",
    O.with_logs(
        f"SELECT {O.iso('ts')} AS ts, CAST(id AS VARCHAR) AS id FROM (\n"
        f"  SELECT ts, id, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn,\n"
        f"         count(*) OVER () AS n FROM logs {O.where_sql(PAGE_SPEC.filter, ALL_TENANTS)}\n"
        f") t WHERE rn = {PAGE_SPEC.limit} AND n > {PAGE_SPEC.limit}"
    ),
)
def q_page_next(spark, sf_dir):
    bm = L.next_bookmark(logs_of(spark, sf_dir), PAGE_SPEC)
    return bm.select(iso_ms("ts").alias("ts"), F.col("id").cast("string").alias("id"))


@register(
    "list_page2",
    O.with_logs(
        "SELECT CAST(id AS VARCHAR) AS id, "
        + O.iso("ts")
        + " AS ts, level, service, message, attributes FROM (\n"
        f"  SELECT *, row_number() OVER (ORDER BY ts DESC, id DESC) AS rn\n"
        f"  FROM logs {O.where_sql(PAGE_SPEC.filter, ALL_TENANTS)}\n"
        f") t WHERE rn > {PAGE_SPEC.limit} AND rn <= {2 * PAGE_SPEC.limit + 1}"
    ),
)
def q_list_page2(spark, sf_dir):
    """Second page: the client hands back the bookmark of the first page."""
    logs = logs_of(spark, sf_dir)
    _, bm = L.fetch_page(logs, PAGE_SPEC)
    spec2 = ListSpec(PAGE_SPEC.filter, PAGE_SPEC.limit, bm)
    return L.render_rows(L.list_rows(logs, spec2))


PAGE_INDEX_SIZE = 100


@register(
    "page_index",
    O.with_logs(
        f"SELECT page_no, count(*) AS n_rows,\n"
        f"  {O.iso('arg_min(ts, rk)')} AS first_ts, arg_min(id, rk) AS first_id,\n"
        f"  {O.iso('arg_max(ts, rk)')} AS last_ts, arg_max(id, rk) AS last_id\n"
        f"FROM (SELECT ts, id, rk, rk // {PAGE_INDEX_SIZE} AS page_no FROM (\n"
        f"  SELECT ts, id, row_number() OVER (ORDER BY ts DESC, id DESC) - 1 AS rk FROM logs) r) p\n"
        f"GROUP BY page_no"
    ),
)
def q_page_index(spark, sf_dir):
    idx = L.page_index(logs_of(spark, sf_dir), LogFilter(), PAGE_INDEX_SIZE)
    return idx.select(
        "page_no",
        "n_rows",
        iso_ms("first_ts").alias("first_ts"),
        "first_id",
        iso_ms("last_ts").alias("last_ts"),
        "last_id",
    )

from emberlog.plans import q_ingest  # noqa: E402,F401
from emberlog.plans import q_access  # noqa: E402,F401
from emberlog.plans import q_reports  # noqa: E402,F401
from emberlog.plans import q_stream  # noqa: E402,F401
from emberlog.plans import q_store  # noqa: E402,F401
