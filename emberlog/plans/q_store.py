"""Catalog entries that read a store: promoted attribute keys (F5), catalogue tables (S5, S6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlog.operators import aggregate as A
from emberlog.operators import listing as L
from emberlog.plans import oracle as O
from emberlog.plans.catalog import MONTH, register
from emberlog.plans.ingest import ingest_batch
from emberlog.plans.q_ingest import REQ_CTE
from emberlog.session import checkpoint_dir, configure
from emberlog.sources.catalogue import Catalogue
from emberlog.sources.requests import AS_OF, requests_from_events
from emberlog.sources.store import LogStore
from emberlog.spec import AggregateSpec, ListSpec, LogFilter, to_utc

PROMOTED = ("k", "ok")
_STORES: dict[tuple, LogStore] = {}


def promoted_store(spark, sf_dir) -> LogStore:
    """Every request of the driver's events in two batches: the first was written before the keys were promoted, the second after."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        root = f"{checkpoint_dir(spark)}/promoted-{uuid.uuid4().hex}"
        docs = requests_from_events(spark, sf_dir).select("doc_id", "value", "tenant_id")
        early = F.xxhash64("doc_id") < 0
        ingest_batch(LogStore(root), docs.where(early), 0, as_of=to_utc(AS_OF), totals=False)
        _STORES[key] = LogStore(root, PROMOTED)
        ingest_batch(_STORES[key], docs.where(~early), 1, as_of=to_utc(AS_OF), totals=False)
    return _STORES[key]


# The stored rows: one request in twenty has its number as text and a boolean beside it.
STORED_CTE = REQ_CTE + """,
stored AS (SELECT * REPLACE (CASE WHEN sel = 11 THEN '{"k":"' || json_extract_string(attributes, '$.k') || '","ok":true}' ELSE attributes END
                             AS attributes) FROM req WHERE sel >= 11)"""


def _agg(name: str, attrs: tuple) -> None:
    spec = AggregateSpec(*MONTH, "1d", "service", LogFilter(attrs=attrs))

    def run(spark, sf_dir):
        return A.render_buckets(A.scan_counts(promoted_store(spark, sf_dir).logs(spark), spec))

    register(name, O.with_logs(
        f"SELECT {O.iso(O.bucket_sql('ts', spec.width_seconds))} AS bucket_start, service AS group_name, count(*) AS count\n"
        f"FROM stored {O.where_sql(spec.window_filter(), A.ALL_TENANTS)} GROUP BY 1, 2", STORED_CTE))(run)


# Text and number are told apart: 42 finds both, 42.0 the number only.
_agg("promoted_agg", (("k", "42"),))
_agg("promoted_agg_number", (("k", "42.0"),))
_agg("promoted_agg_bool", (("ok", "true"),))

LIST = ListSpec(LogFilter(attrs=(("ok", "true"), ("k", "17"))), limit=1000)


@register("promoted_list", O.with_logs(
    f"SELECT {O.iso('ts')} AS ts, level, service, message, attributes FROM stored {O.where_sql(LIST.filter, A.ALL_TENANTS)}", STORED_CTE))
def q_promoted_list(spark, sf_dir):
    """A page by two promoted keys. Ids are given at ingest, so the page is compared without them."""
    return L.render_rows(L.list_rows(promoted_store(spark, sf_dir).logs(spark), LIST)).drop("id")


EDGED = AggregateSpec("2024-01-04T05:06:07.089Z", "2024-01-26T20:10:30.500Z", "1h", "level", LogFilter(service="svc-2"))


@register("catalogue_agg", O.with_logs(
    f"SELECT {O.iso(O.bucket_sql('ts', EDGED.width_seconds))} AS bucket_start, level AS group_name, count(*) AS count\n"
    f"FROM stored {O.where_sql(EDGED.window_filter(), A.ALL_TENANTS)} GROUP BY 1, 2", STORED_CTE))
def q_catalogue_agg(spark, sf_dir):
    """Counts from the catalogue's rollup table and the raw rows of both edges."""
    store = promoted_store(spark, sf_dir)
    tables = Catalogue(spark, store, f"emberlog_{store.root.rsplit('-', 1)[1]}").open()
    return A.render_buckets(A.bucket_counts(tables.logs(), tables.counts(), EDGED))
