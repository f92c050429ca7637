"""One object for the whole log store: ingest, list, aggregate, retention.

A thin convenience over the operators; every call is a Spark job over the
partitioned store (no data passes through the driver except a listing page).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from emberlog import schema as S
from emberlog.operators.access import verdicts
from emberlog.operators.aggregate import bucket_counts, render_buckets
from emberlog.operators.listing import fetch_page_by_days
from emberlog.operators.report import reconcile
from emberlog.operators.retention import cutoff_of, expire_store
from emberlog.plans.ingest import ingest_batch
from emberlog.session import checkpoint_dir, configure
from emberlog.sources.catalogue import Catalogue
from emberlog.sources.envelopes import read_documents
from emberlog.sources.store import LogStore
from emberlog.spec import ALL_TENANTS, AggregateSpec, Bookmark, ListSpec
from emberlog.streaming.ingest_stream import document_stream, start_ingest


class LogService:
    def __init__(self, spark: SparkSession, root: str, promoted: tuple[str, ...] = (),
                 database: str | None = None):
        """``promoted``: attribute keys that are asked for often (see ``LogStore``). With a ``database`` the tables are
        kept in Spark's catalogue and read from it (see ``Catalogue``)."""
        self.spark = configure(spark)
        self.store = LogStore(root, tuple(promoted))
        self.catalogue = Catalogue(self.spark, self.store, database).open() if database else None

    # -- ingest -------------------------------------------------------------
    def ingest(self, docs: DataFrame, batch_id: int, as_of: datetime | None = None,
               tenant: str | None = None, keys: DataFrame | None = None) -> dict:
        """``docs``: (doc_id, value[, tenant_id | api_key]) request bodies; one store batch.
        With ``keys`` each document's ``api_key`` must hold the ingest scope. A batch that is
        committed is not written again; its totals are returned."""
        out = ingest_batch(self.store, docs, batch_id, as_of=as_of, tenant=tenant, keys=keys)
        if self.catalogue:
            self.catalogue.add_batch(batch_id)
        return out

    def sync(self) -> list[int]:
        """Bring the catalogue up to the committed batches, those of a stream for example."""
        return self.catalogue.sync() if self.catalogue else []

    def ingest_files(self, path: str, batch_id: int, as_of: datetime | None = None,
                     tenant: str | None = None) -> dict:
        """Every file under ``path`` is one request body."""
        return self.ingest(read_documents(self.spark, path), batch_id, as_of, tenant)

    def start_stream(self, path: str, fmt: str = "text", checkpoint_location: str | None = None,
                     max_files_per_trigger: int | None = None, max_bytes_per_trigger: int | str | None = None,
                     trigger: dict | None = None,
                     batch_base: int = 0, tenant: str | None = None,
                     keys: DataFrame | None = None) -> StreamingQuery:
        ckpt = checkpoint_location or f"{checkpoint_dir(self.spark)}/ingest-stream"
        docs = document_stream(self.spark, path, fmt, max_files_per_trigger, max_bytes_per_trigger)
        return start_ingest(docs, self.store, ckpt, tenant=tenant, batch_base=batch_base, trigger=trigger,
                            keys=keys)

    # -- read ---------------------------------------------------------------
    def logs(self) -> DataFrame:
        return self.catalogue.logs() if self.catalogue else self.store.logs(self.spark)

    def counts(self) -> DataFrame:
        return self.catalogue.counts() if self.catalogue else self.store.counts(self.spark)

    def receipts(self) -> DataFrame:
        """Per-document outcome of committed batches (accepted, rejected, status, error)."""
        return self.catalogue.receipts() if self.catalogue else self.store.receipts(self.spark)

    def rejected(self) -> DataFrame:
        """Rejected entries of committed batches with their reasons."""
        return self.catalogue.rejected() if self.catalogue else self.store.rejected(self.spark)

    def reconcile(self) -> DataFrame:
        """Per batch: accepted according to receipts vs rows visible."""
        return reconcile(self.receipts(), self.logs())

    def list(self, spec: ListSpec = ListSpec(), tenant=ALL_TENANTS) -> tuple[list, Bookmark | None]:
        """One page newest first and the bookmark of the next page (or None)."""
        days = self.catalogue.days() if self.catalogue else self.store.days(self.spark)
        return fetch_page_by_days(self.logs(), days, spec, tenant)

    def aggregate(self, spec: AggregateSpec, tenant=ALL_TENANTS) -> DataFrame:
        """Buckets (bucket_start ISO text, group_name, count), oldest first."""
        return render_buckets(bucket_counts(self.logs(), self.counts(), spec, tenant))

    # -- access -------------------------------------------------------------
    def seed_keys(self, keys: DataFrame) -> int:
        """Store plaintext keys (key, name, scopes, tenant_id) as hashes; keys that are stored already stay as they are."""
        return self.store.seed_keys(self.spark, keys)

    def keys(self) -> DataFrame:
        """The stored key table, for ``keys`` of the other calls."""
        return self.store.keys(self.spark)

    def scope_of(self, keys: DataFrame, api_key: str | None, need: str = "query"):
        """(verdict, tenant scope) of one caller: the verdict join on a one-row
        request. With access on, a key without tenant reads rows without tenant."""
        req = self.spark.createDataFrame([(api_key,)], "api_key string")
        row = verdicts(req, keys, need).select("verdict", "key_tenant").first()
        return row["verdict"], row["key_tenant"]

    def list_for_key(self, keys: DataFrame, api_key: str | None, spec: ListSpec = ListSpec()):
        """A page as the holder of ``api_key`` sees it; raises PermissionError on 401/403."""
        verdict, tenant = self.scope_of(keys, api_key, "query")
        if verdict != S.VERDICT_OK:
            raise PermissionError(verdict)
        return self.list(spec, tenant)

    def aggregate_for_key(self, keys: DataFrame, api_key: str | None, spec: AggregateSpec) -> DataFrame:
        verdict, tenant = self.scope_of(keys, api_key, "query")
        if verdict != S.VERDICT_OK:
            raise PermissionError(verdict)
        return self.aggregate(spec, tenant)

    # -- upkeep -------------------------------------------------------------
    def expire(self, as_of: datetime, hours: int = S.RETENTION_HOURS_DEFAULT) -> int:
        removed = expire_store(self.store, as_of, hours, self.spark)
        if self.catalogue:
            self.catalogue.drop_until(cutoff_of(as_of, hours).date().isoformat())
        return removed
