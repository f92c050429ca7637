"""Batch ingest: documents → validated rows → log store, visible on commit.

One batch (a load number, or a stream's epoch id) is written as partitions
``batch_id=N`` of logs, rollup partials, rejections and receipts; the commit
marker is written last. A batch that is committed stays as it is: sending its
number again writes nothing and returns the stored totals, whatever the input
or the clock. An attempt that ended before its marker is removed and done anew.

A document is parsed and all its entries are validated in one narrow pass, which also gives its receipt
with the list of rejections. Ids are ``batch_id * 2**32 + position``: the entries in the order of the document ids, and within
a document in the order of the body, counted without gaps (rejected entries keep their place). They depend on the documents
alone, not on files, partitions or cores.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import schema as S
from emberlog.functions.spread import spread
from emberlog.functions.written import written
from emberlog.operators.access import verdicts
from emberlog.operators.ranking import with_rank
from emberlog.operators.rollup import build_rollup
from emberlog.operators.validate import check_entries
from emberlog.session import configure
from emberlog.sources.envelopes import parse_envelopes
from emberlog.sources.store import LogStore

ID_SHIFT = 2**32
LOG_COLUMNS = ["id", "ts", "level", "service", "message", "attributes", "tenant_id"]


@dataclass
class BatchFrames:
    documents: DataFrame  # doc_id, tenant_id, errors, checked (an array of its validated entries), n_entries, body_hash
    entries: DataFrame  # entries only: doc_id, entry_index, reason, raw, typed columns
    accepted: DataFrame  # logs rows without id, + dt
    rejected: DataFrame
    receipts: DataFrame
    bad: DataFrame


def parse_batch(docs: DataFrame, tenant: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Spread and parse the documents: doc_id, value, tenant_id,
    logs, envelope_error and auth_error.

    With ``keys`` (the key table) and an ``api_key`` column, each document is
    first checked for the ``ingest`` scope: refused documents are not parsed
    and carry the verdict; accepted ones are stamped with the key's tenant.
    """
    configure(docs.sparkSession)
    if keys is not None and "api_key" in docs.columns:
        checked = verdicts(docs, keys, "ingest", key_col="api_key")
        ok = F.col("verdict") == S.VERDICT_OK
        docs = checked.select(
            "doc_id", F.when(ok, F.col("value")).alias("value"), F.col("key_tenant").alias("tenant_id"),
            F.when(~ok, F.col("verdict")).alias("auth_error"),
        )
    else:
        if "tenant_id" not in docs.columns:
            docs = docs.withColumn("tenant_id", F.lit(tenant).cast("string"))
        docs = docs.select("doc_id", "value", "tenant_id", F.lit(None).cast("string").alias("auth_error"))
    parsed = parse_envelopes(spread(docs, "doc_id"))
    return parsed.withColumn("envelope_error", F.coalesce("auth_error", "envelope_error"))


def validate_parsed(parsed: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """One row for each document, with its validated entries as array ``checked``. Narrow."""
    checked = F.coalesce(check_entries(F.col("logs"), as_of, F.col("value")), F.array())
    return parsed.select("doc_id", "tenant_id", "envelope_error", "auth_error", F.xxhash64("value").alias("body_hash"), checked.alias("checked"),
                         F.coalesce(F.size("logs"), F.lit(0)).cast("bigint").alias("n_entries"))


def validate_batch(docs: DataFrame, as_of: datetime | None = None, tenant: str | None = None,
                   keys: DataFrame | None = None) -> BatchFrames:
    """``docs`` has (doc_id, value) and optionally ``tenant_id`` (the caller's tenant
    per document) or ``api_key`` (checked against ``keys``); otherwise every
    row is stamped with ``tenant``."""
    return frames_of(validate_parsed(parse_batch(docs, tenant, keys), as_of))


def _exploded(documents: DataFrame, *columns: str) -> DataFrame:
    # The plain form would first filter on the array, and so validate every document a second time.
    out = documents.select(*columns, F.posexplode_outer("checked").alias("entry_index", "e"))
    return out.where("entry_index IS NOT NULL").select(*columns, "entry_index", "e.*")


def _stored(entries: DataFrame) -> DataFrame:
    """Accepted entries as log rows; attributes stay VARIANT, so probes need no JSON parsing."""
    rows = entries.where("reason IS NULL").withColumnRenamed("attributes_v", "attributes")
    return rows.select(*[c for c in LOG_COLUMNS if c in rows.columns], F.to_date("ts").alias("dt"))


def receipts_of(documents: DataFrame) -> DataFrame:
    """What the sender of each document is told: counts, status, error and the rejected entries with their reasons, in order."""
    indexed = F.transform("checked", lambda e, i: F.struct(i.alias("index"), e["reason"].alias("reason")))
    out = documents.withColumn("rejections", F.filter(indexed, lambda r: r["reason"].isNotNull()))
    rejected = F.size("rejections").cast("bigint")
    status = (
        F.when(F.col("auth_error").isNotNull(), F.lit("denied"))
        .when(F.col("envelope_error").isNotNull(), F.lit("bad_batch"))
        .when(F.col("accepted") > 0, F.lit("accepted"))
        .otherwise(F.lit("refused"))
    )
    return out.select("*", (F.col("n_entries") - rejected).alias("accepted"), rejected.alias("rejected")).select(
        "doc_id", "accepted", "rejected", status.alias("status"), F.col("envelope_error").alias("error"), "rejections")


def frames_of(documents: DataFrame) -> BatchFrames:
    """Accepted rows, rejections and receipts of validated documents."""
    entries = _exploded(documents, "doc_id", "tenant_id")
    rejected = entries.where("reason IS NOT NULL").select("doc_id", "entry_index", "reason", "raw")
    # A filter on the error itself would be pushed below, and so validate twice.
    error = F.when(F.col("auth_error").isNull(), F.col("envelope_error"))
    bad = documents.select("doc_id", F.explode_outer(F.array(error)).alias("error")).where("error IS NOT NULL")
    return BatchFrames(documents, entries, _stored(entries), rejected, receipts_of(documents), bad)


def with_ids(documents: DataFrame, batch_id: int, is_written: bool = False) -> DataFrame:
    """Entries of all documents with their ids: block of the batch + entries of earlier documents + place in the document.

    Documents of one id stand in the order of the hash of their bodies. The entries before a document are a prefix sum over
    slices of the document ids (``operators.ranking``), so the ids are the same for any partitioning.
    """
    slim = documents.select("doc_id", "tenant_id", "checked", "n_entries", "body_hash")
    placed = with_rank(slim, ["doc_id", "body_hash"], rank_col="start", weight_col="n_entries", is_written=is_written)
    entries = _exploded(placed, "doc_id", "tenant_id", "start")
    position = F.col("start") + F.col("entry_index")
    # A batch past its block of ids would repeat those of the next one: it fails before anything is committed.
    too_many = F.raise_error(F.lit(f"batch {batch_id} has more than {ID_SHIFT} entries; split it")).cast("bigint")
    block = F.lit(batch_id).cast("bigint") * F.lit(ID_SHIFT)
    return entries.withColumn("id", F.when(position < F.lit(ID_SHIFT), block + position).otherwise(too_many)).drop("start")


def totals_of(store: LogStore, spark, batch_id: int) -> dict:
    """What the stored receipts of a batch add up to."""
    status = F.col("status")
    row = store.raw_receipts(spark).where(F.col("batch_id") == batch_id).agg(
        F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.count_if(status == "bad_batch").alias("bad_documents"),
        F.count_if(status == "denied").alias("denied_documents")).first()
    out = {k: int(row[k] or 0) for k in ("accepted", "rejected", "bad_documents")}
    return out | ({"denied_documents": int(row["denied_documents"])} if row["denied_documents"] else {})


def ingest_batch(store: LogStore, docs: DataFrame, batch_id: int, as_of: datetime | None = None,
                 tenant: str | None = None, keys: DataFrame | None = None, totals: bool = True) -> dict:
    """Validate and write one batch; returns accepted/rejected/bad-document totals.

    Logs, rollup partials (of the same rows), rejections and receipts are written,
    and last the commit marker that makes the batch visible.

    Validated documents are written once to the shared checkpoint folder; ids, rows, rollup, rejections and receipts all read
    that table, so the clock and the input are looked at once in a batch. Rows are rebalanced by day before they are
    written: a batch of one day gets few files, a backfill over many days not a file for each task and day.
    ``totals=False`` skips the summary job (streams read receipts instead).
    """
    spark = docs.sparkSession
    if store.is_committed(spark, batch_id):
        return totals_of(store, spark, batch_id) if totals else {}
    store.clear_uncommitted(spark, batch_id)
    documents = written(validate_parsed(parse_batch(docs, tenant, keys), as_of), "ingest-documents")
    frames = frames_of(documents)
    b = F.lit(batch_id).cast("bigint")
    day = F.col("dt")
    logs = store.with_promoted(_stored(with_ids(documents, batch_id, is_written=True))).withColumn("batch_id", b)
    counts = build_rollup(frames.accepted).withColumn("dt", F.to_date("bucket_ts")).withColumn("batch_id", b)
    tables = [
        (logs.hint("rebalance", day), "logs", ["dt", "batch_id"], "ts"),
        (counts.hint("rebalance", day), "log_counts", ["dt", "batch_id"], "bucket_ts"),
        (frames.rejected.withColumn("batch_id", b), "rejected", ["batch_id"], None),
        (frames.receipts.withColumn("batch_id", b), "receipts", ["batch_id"], None),
    ]
    # Four jobs over one table, at the same time; the first failure is raised, and nothing is committed then.
    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(lambda t: store.write_partitions(*t), tables))
    out = totals_of(store, spark, batch_id) if totals else {}
    store.commit(spark, batch_id)
    return out
