"""Catalog entries for streaming ingest (T1-T6), visibility (J4) and reconciliation (M3).

The request documents derived from ``events`` are landed as Parquet in the
session's shared checkpoint folder and ingested by a Structured Streaming
query (``availableNow``, two micro-batches in a run). The resulting store is
shared by the entries of one Spark application.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlog.functions.timefns import iso_ms
from emberlog.functions.written import written
from emberlog.operators.listing import attributes_text
from emberlog.operators.report import reconcile
from emberlog.operators.rollup import compact
from emberlog.plans import oracle as O
from emberlog.plans.catalog import register
from emberlog.plans.ingest import ID_SHIFT, ingest_batch
from emberlog.plans.q_ingest import ACCEPT_SQL, REQ_CTE
from emberlog.session import checkpoint_dir, configure
from emberlog.sources.requests import AS_OF, requests_from_events
from emberlog.sources.store import LogStore
from emberlog.spec import to_utc
from emberlog.streaming.ingest_stream import document_stream, run_to_end, start_ingest

LATE_SPLIT = "2024-01-15T00:00:00Z"  # documents before this day arrive in a later run
BATCHES = 2  # micro-batches of a run
DOCS_PER_FILE = 200_000
_STORES: dict[tuple, LogStore] = {}


def _land(docs, root, name, cond) -> tuple[str, int]:
    """The folder of the landed documents, and how many of its files make a micro-batch. The files become more as the
    documents do, so that no task writes or reads half of a run."""
    mine = docs.where(cond).select("doc_id", "value", "tenant_id")
    files = max(1, -(-mine.count() // (BATCHES * DOCS_PER_FILE)))
    mine.repartitionByRange(BATCHES * files, "doc_id").write.parquet(f"{root}/{name}")
    return f"{root}/{name}", files


def stream_store(spark, sf_dir) -> LogStore:
    """Ingest every request via two stream runs into one store: on-time
    documents first, then the late ones (older timestamps), which arrive as
    later batches and are added to their old buckets."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _STORES:
        return _STORES[key]
    configure(spark)
    root = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    store = LogStore(f"{root}/store")
    is_late = F.coalesce(F.get_json_object("value", "$.logs[0].timestamp") < F.lit(LATE_SPLIT), F.lit(False))
    # Made once: a range exchange reads its input twice, and each run has its own.
    docs = written(requests_from_events(spark, sf_dir).select("doc_id", "value", "tenant_id", is_late.alias("late")), "stream-requests")
    on_time = _land(docs, root, "in/0", ~F.col("late"))
    late = _land(docs, root, "in/1", F.col("late"))
    ckpt = f"{root}/checkpoint"
    for (path, files), base in ((on_time, 0), (late, 1000)):
        q = start_ingest(document_stream(spark, path, "parquet", max_files_per_trigger=files), store,
                         f"{ckpt}/{base}", as_of=to_utc(AS_OF), batch_base=base)
        run_to_end(q)
    _STORES[key] = store
    return store


STREAM_LOGS_SQL = O.with_logs(
    "SELECT ts, level, service, message, attributes, tenant_id FROM ("
    + ACCEPT_SQL
    + ") a",
    REQ_CTE,
)


@register("stream_ingest", STREAM_LOGS_SQL)
def q_stream_ingest(spark, sf_dir):
    logs = stream_store(spark, sf_dir).logs(spark)
    return logs.select(iso_ms("ts").alias("ts"), "level", "service", "message",
                       attributes_text(logs).alias("attributes"), "tenant_id")


ROLLUP_SQL = O.with_logs(
    "SELECT " + O.iso(O.bucket_sql("ts", 1)) + " AS bucket_ts, service, level, tenant_id, count(*) AS n\n"
    "FROM (SELECT CAST(ts AS TIMESTAMP) AS ts, level, service, tenant_id FROM req WHERE sel >= 11) a\n"
    "GROUP BY 1, 2, 3, 4",
    REQ_CTE,
)


@register("stream_rollup", ROLLUP_SQL)
def q_stream_rollup(spark, sf_dir):
    counts = compact(stream_store(spark, sf_dir).counts(spark))
    return counts.select(iso_ms("bucket_ts").alias("bucket_ts"), "service", "level", "tenant_id", "n")


@register(
    "stream_late",
    O.with_logs(
        "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM req WHERE sel >= 11 GROUP BY 1", REQ_CTE
    ),
)
def q_stream_late(spark, sf_dir):
    """Rows per day after the late run: old days received their late rows."""
    logs = stream_store(spark, sf_dir).logs(spark)
    return logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "stream_replay",
    O.with_logs(
        "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM req WHERE sel >= 11 GROUP BY 1", REQ_CTE
    ),
)
def q_stream_replay(spark, sf_dir):
    """Retry of an already written batch (same id, same input): counts do not move."""
    store = stream_store(spark, sf_dir)
    first = int(store.raw_logs(spark).agg(F.min("batch_id")).first()[0])
    landed = store.root.rsplit("/", 1)[0] + "/in"
    # The batch's own documents, found through its receipts.
    mine = store.receipts(spark).where(F.col("batch_id") == first).select("doc_id")
    docs = spark.read.parquet(f"{landed}/0", f"{landed}/1").join(mine, "doc_id", "left_semi")
    ingest_batch(store, docs, first, as_of=to_utc(AS_OF))
    counts = store.counts(spark)
    return counts.groupBy(F.date_format("bucket_ts", "yyyy-MM-dd").alias("dt")).agg(F.sum("n").alias("n"))


@register(
    "visible_logs",
    O.with_logs(
        "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM req WHERE sel >= 11 GROUP BY 1", REQ_CTE
    ),
)
def q_visible_logs(spark, sf_dir):
    """A batch whose writer died before its commit marker stays invisible."""
    store = stream_store(spark, sf_dir)
    orphan_id = 999_999
    if not store.raw_logs(spark).where(F.col("batch_id") == orphan_id).take(1):
        # A writer that died after writing a full copy of every row, before its marker.
        copy = store.logs(spark).withColumn(
            "id", F.col("id") % F.lit(ID_SHIFT) + F.lit(orphan_id * ID_SHIFT)
        ).withColumn("batch_id", F.lit(orphan_id).cast("bigint"))
        store.write_partitions(copy, "logs", ["dt", "batch_id"], "ts")
    logs = store.logs(spark)
    return logs.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "reconcile",
    O.with_logs("SELECT count(*) AS accepted, count(*) AS visible, TRUE AS consistent FROM req WHERE sel >= 11",
                REQ_CTE),
)
def q_reconcile(spark, sf_dir):
    """Receipts' accepted total equals the visible rows, batch by batch."""
    store = stream_store(spark, sf_dir)
    per_batch = reconcile(store.receipts(spark), store.logs(spark))
    return per_batch.agg(
        F.sum("accepted").alias("accepted"), F.sum("visible").alias("visible"),
        F.bool_and("consistent").alias("consistent"),
    )


@register(
    "store_compact",
    O.with_logs(
        "SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n, count(*) AS rollup_n FROM req WHERE sel >= 11 GROUP BY 1",
        REQ_CTE,
    ),
)
def q_store_compact(spark, sf_dir):
    """Three interleaved batches; rows of each day, and the sum of its partials folded to one for each key."""
    configure(spark)
    store = LogStore(f"{checkpoint_dir(spark)}/compact-{uuid.uuid4().hex}")
    docs = requests_from_events(spark, sf_dir).select("doc_id", "value", "tenant_id")
    # Three interleaved arrival batches that together hold every document:
    # thirds of the 64-bit hash range of the document id.
    h = F.xxhash64("doc_id")
    cuts = [-(2**63), -(2**63) // 3, (2**63 - 1) // 3]
    for b in range(3):
        part = docs.where((h >= F.lit(cuts[b])) & (h < F.lit(cuts[b + 1])) if b < 2 else (h >= F.lit(cuts[b])))
        ingest_batch(store, part, b, as_of=to_utc(AS_OF))
    rows = store.logs(spark).groupBy(F.date_format("dt", "yyyy-MM-dd").alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    day = F.date_format("bucket_ts", "yyyy-MM-dd").alias("dt")
    counts = compact(store.counts(spark)).groupBy(day).agg(F.sum("n").alias("rollup_n"))
    return rows.join(counts, "dt", "full_outer")
