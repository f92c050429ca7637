"""Streaming ingest: whole-file documents, late data, replay without double counts."""

import json
import os

from pyspark.sql import functions as F

from emberlog.operators.rollup import compact
from emberlog.plans.ingest import ingest_batch
from emberlog.sources.store import LogStore
from emberlog.streaming.ingest_stream import document_stream, run_to_end, start_ingest

from helpers import utc

AS_OF = utc(2026, 7, 20, 15, 0)


def write_doc(folder, name, entries):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(json.dumps({"logs": entries}))


def e(ts, level="info"):
    return {"timestamp": ts, "level": level, "service": "svc", "message": "m"}


def test_stream_runs_late_and_replay(spark, tmp_root):
    src, store = f"{tmp_root}/in", LogStore(f"{tmp_root}/store")
    ckpt = f"{tmp_root}/ckpt"
    write_doc(src, "a.json", [e("2026-07-20T14:01:30Z"), e("2026-07-20T14:01:30.5Z"), e("bad")])
    write_doc(src, "b.json", [e("2026-07-20T14:02:00Z", "error")])
    q = start_ingest(document_stream(spark, src, "text", max_files_per_trigger=1), store, ckpt, as_of=AS_OF)
    run_to_end(q, 120)
    assert store.logs(spark).count() == 3
    assert store.rejected(spark).count() == 1
    assert store.commits(spark).count() == 2  # one micro-batch per file
    # A late document (six years old) arrives later, same checkpoint.
    write_doc(src, "c.json", [e("2020-07-20T14:01:30Z"), e("2026-07-20T14:01:30.9Z")])
    run_to_end(start_ingest(document_stream(spark, src, "text", 1), store, ckpt, as_of=AS_OF), 120)
    assert store.logs(spark).count() == 5
    counts = {(r["bucket_ts"].isoformat(), r["level"]): r["n"] for r in compact(store.counts(spark)).collect()}
    assert counts[("2026-07-20T14:01:30", "info")] == 3
    assert counts[("2020-07-20T14:01:30", "info")] == 1
    # Retry of the first batch with its own input: nothing doubles.
    first = store.receipts(spark).where(F.col("batch_id") == 0).select("doc_id")
    docs = spark.read.text(src, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    ingest_batch(store, docs.join(first, "doc_id", "left_semi"), 0, as_of=AS_OF)
    assert store.logs(spark).count() == 5
    assert compact(store.counts(spark)).agg(F.sum("n")).first()[0] == 5


def test_size_bounded_batches_with_processing_time_trigger(spark, tmp_root):
    src, store = f"{tmp_root}/in", LogStore(f"{tmp_root}/store")
    for i in range(4):
        write_doc(src, f"r{i}.json", [e(f"2026-07-20T14:0{i}:00Z")])
    size = os.path.getsize(f"{src}/r0.json")
    docs = document_stream(spark, src, "text", max_bytes_per_trigger=2 * size + 1)
    q = start_ingest(docs, store, f"{tmp_root}/ckpt", as_of=AS_OF, trigger={"processingTime": "1 second"})
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert store.logs(spark).count() == 4
    assert store.commits(spark).count() == 2  # two documents per micro-batch


def test_stream_with_key_check(spark, tmp_root):
    from emberlog.operators.access import key_rows

    keys = key_rows(spark.createDataFrame(
        [("k-a", "a", ["ingest", "query"], "a"), ("k-q", "q", ["query"], None)],
        "key string, name string, scopes array<string>, tenant_id string"))
    src, store = f"{tmp_root}/in", LogStore(f"{tmp_root}/store")
    rows = [("d1", json.dumps({"logs": [e("2026-07-20T14:01:00Z")]}), None, "k-a"),
            ("d2", json.dumps({"logs": [e("2026-07-20T14:02:00Z")]}), None, "k-q"),
            ("d3", json.dumps({"logs": [e("2026-07-20T14:03:00Z")]}), None, "nope")]
    spark.createDataFrame(rows, "doc_id string, value string, tenant_id string, api_key string") \
        .coalesce(1).write.parquet(src)
    q = start_ingest(document_stream(spark, src, "parquet"), store, f"{tmp_root}/ckpt", as_of=AS_OF, keys=keys)
    run_to_end(q, 120)
    assert [(r["tenant_id"], r["ts"].minute) for r in store.logs(spark).collect()] == [("a", 1)]
    rec = {r["doc_id"]: (r["status"], r["error"]) for r in store.receipts(spark).collect()}
    assert rec == {"d1": ("accepted", None),
                   "d2": ("denied", "403 insufficient permissions: scope 'ingest' required"),
                   "d3": ("denied", "401 invalid api key")}


def test_stream_store_makes_the_requests_once(spark, tmp_root, monkeypatch):
    """Each landing folder, and the sample of its range exchange, made all bodies anew."""
    from emberlog.plans import q_stream

    spark.sql("SELECT id AS event_id, timestampadd(DAY, CAST(id % 30 AS INT), timestamp'2024-01-01') AS ts, id AS user_id, 'view' AS event_type, "
              "1.0D AS value, '{\"k\": 1}' AS props FROM range(100)").write.parquet(f"{tmp_root}/events.parquet")
    calls, make = [], q_stream.requests_from_events
    monkeypatch.setattr(q_stream, "requests_from_events", lambda *a: calls.append(a) or make(*a))
    store = q_stream.stream_store(spark, tmp_root)
    assert len(calls) == 1
    # Nine of twenty are accepted; one of twenty is two entries.
    assert store.logs(spark).count() == 45 and store.receipts(spark).count() == 100
