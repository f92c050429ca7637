"""Retention: expiry counts, horizon bounds, and the file-level sweep of a store."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.aggregate import bucket_counts, scan_counts
from emberlog.operators.retention import check_hours, expire, expire_store, expired_count
from emberlog.plans.ingest import ingest_batch
from emberlog.sources.store import LogStore
from emberlog.spec import AggregateSpec

from helpers import logs_df, utc

AS_OF = utc(2026, 7, 20, 12, 0, 0)


def rows_at(offsets_h):
    return [(i + 1, AS_OF - timedelta(hours=h), "info", "s", "fresh" if h < 2 else "old", {}, None)
            for i, h in enumerate(offsets_h)]


def test_expiry_counts(spark):
    logs = logs_df(spark, rows_at([48, 48, 1]))
    assert expired_count(logs, AS_OF, 2).first()[0] == 2
    kept, _, _ = expire(logs, None, AS_OF, 2)
    assert [r["message"] for r in kept.collect()] == ["fresh"]
    many = logs_df(spark, rows_at([24] * 25))
    assert expired_count(many, AS_OF, 2).first()[0] == 25
    assert expired_count(many, AS_OF, 8760).first()[0] == 0


@pytest.mark.parametrize("h", [0, 8761, -1, 1.5])
def test_horizon_bounds(h):
    with pytest.raises(ValueError):
        check_hours(h)


def test_store_sweep_keeps_rollup_in_step(spark, tmp_root):
    store = LogStore(tmp_root)
    base = utc(2026, 7, 18, 23, 59, 59)
    stamps = [base + timedelta(milliseconds=250 * k) for k in range(16)] + [utc(2026, 7, 15, 1), utc(2026, 7, 20, 9)]
    body = {"logs": [{"timestamp": t.isoformat().replace("+00:00", "Z"), "level": "info", "service": "s",
                      "message": "m"} for t in stamps]}
    docs = spark.createDataFrame([("d", json.dumps(body))], "doc_id string, value string")
    ingest_batch(store, docs, 1, as_of=AS_OF)
    as_of = utc(2026, 7, 20, 12, 0, 0, 500000)
    hours = 36  # cutoff 2026-07-19T00:00:00.5, inside a second that holds rows
    cut = as_of - timedelta(hours=hours)
    removed = expire_store(store, as_of, hours, spark)
    assert removed == sum(1 for t in stamps if t < cut)
    logs = store.logs(spark)
    assert logs.where(F.col("ts") < F.lit(cut)).count() == 0
    assert logs.count() == sum(1 for t in stamps if t >= cut)
    days = sorted(r["dt"].isoformat() for r in store.raw_logs(spark).select("dt").distinct().collect())
    assert days == ["2026-07-19", "2026-07-20"]
    spec = AggregateSpec("2026-07-01T00:00:00Z", "2026-07-31T00:00:00Z", "1h")
    a = sorted(tuple(r) for r in bucket_counts(logs, store.counts(spark), spec).collect())
    b = sorted(tuple(r) for r in scan_counts(logs, spec).collect())
    assert a == b
    # Running the same sweep again changes nothing.
    assert expire_store(store, as_of, hours, spark) == 0
    assert store.logs(spark).count() == sum(1 for t in stamps if t >= cut)
    assert sorted(tuple(r) for r in bucket_counts(store.logs(spark), store.counts(spark), spec).collect()) == b


def test_sweep_of_many_batches_and_after_an_interruption(spark, tmp_root, monkeypatch):
    """Batches that lose all, some or none of the cutoff day; a crash in the middle is made good by the next sweep."""
    store = LogStore(tmp_root)
    times = {1: ["2026-07-17T01:00:00Z", "2026-07-18T03:00:00.2Z"], 2: ["2026-07-18T03:00:00.2Z", "2026-07-18T03:00:00.7Z", "2026-07-18T09:00:00Z"],
             3: ["2026-07-18T09:00:01Z", "2026-07-19T01:00:00Z"], 4: ["2026-07-16T01:00:00Z"]}
    for b, stamps in times.items():
        body = {"logs": [{"timestamp": t, "level": "info", "service": "s", "message": str(b)} for t in stamps]}
        ingest_batch(store, spark.createDataFrame([(f"d{b}", json.dumps(body))], "doc_id string, value string"), b, as_of=AS_OF)
    as_of, hours = utc(2026, 7, 19, 3, 0, 0, 500000), 24  # cutoff 2026-07-18T03:00:00.5
    with monkeypatch.context() as m:
        write = LogStore.write_partitions
        m.setattr(LogStore, "write_partitions", lambda self, df, table, *a, **k: write(self, df, table, *a, **k) if table == "logs" else (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            expire_store(store, as_of, hours, spark)
    expire_store(store, as_of, hours, spark)
    got = sorted((r["message"], r["ts"].isoformat()) for r in store.logs(spark).collect())
    assert got == [("2", "2026-07-18T03:00:00.700000"), ("2", "2026-07-18T09:00:00"), ("3", "2026-07-18T09:00:01"), ("3", "2026-07-19T01:00:00")]
    assert sorted(r["batch_id"] for r in store.raw_logs(spark).select("batch_id").distinct().collect()) == [2, 3]
    assert store.counts(spark).agg(F.sum("n"), F.count("*")).first() == (4, 4)
    assert expire_store(store, as_of, hours, spark) == 0 and store.logs(spark).count() == 4


def test_a_batch_after_a_sweep_is_one_batch(spark, tmp_root):
    """Twelve rows of one day in two batches stay twelve, whatever was swept before."""
    store = LogStore(tmp_root)
    for b in range(2):
        body = {"logs": [{"timestamp": f"2026-07-20T0{b}:00:{k:02d}Z", "level": "info", "service": "s", "message": "m"} for k in range(6)]}
        ingest_batch(store, spark.createDataFrame([(f"d{b}", json.dumps(body))], "doc_id string, value string"), b, as_of=AS_OF)
        expire_store(store, AS_OF, 24, spark)
    assert store.logs(spark).count() == 12 and store.counts(spark).agg(F.sum("n")).first()[0] == 12
