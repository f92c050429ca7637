"""Access verdicts, key seeding and tenant isolation (key table as a broadcast dimension)."""

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from emberlog.operators.access import key_rows, seed_keys, stamp_tenant, verdicts
from emberlog.operators.aggregate import bucket_counts, render_buckets
from emberlog.operators.listing import list_rows
from emberlog.plans.ingest import ingest_batch
from emberlog.sources.store import LogStore
from emberlog.spec import AggregateSpec, ListSpec, LogFilter

KEYS = [
    ("test-loadgen-secret", "loadgen", ["ingest", "query"], None),
    ("ingest-only-key", "ingest", ["ingest"], None),
    ("tenant-a-key", "a", ["ingest", "query"], "a"),
    ("tenant-b-key", "b", ["ingest", "query"], "b"),
]
AS_OF = datetime(2026, 7, 20, 16, 0, tzinfo=timezone.utc)


def keys_df(spark, rows=KEYS):
    return spark.createDataFrame(rows, "key string, name string, scopes array<string>, tenant_id string")


def test_verdicts(spark):
    keys = key_rows(keys_df(spark))
    assert "key" not in keys.columns
    reqs = spark.createDataFrame(
        [(1, None, "ingest"), (2, "", "query"), (3, "nope", "query"), (4, "ingest-only-key", "ingest"),
         (5, "ingest-only-key", "query"), (6, "tenant-a-key", "query"), (7, "x" * 513, "query"),
         (8, "test-loadgen-secret", "query")],
        "rid int, api_key string, need string",
    )
    got = {r["rid"]: (r["verdict"], r["key_tenant"]) for r in verdicts(reqs, keys, F.col("need")).collect()}
    assert got[1][0] == got[2][0] == got[7][0] == "401 missing or malformed credentials"
    assert got[3][0] == "401 invalid api key"
    assert got[4] == ("ok", None)
    assert got[5][0] == "403 insufficient permissions: scope 'query' required"
    assert got[6] == ("ok", "a")
    assert got[8] == ("ok", None)


def test_seed_is_idempotent(spark):
    first = seed_keys(None, keys_df(spark, KEYS[:2]))
    again = seed_keys(first, keys_df(spark, [("test-loadgen-secret", "other", ["query"], "z")] + KEYS[2:]))
    rows = {r["name"]: r for r in again.collect()}
    assert len(rows) == 4 and rows["loadgen"]["scopes"] == ["ingest", "query"]
    assert "other" not in rows


def test_tenant_isolation(spark, tmp_root):
    store = LogStore(tmp_root)
    keys = key_rows(keys_df(spark))

    def doc(doc_id, key, msgs):
        body = {"logs": [{"timestamp": "2026-07-20T14:01:00Z", "level": "info", "service": "svc",
                          "message": m} for m in msgs]}
        return (doc_id, json.dumps(body), key)

    reqs = spark.createDataFrame(
        [doc("d1", "tenant-a-key", ["secret-a", "secret-a-2"]), doc("d2", "tenant-b-key", ["secret-b"]),
         doc("d3", "nope", ["never"])],
        "doc_id string, value string, api_key string",
    )
    res = ingest_batch(store, reqs, 1, as_of=AS_OF, keys=keys)
    assert res == {"accepted": 3, "rejected": 0, "bad_documents": 0, "denied_documents": 1}
    rec = {r["doc_id"]: (r["status"], r["error"]) for r in store.receipts(spark).collect()}
    assert rec["d3"] == ("denied", "401 invalid api key") and rec["d1"] == ("accepted", None)
    # The same through the explicit verdict join.
    allowed = stamp_tenant(verdicts(reqs, keys, "ingest")).select("doc_id", "value", "tenant_id")
    assert sorted(r["doc_id"] for r in allowed.collect()) == ["d1", "d2"]
    logs = store.logs(spark)
    a_rows = list_rows(logs, ListSpec(LogFilter()), tenant="a").collect()
    assert sorted(r["message"] for r in a_rows) == ["secret-a", "secret-a-2"]
    spec = AggregateSpec("2026-07-20T14:00:00Z", "2026-07-20T15:00:00Z", "1m")
    got = render_buckets(bucket_counts(logs, store.counts(spark), spec, tenant="a")).collect()
    assert got[0]["count"] == 2
    assert list_rows(logs, ListSpec(LogFilter()), tenant=None).count() == 0


def test_service_scopes_reads_by_key(spark, tmp_root):
    import pytest

    from emberlog.service import LogService

    svc = LogService(spark, tmp_root)
    keys = key_rows(keys_df(spark))
    docs = spark.createDataFrame(
        [("d1", json.dumps({"logs": [{"timestamp": "2026-07-20T14:01:00Z", "level": "info", "service": "s",
                                      "message": m} for m in ("a1", "a2")]}), "tenant-a-key"),
         ("d2", json.dumps({"logs": [{"timestamp": "2026-07-20T14:02:00Z", "level": "info", "service": "s",
                                      "message": "b1"}]}), "tenant-b-key")],
        "doc_id string, value string, api_key string",
    )
    svc.ingest(docs, 1, as_of=AS_OF, keys=keys)
    rows, _ = svc.list_for_key(keys, "tenant-a-key")
    assert sorted(r["message"] for r in rows) == ["a1", "a2"]
    assert svc.list_for_key(keys, "test-loadgen-secret")[0] == []  # no tenant: rows without tenant
    with pytest.raises(PermissionError, match="403"):
        svc.list_for_key(keys, "ingest-only-key")
    with pytest.raises(PermissionError, match="401"):
        svc.list_for_key(keys, None)
    spec = AggregateSpec("2026-07-20T14:00:00Z", "2026-07-20T15:00:00Z", "1m")
    assert [tuple(r) for r in svc.aggregate_for_key(keys, "tenant-b-key", spec).collect()] == [
        ("2026-07-20T14:02:00.000Z", None, 1)]


def test_stored_keys_keep_their_first_seed(spark, tmp_root):
    from emberlog.service import LogService

    svc = LogService(spark, tmp_root)
    ddl = "key string, name string, scopes array<string>, tenant_id string, position int"
    first = spark.createDataFrame([("k1", "one", None, "a", 2), ("k1", "earlier", ["query"], "b", 1), ("k2", "two", None, None, 3)], ddl)
    assert svc.keys().count() == 0
    assert svc.seed_keys(first.repartition(3)) == 0
    rows = sorted(map(str, svc.keys().collect()))
    assert svc.seed_keys(first) == 1 and sorted(map(str, svc.keys().collect())) == rows
    later = spark.createDataFrame([("k2", "late", ["ingest"], "z", 0), ("k3", "three", None, "c", 0)], ddl)
    svc.seed_keys(later)
    assert svc.store.seed_keys(spark, later, seed=0) == 0  # a retried number changes nothing
    got = {r["name"]: (r["tenant_id"], r["scopes"]) for r in svc.keys().collect()}
    assert got == {"earlier": ("b", ["query"]), "two": (None, ["ingest", "query"]), "three": ("c", ["ingest", "query"])}
    assert set(rows) <= set(map(str, svc.keys().collect()))
    assert svc.scope_of(svc.keys(), "k1") == ("ok", "b")
    assert svc.scope_of(svc.keys(), "k1", "ingest")[0].startswith("403")
    # Without positions, rows of one key that differ: the first by name, tenant and scopes, in any order.
    from emberlog.operators.access import seed_keys

    twice = [("k9", n, None, t) for n, t in (("b", "x"), ("a", "y"), ("a", "x"))]
    for rows9 in (twice, twice[::-1]):
        row = seed_keys(None, spark.createDataFrame(rows9, "key string, name string, scopes array<string>, tenant_id string")).first()
        assert (row["name"], row["tenant_id"]) == ("a", "x")
