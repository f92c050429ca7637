"""Promoted attribute keys: the same rows as the VARIANT probe, with filters that reach the scan."""

import itertools
import json
import re
from datetime import datetime, timezone

from pyspark.sql import functions as F

from emberlog.functions.attrs import attr_equals, promoted_columns
from emberlog.operators.listing import list_rows, render_rows
from emberlog.operators.predicates import apply_filter
from emberlog.operators.retention import expire_store
from emberlog.plans.ingest import ingest_batch
from emberlog.service import LogService
from emberlog.sources.store import STORED_LOGS_DDL, LogStore
from emberlog.spec import AggregateSpec, ListSpec, LogFilter

AS_OF = datetime(2026, 7, 20, 15, 0, tzinfo=timezone.utc)
VALUES = ["eu", "42", 42, 42.0, 42.5, 0, -0.0, True, False, "true", "false", "", " 42", 1e300, 2**53 + 1, "0x2A", "EU"]
ASKED = ["eu", "42", "42.0", "0x2A", " 42 ", "0", "-0", "true", "false", "", "9007199254740993", "1e300", "none"]


def docs(spark, keys, first=0, day="20"):
    """A document for each value and key, and one without attributes."""
    rows = []
    for n, (v, key) in enumerate(itertools.product(VALUES, keys), first):
        e = {"timestamp": f"2026-07-{day}T14:{n % 60:02}:00Z", "level": "info", "service": "s", "message": f"m{n}", "attributes": {key: v, "z": n}}
        rows.append((f"d{n:04}", json.dumps({"logs": [e, {k: v for k, v in e.items() if k != "attributes"}]})))
    return spark.createDataFrame(rows, "doc_id string, value string")


def both(spark, root, keys):
    """Two batches: before and after the keys were promoted."""
    ingest_batch(LogStore(root), docs(spark, keys), 1, as_of=AS_OF)
    store = LogStore(root, tuple(keys))
    ingest_batch(store, docs(spark, keys, 500), 2, as_of=AS_OF)
    return store


def found(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_same_rows_as_the_variant_probe(spark, tmp_root):
    keys = ["region", "User.Id", "a_b", "ключ"]
    store = both(spark, tmp_root, keys)
    logs = store.logs(spark)
    plain = LogStore(tmp_root).logs(spark)
    assert not any(c.startswith("attr_") for c in plain.columns)
    asked = [(k, v) for k in keys for v in ASKED]
    # One pass for all probes on each side.
    want = plain.select("id", *[attr_equals("attributes", k, v, is_variant=True).alias(str(i)) for i, (k, v) in enumerate(asked)]).collect()
    for i, (k, v) in enumerate(asked):
        if k != "region" and v not in ("42", "true"):
            continue
        ids = sorted(r["id"] for r in want if r[str(i)])
        assert found(apply_filter(logs, LogFilter(attrs=((k, v),)))) == ids, (k, v)
    assert any(r["1"] for r in want)


def test_column_names_differ_for_keys_that_differ():
    keys = ["region", "Region", "r_egion", "r.egion", "r_2e_egion", "", "é"]
    names = [n for k in keys for n in promoted_columns(k).values()]
    assert len({n.lower() for n in names}) == len(names)
    assert all(re.fullmatch("[a-z0-9_]+", n) for n in names)


def test_filters_reach_the_scan(spark, tmp_root):
    store = both(spark, tmp_root, ["region"])
    plan = apply_filter(store.logs(spark), LogFilter(attrs=(("region", "42"),)))._jdf.queryExecution().executedPlan().toString()
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert "EqualTo(attr_text_region,42)" in pushed and "EqualTo(attr_number_region,42.0)" in pushed
    assert "IsNull(attr_kept_region)" in pushed


def test_typed_columns_from_the_promotion_on(spark, tmp_root):
    import glob

    import pyarrow.parquet as pq

    both(spark, tmp_root, ["region"])
    schemas = {b: pq.read_schema(glob.glob(f"{tmp_root}/logs/dt=*/batch_id={b}/*.parquet")[0]).names for b in (1, 2)}
    assert "attr_text_region" not in schemas[1] and "attr_text_region" in schemas[2]


def test_listing_shows_no_typed_columns(spark, tmp_root):
    store = both(spark, tmp_root, ["region"])
    page = render_rows(list_rows(store.logs(spark), ListSpec(LogFilter(attrs=(("region", "eu"),)))))
    assert page.columns == ["id", "ts", "level", "service", "message", "attributes"]
    assert page.count() == 2


def test_service_and_expiry_keep_the_columns(spark, tmp_root):
    svc = LogService(spark, tmp_root, promoted=("region",))
    svc.ingest(docs(spark, ["region"], day="19"), 1, as_of=AS_OF)
    svc.ingest(docs(spark, ["region"], 500), 2, as_of=AS_OF)
    spec = AggregateSpec("2026-07-19T00:00:00Z", "2026-07-21T00:00:00Z", "1d", None, LogFilter(attrs=(("region", "true"),)))
    assert [r["count"] for r in svc.aggregate(spec).collect()] == [2, 2]
    # The cutoff is on the 20th: its rows are rewritten, those of the 19th go.
    gone = svc.expire(datetime(2026, 7, 20, 14, 5, tzinfo=timezone.utc), hours=1)
    assert gone == 2 * len(VALUES)
    assert [r["count"] for r in svc.aggregate(spec).collect()] == [2]
    kept = svc.store.raw_logs(spark)
    assert kept.where(F.col("attr_kept_region").isNull()).count() == 0
    # A sweep of a store object without the list drops the columns, not the answers.
    expire_store(LogStore(tmp_root), datetime(2026, 7, 20, 14, 5, tzinfo=timezone.utc), 1, spark)
    assert [r["count"] for r in svc.aggregate(spec).collect()] == [2]
    # A table without any row and a key that no entry has.
    empty = spark.createDataFrame([], STORED_LOGS_DDL)
    assert found(apply_filter(empty, LogFilter(attrs=(("region", "true"),)))) == []
    assert found(apply_filter(svc.logs(), LogFilter(attrs=(("nowhere", "true"),)))) == []
