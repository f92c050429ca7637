"""Batch ingest into the store: visibility on commit, replay, ids, rollup, receipts."""

import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators.aggregate import bucket_counts, render_buckets
from emberlog.operators.report import reconcile
from emberlog.operators.rollup import compact
from emberlog.plans import ingest
from emberlog.plans.ingest import ID_SHIFT, ingest_batch
from emberlog.sources.store import LogStore
from emberlog.spec import AggregateSpec

AS_OF = datetime(2026, 7, 20, 15, 0, tzinfo=timezone.utc)


def entry(ts, level="info", service="checkout", msg="payment declined", attrs=None):
    e = {"timestamp": ts, "level": level, "service": service, "message": msg}
    if attrs is not None:
        e["attributes"] = attrs
    return e


def docs_df(spark, docs):
    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in docs],
                                 "doc_id string, value string")


def test_batch_roundtrip(spark, tmp_root):
    store = LogStore(tmp_root)
    docs = docs_df(spark, [
        ("a", {"logs": [entry("2026-07-20T14:01:30Z"), entry("2026-07-20T14:01:45Z", level="critical"),
                        entry("2026-07-20T14:01:59.5Z", attrs={"region": "eu"})]}),
        ("b", {"logs": [entry("2026-07-20T14:03:10Z", level="error")]}),
        ("c", "{ not json"),
        ("d", {"logs": []}),
    ])
    res = ingest_batch(store, docs, 5, as_of=AS_OF)
    assert res == {"accepted": 3, "rejected": 1, "bad_documents": 1}
    logs = store.logs(spark)
    ids = sorted(r["id"] for r in logs.collect())
    # Dense positions over the batch's 4 entries; rejected entries keep theirs.
    assert len(set(ids)) == 3 and all(5 * ID_SHIFT <= i < 5 * ID_SHIFT + 4 for i in ids)
    rec = {r["doc_id"]: (r["accepted"], r["rejected"], r["status"]) for r in store.receipts(spark).collect()}
    assert rec == {"a": (2, 1, "accepted"), "b": (1, 0, "accepted"), "c": (0, 0, "bad_batch"),
                   "d": (0, 0, "refused")}
    rej = store.rejected(spark).collect()
    assert [(r["doc_id"], r["entry_index"], r["reason"]) for r in rej] == [("a", 1, "invalid level: 'critical'")]
    spec = AggregateSpec("2026-07-20T14:00:00Z", "2026-07-20T14:05:00Z", "1m")
    got = [tuple(r) for r in render_buckets(bucket_counts(logs, store.counts(spark), spec)).collect()]
    assert got == [("2026-07-20T14:01:00.000Z", None, 2), ("2026-07-20T14:03:00.000Z", None, 1)]

    # Replay of the same batch: nothing doubles.
    ingest_batch(store, docs, 5, as_of=AS_OF)
    assert store.logs(spark).count() == 3
    assert store.counts(spark).agg(F.sum("n")).first()[0] == 3
    r = reconcile(store.receipts(spark), store.logs(spark)).collect()
    assert [(x["batch_id"], x["accepted"], x["visible"], x["consistent"]) for x in r] == [(5, 3, 3, True)]


def test_batch_past_its_block_of_ids_fails_before_commit(spark, tmp_root, monkeypatch):
    monkeypatch.setattr(ingest, "ID_SHIFT", 3)
    store = LogStore(tmp_root)
    logs = [entry(f"2026-07-20T14:01:3{i}Z") for i in range(4)]
    ingest_batch(store, docs_df(spark, [("a", {"logs": logs[:3]})]), 1, as_of=AS_OF)
    with pytest.raises(Exception, match="batch 2 has more than 3 entries"):
        ingest_batch(store, docs_df(spark, [("a", {"logs": logs})]), 2, as_of=AS_OF)
    assert [r["id"] for r in store.logs(spark).orderBy("id").collect()] == [3, 4, 5]


def test_retry_leaves_nothing_of_the_failed_attempt(spark, tmp_root, monkeypatch):
    store = LogStore(tmp_root)
    future = docs_df(spark, [("a", {"logs": [entry("2026-07-20T14:01:30Z"), entry("2026-07-22T14:01:30Z")]})])
    with monkeypatch.context() as m:
        m.setattr(LogStore, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            ingest_batch(store, future, 4, as_of=AS_OF)
    assert store.raw_rejected(spark).count() == 1
    assert ingest_batch(store, future, 4, as_of=datetime(2026, 7, 23, tzinfo=timezone.utc))["rejected"] == 0
    assert store.rejected(spark).count() == 0 and store.logs(spark).count() == 2


def test_uncommitted_batch_is_invisible(spark, tmp_root):
    store = LogStore(tmp_root)
    docs = docs_df(spark, [("a", {"logs": [entry("2026-07-20T14:01:30Z")]})])
    ingest_batch(store, docs, 1, as_of=AS_OF)
    # A batch whose writer died before its commit marker: rows on disk, not visible.
    orphan = spark.createDataFrame(
        [(2 * ID_SHIFT, datetime(2026, 7, 20, 14, 2), "info", "x", "m", "{}", None)],
        "id bigint, ts timestamp, level string, service string, message string, attributes string, tenant_id string",
    ).withColumn("dt", F.to_date("ts")).withColumn("batch_id", F.lit(2).cast("bigint"))
    store.write_partitions(orphan, "logs", ["dt", "batch_id"])
    assert store.raw_logs(spark).count() == 2
    assert store.logs(spark).count() == 1


def test_tenant_stamp_and_late_rows(spark, tmp_root):
    store = LogStore(tmp_root)
    d1 = docs_df(spark, [("a", {"logs": [entry("2026-07-20T14:01:30Z")]})]).withColumn("tenant_id", F.lit("a"))
    ingest_batch(store, d1, 1, as_of=AS_OF)
    # Six years late: still accepted and added to its old bucket.
    d2 = docs_df(spark, [("b", {"logs": [entry("2020-07-20T14:01:31Z"), entry("2026-07-20T14:01:31Z")]})])
    ingest_batch(store, d2, 2, as_of=AS_OF)
    rows = {(r["tenant_id"], r["ts"].year) for r in store.logs(spark).collect()}
    assert rows == {("a", 2026), (None, 2020), (None, 2026)}
    spec = AggregateSpec("2026-07-20T14:00:00Z", "2026-07-20T14:05:00Z", "1m", "service")
    got = [tuple(r) for r in render_buckets(bucket_counts(store.logs(spark), store.counts(spark), spec)).collect()]
    assert got == [("2026-07-20T14:01:00.000Z", "checkout", 2)]


def test_store_reads_prune_day_partitions(spark, tmp_root):
    from emberlog.operators.aggregate import rollup_counts
    from emberlog.operators.listing import list_rows
    from emberlog.spec import ListSpec, LogFilter

    store = LogStore(tmp_root)
    docs = docs_df(spark, [("a", {"logs": [entry("2026-07-18T10:00:00Z"), entry("2026-07-20T14:01:30Z")]})])
    ingest_batch(store, docs, 1, as_of=AS_OF)
    logs, counts = store.logs(spark), store.counts(spark)
    lst = list_rows(logs, ListSpec(LogFilter(since="2026-07-20T00:00:00Z")))
    plan = lst._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan and "dt#" in plan
    assert [r["ts"].day for r in lst.collect()] == [20]
    spec = AggregateSpec("2026-07-20T14:00:00.5Z", "2026-07-20T14:05:00Z", "1m")
    agg = rollup_counts(logs, counts, spec)
    aplan = agg._jdf.queryExecution().executedPlan().toString()
    assert aplan.count("PartitionFilters: [isnotnull(dt") >= 2
    assert [tuple(r)[1:] for r in agg.collect()] == [(None, 1)]


def test_page_by_days_equals_full_scan(spark, tmp_root):
    from emberlog.operators.listing import fetch_page, fetch_page_by_days
    from emberlog.spec import ListSpec, LogFilter

    store = LogStore(tmp_root)
    stamps = [f"2026-07-{d:02d}T{h:02d}:00:00Z" for d in range(1, 20) for h in (3, 9, 15)]
    docs = docs_df(spark, [("a", {"logs": [entry(t, level="error" if i % 4 == 0 else "info")
                                           for i, t in enumerate(stamps)]})])
    ingest_batch(store, docs, 1, as_of=AS_OF)
    logs, days = store.logs(spark), store.days(spark)
    assert days[0] == "2026-07-19" and len(days) == 19
    for spec in (ListSpec(LogFilter(), limit=5), ListSpec(LogFilter(level="error"), limit=7),
                 ListSpec(LogFilter(until="2026-07-10T00:00:00Z"), limit=10),
                 ListSpec(LogFilter(since="2026-07-15T00:00:00Z"), limit=1000)):
        bm = None
        while True:
            s = ListSpec(spec.filter, spec.limit, bm)
            a_rows, a_next = fetch_page(logs, s)
            b_rows, b_next = fetch_page_by_days(logs, days, s)
            assert [r["id"] for r in a_rows] == [r["id"] for r in b_rows]
            assert a_next == b_next
            if a_next is None:
                break
            bm = a_next


def test_ids_do_not_depend_on_partitions_or_cores(spark, tmp_root):
    rnd = random.Random(9)
    bodies = [(f"doc-{k:03d}", {"logs": [entry(f"2026-07-{1 + k % 19:02d}T14:01:{i:02d}Z", level=rnd.choice(["info", "x"]))
                                         for i in range(rnd.randint(0, 5))]}) for k in range(120)]
    bodies += [("doc-007", {"logs": [entry("2026-07-20T14:01:30Z", msg="again")]}), ("doc-050b", "not json")]
    # By hand: documents in the order of their ids, entries in the order of the body.
    want, position = {}, 0
    for name, body in sorted((b for b in bodies if b[0] != "doc-007" and b[1] != "not json"), key=lambda b: b[0]):
        for i, e in enumerate(body["logs"]):
            want[name, i] = (position, e["level"] == "info")
            position += 1
        if name == "doc-006":
            position += 1 + len(dict(bodies[:120])["doc-007"]["logs"])  # the two documents of one id
    seen = set()
    for k, parts in enumerate((3, 4, 7, 1)):
        rnd.shuffle(bodies)
        store = LogStore(f"{tmp_root}/{parts}")
        ingest_batch(store, docs_df(spark, bodies).repartition(parts), 6, as_of=AS_OF)
        rows = {r["id"] - 6 * ID_SHIFT: (r["ts"].isoformat(), r["message"]) for r in store.logs(spark).collect()}
        assert {p for p, ok in want.values() if ok} <= set(rows)
        seen.add(tuple(sorted(rows.items())))
        documents = ingest.validate_parsed(ingest.parse_batch(docs_df(spark, bodies).repartition(parts)), AS_OF)
        got = {(r["doc_id"], r["entry_index"]): r["id"] - 6 * ID_SHIFT for r in ingest.with_ids(documents, 6).collect() if r["doc_id"] != "doc-007"}
        assert got == {key: p for key, (p, _) in want.items()}
    assert len(seen) == 1


def test_committed_batch_is_not_written_again(spark, tmp_root):
    store = LogStore(tmp_root)
    early = docs_df(spark, [("a", {"logs": [entry("2026-07-20T14:01:30Z"), entry("2026-07-22T14:01:30Z")]})])
    assert ingest_batch(store, early, 7, as_of=AS_OF) == {"accepted": 1, "rejected": 1, "bad_documents": 0}
    before = [sorted(map(str, t.collect())) for t in (store.logs(spark), store.receipts(spark), store.rejected(spark))]
    # Other input and a later clock under the same number: the stored totals come back.
    other = docs_df(spark, [("b", {"logs": [entry("2026-07-20T14:01:31Z")] * 3})])
    assert ingest_batch(store, other, 7, as_of=AS_OF) == {"accepted": 1, "rejected": 1, "bad_documents": 0}
    assert ingest_batch(store, early, 7, as_of=datetime(2026, 7, 23, tzinfo=timezone.utc))["rejected"] == 1
    assert [sorted(map(str, t.collect())) for t in (store.logs(spark), store.receipts(spark), store.rejected(spark))] == before


def test_receipts_list_the_rejections_in_one_narrow_pass(spark, tmp_root):
    docs = docs_df(spark, [("a", {"logs": [entry("2026-07-20T14:01:30Z", level="x"), entry("2026-07-20T14:01:30Z"), 5, {}]}),
                           ("b", {"logs": []}), ("c", "{")])
    receipts = ingest.validate_batch(docs, as_of=AS_OF).receipts
    got = {r["doc_id"]: (r["accepted"], r["rejected"], r["status"], [tuple(x) for x in r["rejections"]]) for r in receipts.collect()}
    assert got == {"a": (1, 3, "accepted", [(0, "invalid level: 'x'"), (2, "entry must be a object"), (3, "missing required field: 'timestamp'")]),
                   "b": (0, 0, "refused", []), "c": (0, 0, "bad_batch", [])}
    path = f"{tmp_root}/bodies"
    docs.repartition(6).write.parquet(path)
    plan = ingest.validate_batch(spark.read.parquet(path).repartition(8), as_of=AS_OF).receipts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan  # the repartition above
    store = LogStore(f"{tmp_root}/store")
    ingest_batch(store, docs, 1, as_of=AS_OF)
    assert {r["doc_id"]: [tuple(x) for x in r["rejections"]] for r in store.receipts(spark).collect()} == {k: v[3] for k, v in got.items()}


def test_backfill_over_days_writes_few_files(spark, tmp_root):
    docs = docs_df(spark, [(f"d{k}", {"logs": [entry(f"2026-07-{d:02d}T10:00:0{k % 10}Z") for d in range(1, 19)]}) for k in range(64)])
    store = LogStore(tmp_root)
    ingest_batch(store, docs.repartition(16), 1, as_of=AS_OF)
    files = store.raw_logs(spark).select(F.col("_metadata.file_path")).distinct().count()
    assert files <= 2 * 18 and store.logs(spark).count() == 64 * 18


def test_typed_probes_on_stored_variant_attributes(spark, tmp_root):
    from emberlog.operators.listing import list_rows, render_rows
    from emberlog.spec import ListSpec, LogFilter

    store = LogStore(tmp_root)
    attrs = [{"retries": 2}, {"retries": "2"}, {"retries": 2.0}, {"retries": True}, {"a'b": 1, "retries": "x"},
             {"a]b": "v", "a.b": 5, "ü": False, "back\\slash": "y"}]
    docs = docs_df(spark, [("a", {"logs": [entry(f"2026-07-20T14:0{i}:00Z", attrs=a) for i, a in enumerate(attrs)]})])
    assert len(attrs) <= 10
    ingest_batch(store, docs, 1, as_of=AS_OF)
    logs = store.logs(spark)

    def n(**kw):
        return list_rows(logs, ListSpec(LogFilter(attrs=tuple(kw.items())), limit=1000)).count()

    assert n(retries="2") == 3 and n(retries="02") == 2 and n(retries="true") == 1 and n(retries="x") == 1
    assert list_rows(logs, ListSpec(LogFilter(attrs=(("a'b", "1"),)))).count() == 1
    for key, value in (("a]b", "v"), ("a.b", "5"), ("ü", "false"), ("back\\slash", "y")):
        assert list_rows(logs, ListSpec(LogFilter(attrs=((key, value),)))).count() == 1, key
    plan = list_rows(logs, ListSpec(LogFilter(attrs=(("retries", "2"),))))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "from_json" not in plan and "variant_get" in plan
    texts = sorted(r["attributes"] for r in render_rows(list_rows(logs, ListSpec())).collect())
    assert """{"a'b":1,"retries":"x"}""" in texts and '{"retries":2}' in texts


def test_tasks_before_costly_work_grow_with_the_input(spark):
    """One file is one or few splits; before, no more tasks than cores followed, whatever the number of documents."""
    from pyspark.sql import functions as F

    from emberlog.functions.spread import spread

    def tasks(rows):
        df = spark.range(rows).repartition(4, F.lit(1)).select(F.col("id").cast("string").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("value"))
        return len(spread(df, "doc_id").groupBy(F.spark_partition_id()).agg(F.max("value")).collect())

    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        few, many = tasks(4_000), tasks(32_000)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert few >= 3 and many >= 4 * few


def test_request_bodies_are_made_after_the_events_are_dealt(spark, tmp_root):
    from emberlog.sources.requests import requests_from_events

    spark.sql("SELECT id AS event_id, timestamp'2024-01-20' AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value, "
              "'{\"k\": 1}' AS props FROM range(40)").coalesce(1).write.parquet(f"{tmp_root}/events.parquet")
    docs = requests_from_events(spark, tmp_root)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    # The project that spells the body stands above the exchange, and filters of a batch below it.
    assert plan.index("format_string") < plan.index("Rebalance") and docs.count() == 40
    assert docs.select("doc_id").distinct().count() == 40


def _events(spark, root, rows):
    spark.sql(f"SELECT id AS event_id, timestamp'2024-01-10' + make_dt_interval(id % 15) AS ts, id AS user_id, 'view' AS event_type, 1.0D AS value, "
              f"'{{\"k\": 1}}' AS props FROM range({rows})").coalesce(1).write.parquet(f"{root}/events.parquet")


def test_a_request_body_is_spelled_by_few_expressions(spark, tmp_root):
    """An entry for each rule, four times in a body, made code that the JVM does not compile."""
    from emberlog.sources.requests import requests_from_events

    _events(spark, tmp_root, 40)
    docs = requests_from_events(spark, tmp_root)
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("to_json") + plan.count("structstojson") + plan.count("StructsToJson") <= 6
    got = {r["event_id"]: r["value"] for r in docs.where("event_id IN (3, 6, 11, 12)").collect()}
    assert got[3] == '{"logs": [{"timestamp":"2024-01-13T00:00:00.000000Z","level":"debug","service":"svc-3","attributes":{"k":1}}]}'
    assert got[6] == ('{"logs": [{"timestamp":1705363200000,"level":"debug","service":"svc-6","message":"view by user 6","attributes":{"k":1}}]}')
    assert got[11] == ('{"logs": [{"timestamp":"2024-01-21T00:00:00.000000Z","level":"debug","service":"svc-3","message":"view by user 11",'
                       '"attributes":{"k":"1","ok":true},"trace_id":"t-11"}]}')
    tail = '"service":"svc-4","message":"view by user 12","attributes":{"k":1}}'
    day = '{"timestamp":"2024-01-22T00:00:00.000000Z","level":'
    assert got[12] == f'{{"logs": [{day}"debug",{tail}, {day}"fatal",{tail}]}}'


def test_a_body_is_parsed_once(spark, tmp_root):
    docs = docs_df(spark, [("a", {"logs": [entry("2026-07-20T14:01:30Z")]}), ("b", "{"), ("c", "[]"), ("d", None)])
    path = f"{tmp_root}/bodies"
    docs.write.parquet(path)
    parsed = ingest.parse_batch(spark.read.parquet(path))
    plan = parsed._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("parsejson(") + plan.count("parse_json(") == 1
    assert {r["doc_id"]: r["envelope_error"] for r in parsed.collect()} == {
        "a": None, "b": "malformed JSON body", "c": "request body must be a JSON object with a 'logs' array", "d": "request body must be a JSON object with a 'logs' array"}
    assert parsed.columns == ["doc_id", "value", "tenant_id", "auth_error", "logs", "envelope_error"]


def test_tasks_are_sized_for_their_work_unless_the_session_says_otherwise(spark):
    from emberlog.session import TASK_BYTES, TASK_BYTES_CONF, configure

    old = spark.conf.get(TASK_BYTES_CONF, None)
    try:
        spark.conf.unset(TASK_BYTES_CONF)
        configure(spark)
        assert spark.conf.get(TASK_BYTES_CONF) == TASK_BYTES
        spark.conf.set(TASK_BYTES_CONF, "3m")
        configure(spark)
        assert spark.conf.get(TASK_BYTES_CONF) == "3m"
    finally:
        spark.conf.unset(TASK_BYTES_CONF) if old is None else spark.conf.set(TASK_BYTES_CONF, old)


def test_landed_files_grow_with_the_documents(spark, tmp_root, monkeypatch):
    from emberlog.plans import q_stream

    monkeypatch.setattr(q_stream, "DOCS_PER_FILE", 10)
    _events(spark, tmp_root, 150)
    got = [tuple(r) for r in q_stream.q_reconcile(spark, tmp_root).collect()]
    store = q_stream.stream_store(spark, tmp_root)
    landed = [spark.read.parquet(f"{store.root.rsplit('/', 1)[0]}/in/{k}") for k in (0, 1)]
    accepted = sum(i % 20 >= 11 for i in range(150))
    assert got == [(accepted, accepted, True)] and sum(d.count() for d in landed) == 150
    assert all(len(d.inputFiles()) > 2 for d in landed)
    assert sorted(r["batch_id"] for r in store.commits(spark).collect()) == [0, 1, 1000, 1001]
