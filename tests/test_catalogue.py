"""Catalogue tables: the committed batches, without a job before the action."""

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import functions as F

from emberlog.operators.aggregate import bucket_counts
from emberlog.operators.predicates import apply_filter
from emberlog.plans.ingest import ingest_batch
from emberlog.service import LogService
from emberlog.sources.catalogue import Catalogue
from emberlog.sources.store import LogStore
from emberlog.spec import AggregateSpec, ListSpec, LogFilter

AS_OF = datetime(2026, 7, 20, 15, 0, tzinfo=timezone.utc)


def docs(spark, days, tag):
    rows = []
    for d in days:
        entries = [{"timestamp": f"2026-07-{d:02}T14:{m:02}:30.5Z", "level": "info", "service": "s", "message": f"{tag} {m}", "attributes": {"region": "eu"}}
                   for m in range(5)]
        rows.append((f"{tag}-{d}", json.dumps({"logs": entries + [{"level": "info"}]})))
    return spark.createDataFrame(rows, "doc_id string, value string")


def db():
    return f"t_{uuid.uuid4().hex}"


def jobs_of(spark, build):
    """(jobs started while ``build`` makes its plan, the result)."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "plan")
    df = build()
    df._jdf.queryExecution().executedPlan()
    jobs = list(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("other", "")
    return jobs, df


def same(a, b):
    cols = sorted(a.columns)
    text = lambda df: sorted(str(r) for r in df.selectExpr(*[f"to_json(struct({c})) AS {c}" for c in cols]).collect())
    return cols == sorted(b.columns) and text(a) == text(b)


def test_shows_what_is_committed(spark, tmp_root):
    store = LogStore(tmp_root)
    empty = Catalogue(spark, store, db()).open()
    assert empty.logs().count() == 0 and empty.days() == []
    ingest_batch(store, docs(spark, [18, 19, 20], "a"), 1, as_of=AS_OF)
    assert empty.logs().count() == 0
    assert empty.sync() == [1] and empty.sync() == []
    # A writer that ended before its marker.
    rows = store.raw_logs(spark).withColumn("batch_id", F.lit(9).cast("bigint"))
    store.write_partitions(rows, "logs", ["dt", "batch_id"], "ts")
    empty.add_batch(9)
    assert empty.sync() == [] and empty.logs().count() == 15
    for table in ("logs", "counts", "rejected", "receipts"):
        assert same(getattr(empty, table)(), getattr(store, table)(spark)), table
    # Another session has nothing but the folder.
    again = Catalogue(spark, store, db()).open()
    assert same(again.logs(), store.logs(spark)) and again.days() == ["2026-07-20", "2026-07-19", "2026-07-18"]


def test_no_job_before_the_action(spark, tmp_root):
    svc = LogService(spark, tmp_root, promoted=("region",), database=db())
    # More day folders than Spark lists without a job.
    svc.ingest(docs(spark, range(1, 21), "a"), 1, as_of=AS_OF)
    svc.ingest(docs(spark, range(1, 21), "b"), 2, as_of=AS_OF)
    svc.catalogue.analyze()
    spec = AggregateSpec("2026-07-10T00:00:00.250Z", "2026-07-12T00:00:00.750Z", "1h", "service", LogFilter(service="s"))
    jobs, df = jobs_of(spark, lambda: svc.aggregate(spec))
    assert jobs == []
    assert [r["count"] for r in df.collect()] == [10, 10]
    jobs, df = jobs_of(spark, lambda: apply_filter(svc.logs(), LogFilter(since="2026-07-10T00:00:00Z", until="2026-07-11T00:00:00Z", attrs=(("region", "eu"),))))
    assert jobs == [] and df.count() == 10
    # Only the days of the window, whether the window lies inside one or touches its end.
    assert {f.split("/dt=")[1][:10] for f in df.inputFiles()} == {"2026-07-10", "2026-07-11"}
    want = bucket_counts(svc.store.logs(spark), svc.store.counts(spark), spec)
    assert same(bucket_counts(svc.logs(), svc.counts(), spec), want)


def test_statistics(spark, tmp_root):
    svc = LogService(spark, tmp_root, database=db())
    svc.ingest(docs(spark, [20], "a"), 1, as_of=AS_OF)
    svc.catalogue.analyze(rows=True)
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {svc.catalogue.name('logs')}").collect()}
    assert said["Statistics"].endswith(" 5 rows")


def test_expiry_and_pages(spark, tmp_root):
    svc = LogService(spark, tmp_root, database=db())
    svc.ingest(docs(spark, [18, 19, 20], "a"), 1, as_of=AS_OF)
    svc.ingest(docs(spark, [18], "b"), 2, as_of=AS_OF)
    # Batch 2 has rows on the cutoff's day only, all before it.
    assert svc.expire(datetime(2026, 7, 19, 14, 2, tzinfo=timezone.utc), hours=24) == 4
    assert svc.logs().count() == svc.store.logs(spark).count() == 16
    assert svc.expire(datetime(2026, 7, 19, 15, 32, tzinfo=timezone.utc), hours=24) == 6
    assert svc.logs().count() == svc.store.logs(spark).count() == 10
    assert same(svc.counts(), svc.store.counts(spark))
    assert svc.catalogue.days()[-1] == "2026-07-19"
    rows, mark = svc.list(ListSpec(limit=7))
    rest, end = svc.list(ListSpec(limit=7, bookmark=mark))
    assert len(rows) == 7 and len(rest) == 3 and end is None
    # A committed batch that is sent again changes nothing.
    svc.ingest(docs(spark, [20], "c"), 1, as_of=AS_OF)
    assert svc.logs().count() == 10


def test_key_promoted_later(spark, tmp_root):
    name = db()
    LogService(spark, tmp_root, database=name).ingest(docs(spark, [20], "a"), 1, as_of=AS_OF)
    svc = LogService(spark, tmp_root, promoted=("region",), database=name)
    svc.ingest(docs(spark, [20], "b"), 2, as_of=AS_OF)
    got = apply_filter(svc.logs(), LogFilter(attrs=(("region", "eu"),)))
    assert got.count() == 10 and "attr_text_region" in got.columns
