"""Bucketed counts: scan path, rollup path with edges, and their equality."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.operators.aggregate import bucket_counts, render_buckets, rollup_counts, scan_counts
from emberlog.operators.retention import expire
from emberlog.operators.rollup import build_rollup
from emberlog.spec import ALL_TENANTS, AggregateSpec, LogFilter

from helpers import aggregate_dataset, logs_df, utc

W = ("2026-07-20T14:00:00Z", "2026-07-20T14:05:00Z")


@pytest.fixture(scope="module")
def data(spark):
    logs = aggregate_dataset(spark).cache()
    return logs, build_rollup(logs).cache()


def got(data, spec, tenant=ALL_TENANTS):
    logs, counts = data
    return [tuple(r) for r in render_buckets(bucket_counts(logs, counts, spec, tenant)).collect()]


def test_widths_and_groups(data):
    assert got(data, AggregateSpec(*W, "1m")) == [
        ("2026-07-20T14:01:00.000Z", None, 5), ("2026-07-20T14:03:00.000Z", None, 1)]
    assert got(data, AggregateSpec(*W, "1m", "service")) == [
        ("2026-07-20T14:01:00.000Z", "auth", 2), ("2026-07-20T14:01:00.000Z", "checkout", 3),
        ("2026-07-20T14:03:00.000Z", "checkout", 1)]
    assert got(data, AggregateSpec(*W, "1m", "level")) == [
        ("2026-07-20T14:01:00.000Z", "error", 3), ("2026-07-20T14:01:00.000Z", "warn", 2),
        ("2026-07-20T14:03:00.000Z", "info", 1)]
    assert got(data, AggregateSpec(*W, "5m")) == [("2026-07-20T14:00:00.000Z", None, 6)]
    assert got(data, AggregateSpec("2026-07-20T00:00:00Z", "2026-07-21T00:00:00Z", "1h"))[0][0] == \
        "2026-07-20T14:00:00.000Z"
    assert got(data, AggregateSpec("2026-07-01T00:00:00Z", "2026-08-01T00:00:00Z", "1d"))[0][0] == \
        "2026-07-20T00:00:00.000Z"


def test_filters_and_sparse(data):
    assert got(data, AggregateSpec("2026-07-20T14:02:00Z", "2026-07-20T14:03:30Z", "1m")) == [
        ("2026-07-20T14:03:00.000Z", None, 1)]
    assert got(data, AggregateSpec(*W, "1m", None, LogFilter(level="error")))[0][2] == 3
    assert got(data, AggregateSpec(*W, "1m", "service", LogFilter(attrs=(("region", "eu"),)))) == [
        ("2026-07-20T14:01:00.000Z", "auth", 2), ("2026-07-20T14:01:00.000Z", "checkout", 2),
        ("2026-07-20T14:03:00.000Z", "checkout", 1)]
    assert sum(r[2] for r in got(data, AggregateSpec(*W, "1m", None, LogFilter(q="payment")))) == 6
    assert got(data, AggregateSpec("2026-08-01T00:00:00Z", "2026-08-02T00:00:00Z", "1m")) == []


def test_same_second_window_counts_once(data):
    """Both bounds inside one second: the row at 14:01:30.0 is counted once."""
    assert got(data, AggregateSpec("2026-07-20T14:01:30.000Z", "2026-07-20T14:01:30.500Z", "1m")) == [
        ("2026-07-20T14:01:00.000Z", None, 1)]


def test_null_tenant_scope_uses_rollup(data):
    assert got(data, AggregateSpec(*W, "1m"), tenant=None) == got(data, AggregateSpec(*W, "1m"))
    assert got(data, AggregateSpec(*W, "1m"), tenant="a") == []


def test_expired_rows_leave_rollup(spark, data):
    logs, counts = data
    kept, kept_counts, _ = expire(logs, counts, as_of=utc(2026, 7, 20, 16, 2), hours=2)
    spec = AggregateSpec(*W, "1m")
    rows = render_buckets(bucket_counts(kept, kept_counts, spec)).collect()
    assert [tuple(r) for r in rows] == [("2026-07-20T14:03:00.000Z", None, 1)]


def test_rollup_equals_scan_on_random_windows(spark):
    rnd = random.Random(7)
    base = utc(2026, 7, 20, 14, 0, 0)
    rows = []
    for i in range(400):
        ts = base + timedelta(microseconds=rnd.randrange(0, 90_000_000))
        rows.append((i + 1, ts, rnd.choice(["debug", "info", "warn", "error"]), rnd.choice(["a", "b", "c"]),
                     "m", {}, rnd.choice([None, "t1"])))
    logs = logs_df(spark, rows).cache()
    counts = build_rollup(logs).cache()
    for k in range(25):
        a = base + timedelta(microseconds=rnd.randrange(-2_000_000, 92_000_000))
        if k % 3 == 0:
            b = a.replace(microsecond=999_999) if a.microsecond < 999_999 else a
        else:
            b = a + timedelta(microseconds=rnd.randrange(0, 60_000_000))
        spec = AggregateSpec(a, b, rnd.choice(["1m", "5m", "1h", "1d"]), rnd.choice([None, "service", "level"]),
                             LogFilter(level=rnd.choice([None, "info"])))
        tenant = rnd.choice([ALL_TENANTS, None, "t1"])
        s = sorted(tuple(r) for r in scan_counts(logs, spec, tenant).collect())
        r = sorted(tuple(r) for r in rollup_counts(logs, counts, spec, tenant).collect())
        assert s == r, (a, b, spec)


def test_aggregate_argument_errors():
    with pytest.raises(ValueError, match="unsupported bucket: '2m'"):
        AggregateSpec(*W, "2m")
    with pytest.raises(ValueError, match="group_by must be 'service' or 'level'"):
        AggregateSpec(*W, "1m", "tenant")
    with pytest.raises(ValueError, match="until must not be earlier than since"):
        AggregateSpec(W[1], W[0], "1m")
    assert AggregateSpec(*W, "1m", None, LogFilter(q="x")).filter.needs_scan


def test_scan_path_pushdown(spark, tmp_root):
    aggregate_dataset(spark).write.parquet(tmp_root + "/logs")
    logs = spark.read.parquet(tmp_root + "/logs")
    plan = scan_counts(logs, AggregateSpec(*W, "1m", None, LogFilter(service="auth")))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "service" in plan and "GreaterThanOrEqual(ts" in plan
    assert F  # noqa
