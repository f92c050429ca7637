"""End to end through the service object: the aggregate dataset as request bodies."""

import json
import os

from emberlog.service import LogService
from emberlog.spec import AggregateSpec, ListSpec, LogFilter

from helpers import utc

ROWS = [
    ("14:01:30", "checkout", "error", "eu"),
    ("14:01:45", "checkout", "error", "eu"),
    ("14:01:59", "checkout", "error", "us"),
    ("14:03:10", "checkout", "info", "eu"),
    ("14:01:01", "auth", "warn", "eu"),
    ("14:01:02", "auth", "warn", "eu"),
]


def test_service_end_to_end(spark, tmp_root):
    src = os.path.join(tmp_root, "in")
    os.makedirs(src)
    for i, (t, svc, lv, rg) in enumerate(ROWS):
        with open(os.path.join(src, f"req-{i}.json"), "w") as f:
            json.dump({"logs": [{"timestamp": f"2026-07-20T{t}Z", "level": lv, "service": svc,
                                 "message": "payment declined", "attributes": {"region": rg}}]}, f)
    svc = LogService(spark, os.path.join(tmp_root, "store"))
    res = svc.ingest_files(src, 1, as_of=utc(2026, 7, 20, 15))
    assert res == {"accepted": 6, "rejected": 0, "bad_documents": 0}
    assert [tuple(r) for r in svc.reconcile().collect()] == [(1, 6, 6, True)]
    assert svc.receipts().count() == 6 and svc.rejected().count() == 0
    w = ("2026-07-20T14:00:00Z", "2026-07-20T14:05:00Z")
    got = [tuple(r) for r in svc.aggregate(AggregateSpec(*w, "1m", "service")).collect()]
    assert got == [("2026-07-20T14:01:00.000Z", "auth", 2), ("2026-07-20T14:01:00.000Z", "checkout", 3),
                   ("2026-07-20T14:03:00.000Z", "checkout", 1)]
    got = [tuple(r) for r in svc.aggregate(
        AggregateSpec(*w, "1m", "service", LogFilter(attrs=(("region", "eu"),)))).collect()]
    assert got == [("2026-07-20T14:01:00.000Z", "auth", 2), ("2026-07-20T14:01:00.000Z", "checkout", 2),
                   ("2026-07-20T14:03:00.000Z", "checkout", 1)]
    rows, nxt = svc.list(ListSpec(LogFilter(), limit=4))
    assert [r["ts"].strftime("%H:%M:%S") for r in rows] == ["14:03:10", "14:01:59", "14:01:45", "14:01:30"]
    rows2, nxt2 = svc.list(ListSpec(LogFilter(), limit=4, bookmark=nxt))
    assert len(rows2) == 2 and nxt2 is None
    # Retention: everything before 14:02 goes; the 1m view keeps only 14:03.
    assert svc.expire(utc(2026, 7, 20, 15, 2), hours=1) == 5
    got = [tuple(r) for r in svc.aggregate(AggregateSpec(*w, "1m")).collect()]
    assert got == [("2026-07-20T14:03:00.000Z", None, 1)]
