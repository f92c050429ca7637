import json
from datetime import datetime, timezone

from emberlog.schema import LOGS_SCHEMA


def utc(*a):
    return datetime(*a, tzinfo=timezone.utc)


def logs_df(spark, rows):
    """rows: (id, ts, level, service, message, attributes dict, tenant)."""
    data = [(i, ts, lv, sv, msg, json.dumps(at), tn) for i, ts, lv, sv, msg, at, tn in rows]
    return spark.createDataFrame(data, LOGS_SCHEMA)


def list_dataset(spark):
    rows, i = [], 0
    for k in range(5):
        for lv in ("debug", "info", "warn", "error"):
            i += 1
            rows.append((i, utc(2026, 7, 20, 14, k, 0), lv, f"svc-{k}", f"message {k} for level {lv}",
                         {"user_id": f"user-{k}", "region": "eu-west" if k % 2 == 0 else "us-east", "retries": k},
                         None))
    rows.append((21, utc(2026, 7, 20, 14, 0, 0), "info", "svc-0", "50% done", {"user_id": "42"}, None))
    return logs_df(spark, rows)


def aggregate_dataset(spark, tenant=None):
    spec = [
        ((14, 1, 30), "checkout", "error", "eu"),
        ((14, 1, 45), "checkout", "error", "eu"),
        ((14, 1, 59), "checkout", "error", "us"),
        ((14, 3, 10), "checkout", "info", "eu"),
        ((14, 1, 1), "auth", "warn", "eu"),
        ((14, 1, 2), "auth", "warn", "eu"),
    ]
    rows = [
        (i + 1, utc(2026, 7, 20, *hms), lv, sv, "payment declined", {"region": rg}, tenant)
        for i, (hms, sv, lv, rg) in enumerate(spec)
    ]
    return logs_df(spark, rows)
