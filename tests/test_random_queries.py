"""Listings, page walks and bucket counts against brute force on random rows (ties included)."""

import random
from collections import Counter
from datetime import timedelta

from emberlog.functions.attrs import js_number
from emberlog.operators.aggregate import scan_counts
from emberlog.operators.listing import fetch_page, page_index
from emberlog.spec import ALL_TENANTS, AggregateSpec, ListSpec, LogFilter

from helpers import logs_df, utc

BASE = utc(2026, 7, 20, 0, 0, 0)


def make_rows(r, n=600):
    rows = []
    for i in range(n):
        ts = BASE + timedelta(seconds=r.randint(0, 3 * 86400), microseconds=r.choice([0, 0, 250000, 999999]))
        attrs = {"retries": r.choice([0, 1, 2, "2", 2.0, True, "x"])}
        rows.append((r.randint(1, 10**15) if i % 5 else i, ts, r.choice(["debug", "info", "warn", "error"]),
                     r.choice(["a", "b", "c"]), r.choice(["Payment 50% done", "ok", "PAYMENT failed"]), attrs,
                     r.choice([None, "t1", "t2"])))
    # unique ids
    seen, out = set(), []
    for row in rows:
        if row[0] not in seen:
            seen.add(row[0])
            out.append(row)
    return out


def matches(row, flt, tenant):
    i, ts, lv, sv, msg, attrs, tn = row
    if flt.since and ts < flt.since or flt.until and ts >= flt.until:
        return False
    if flt.service and sv != flt.service or flt.level and lv != flt.level:
        return False
    for k, v in flt.attrs:
        x = attrs.get(k)
        num = js_number(v) if v != "" else None
        ok = (isinstance(x, str) and x == v) or (
            num is not None and isinstance(x, (int, float)) and not isinstance(x, bool) and float(x) == num
        ) or (v in ("true", "false") and isinstance(x, bool) and x == (v == "true"))
        if not ok:
            return False
    if flt.q and flt.q.lower() not in msg.lower():
        return False
    if tenant is not ALL_TENANTS and tn != tenant:
        return False
    return True


FILTERS = [
    (LogFilter(), ALL_TENANTS),
    (LogFilter(level="error"), ALL_TENANTS),
    (LogFilter(service="b", attrs=(("retries", "2"),)), ALL_TENANTS),
    (LogFilter(q="payment", since="2026-07-20T12:00:00.250Z", until="2026-07-22T06:00:00Z"), "t1"),
    (LogFilter(attrs=(("retries", "true"),)), None),
]


def test_pages_and_counts_match_brute_force(spark):
    r = random.Random(5)
    rows = make_rows(r)
    logs = logs_df(spark, rows).cache()
    for flt, tenant in FILTERS:
        want = sorted((x for x in rows if matches(x, flt, tenant)), key=lambda x: (x[1], x[0]), reverse=True)
        walk, bm = [], None
        while True:
            page, bm = fetch_page(logs, ListSpec(flt, limit=37, bookmark=bm), tenant)
            walk += [p["id"] for p in page]
            if bm is None:
                break
        assert walk == [x[0] for x in want]
        idx = page_index(logs, flt, 37, tenant).orderBy("page_no").collect()
        assert [p["n_rows"] for p in idx] == [len(want[k:k + 37]) for k in range(0, len(want), 37)]
        assert [p["first_id"] for p in idx] == [want[k][0] for k in range(0, len(want), 37)]
        for bucket, width in (("1m", 60), ("1h", 3600), ("1d", 86400)):
            spec = AggregateSpec("2026-07-19T00:00:00Z", "2026-07-24T00:00:00Z", bucket, "level", flt)
            got = {(x["bucket_start"], x["group_name"]): x["count"] for x in scan_counts(logs, spec, tenant).collect()}
            exp = Counter()
            for x in rows:
                if matches(x, spec.window_filter(), tenant):
                    sec = int(x[1].timestamp()) // width * width
                    exp[(utc(1970, 1, 1) + timedelta(seconds=sec)).replace(tzinfo=None), x[2]] += 1
            assert got == dict(exp)
