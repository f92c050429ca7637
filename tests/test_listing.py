"""Listings, filters, keyset pages and the page index on the 21-row dataset."""

import pytest

from emberlog.operators.listing import fetch_page, list_rows, next_bookmark, page_index, render_rows
from emberlog.spec import ListSpec, LogFilter

from helpers import list_dataset


@pytest.fixture(scope="module")
def logs(spark):
    return list_dataset(spark).cache()


def n(logs, **kw):
    limit = kw.pop("limit", 1000)
    return list_rows(logs, ListSpec(LogFilter(**kw), limit=limit)).count()


def test_filters(logs):
    assert n(logs, service="svc-1", level="error", since="2026-07-20T14:00:00Z", until="2026-07-20T14:05:00Z") == 1
    assert n(logs, since="2026-07-20T14:01:00Z") == 16
    assert n(logs, until="2026-07-20T14:01:00Z") == 5
    assert n(logs, service="svc-2", attrs=(("retries", "2"),)) == 4
    assert n(logs, service="svc-2", attrs=(("retries", "99"),)) == 0
    assert n(logs, attrs=(("user_id", "user-2"),)) == 4
    assert n(logs, service="svc-0", level="error", attrs=(("region", "eu-west"), ("user_id", "user-0"))) == 1
    assert n(logs, q="FOR LEVEL") == 20
    assert n(logs, q="%") == 1
    assert n(logs, service="does-not-exist") == 0


def test_typed_attribute_forms(logs):
    for text in ("2", "2.0", "02", "2e0", " 2 ", "0x2"):
        assert n(logs, service="svc-2", attrs=(("retries", text),)) == 4, text
    assert n(logs, attrs=(("retries", " "),)) == 4  # blank reads as 0
    assert n(logs, attrs=(("retries", ""),)) == 0
    assert n(logs, attrs=(("retries", "2d"),)) == 0


def test_order_and_boundaries(logs):
    rows = list_rows(logs, ListSpec(LogFilter(since="2026-07-20T14:00:00Z", until="2026-07-20T14:00:01Z"))).collect()
    assert len(rows) == 5
    assert [r["id"] for r in rows] == sorted([r["id"] for r in rows], reverse=True)


def test_page_walk(logs):
    seen, pages, bm = [], 0, None
    while True:
        rows, bm = fetch_page(logs, ListSpec(LogFilter(), limit=7, bookmark=bm))
        pages += 1
        seen += [r["id"] for r in rows]
        if bm is None:
            break
    assert pages >= 3 and len(seen) == 21 and len(set(seen)) == 21


def test_last_page_has_no_bookmark(logs):
    rows, bm = fetch_page(logs, ListSpec(LogFilter(), limit=1000))
    assert len(rows) == 21 and bm is None
    assert next_bookmark(logs, ListSpec(LogFilter(), limit=1000)).count() == 0
    assert next_bookmark(logs, ListSpec(LogFilter(), limit=20)).count() == 1


def test_page_index_matches_walk(logs):
    idx = page_index(logs, LogFilter(), 7).orderBy("page_no").collect()
    assert [r["n_rows"] for r in idx] == [7, 7, 7]
    walk, bm = [], None
    while True:
        rows, bm = fetch_page(logs, ListSpec(LogFilter(), limit=7, bookmark=bm))
        walk.append((rows[0]["id"], rows[-1]["id"]))
        if bm is None:
            break
    assert [(r["first_id"], r["last_id"]) for r in idx] == walk


def test_render(logs):
    r = render_rows(list_rows(logs, ListSpec(LogFilter(service="svc-0", level="debug")))).first()
    assert r["ts"] == "2026-07-20T14:00:00.000Z" and r["id"] == "1"
    assert "tenant_id" not in render_rows(list_rows(logs, ListSpec())).columns


@pytest.mark.parametrize(
    "kw,msg",
    [
        (dict(level="fatal"), "unsupported level: 'fatal'"),
        (dict(since="2026-07-20T15:00:00Z", until="2026-07-20T14:00:00Z"), "until must not be earlier than since"),
        (dict(service=""), "service must be a non-empty string"),
        (dict(attrs=(("", "x"),)), "invalid attribute key"),
        (dict(since="20260720"), "invalid timestamp: '20260720'"),
    ],
)
def test_argument_errors(kw, msg):
    with pytest.raises(ValueError, match=msg.replace("(", r"\(")):
        LogFilter(**kw)


@pytest.mark.parametrize("limit", [0, 1001, 2000])
def test_limit_bounds(limit):
    with pytest.raises(ValueError, match="limit must be between 1 and 1000"):
        ListSpec(limit=limit)


def test_equal_bounds_legal_and_empty_q():
    LogFilter(since="2026-07-20T14:00:00Z", until="2026-07-20T14:00:00Z")
    assert LogFilter(q="").q is None


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_full_walk_in_other_process_zones(spark, monkeypatch, zone):
    import time

    monkeypatch.setenv("TZ", zone)
    time.tzset()
    try:
        logs, mark, seen = list_dataset(spark), None, []
        for _ in range(10):
            rows, mark = fetch_page(logs, ListSpec(LogFilter(), 5, mark))
            seen += [r["id"] for r in rows]
            if mark is None:
                break
    finally:
        monkeypatch.undo()
        time.tzset()
    assert mark is None and sorted(seen) == list(range(1, 22))
