"""Driver-side helpers: JavaScript number reading, second bounds, bookmarks with large ids."""

from datetime import datetime, timedelta, timezone

import pytest

from emberlog.functions.attrs import js_number
from emberlog.functions.timefns import ceil_second, floor_second
from emberlog.operators.listing import fetch_page
from emberlog.spec import Bookmark, ListSpec, LogFilter, to_utc

from helpers import logs_df, utc


@pytest.mark.parametrize(
    "text,value",
    [("2", 2.0), ("2.0", 2.0), ("02", 2.0), ("2e0", 2.0), (" 2 ", 2.0), ("\n42\t", 42.0), ("0x2", 2.0),
     ("0X1f", 31.0), ("0b101", 5.0), ("0o17", 15.0), (".5", 0.5), ("5.", 5.0), ("-.5", -0.5), ("+3", 3.0),
     (" ", 0.0), ("1e3", 1000.0)],
)
def test_js_number_reads(text, value):
    assert js_number(text) == value


@pytest.mark.parametrize("text", ["2d", "1_000", "+0x10", "0x", "1e", "--1", "Infinity", "-Infinity", "NaN",
                                  "1,5", "0b2"])
def test_js_number_rejects(text):
    assert js_number(text) is None


def test_second_bounds():
    t = datetime(2026, 7, 20, 14, 1, 30, 250000, tzinfo=timezone.utc)
    assert floor_second(t) == t.replace(microsecond=0)
    assert ceil_second(t) == t.replace(microsecond=0) + timedelta(seconds=1)
    aligned = t.replace(microsecond=0)
    assert ceil_second(aligned) == aligned  # a true ceiling


def test_query_bounds_are_millisecond_dates():
    assert to_utc("2026-07-20T14:01:30.123456Z") == datetime(2026, 7, 20, 14, 1, 30, 123000, tzinfo=timezone.utc)
    assert to_utc("2026-07-20T16:01:30+02:00") == datetime(2026, 7, 20, 14, 1, 30, tzinfo=timezone.utc)
    with pytest.raises(ValueError, match="invalid timestamp"):
        to_utc("2026-07-20 14:01:30Z")


def test_bookmark_with_large_ids(spark):
    big = 2**62
    ts = utc(2026, 7, 20, 14, 0, 0)
    rows = [(big + i, ts, "info", "s", "m", {}, None) for i in range(5)]
    logs = logs_df(spark, rows)
    page, bm = fetch_page(logs, ListSpec(LogFilter(), limit=2))
    assert [r["id"] for r in page] == [big + 4, big + 3] and bm == Bookmark(ts, big + 3)
    page, bm = fetch_page(logs, ListSpec(LogFilter(), limit=2, bookmark=bm))
    assert [r["id"] for r in page] == [big + 2, big + 1]


def test_scale_conf():
    from emberlog.session import scale_conf

    c = scale_conf(100 * 1024**4)
    assert c["spark.sql.shuffle.partitions"] == "409600"
    assert scale_conf(10)["spark.sql.shuffle.partitions"] == "200"


def test_bounds_by_their_own_grammar():
    taken = {
        "2026-07-20T24:00:00Z": (2026, 7, 21, 0, 0, 0, 0), "2026-12-31T24:00": (2027, 1, 1, 0, 0, 0, 0), "2026-07-20T10:00": (2026, 7, 20, 10, 0, 0, 0),
        "2026-07-20T10:00:00.1234567Z": (2026, 7, 20, 10, 0, 0, 123000), "2026-07-20T10:00:00.5z": (2026, 7, 20, 10, 0, 0, 500000),
        "2026-07-20T10:00:00+0530": (2026, 7, 20, 4, 30, 0, 0), "2026-07-20T10:00-23:59": (2026, 7, 21, 9, 59, 0, 0), "2026-02-30T00:00:00Z": (2026, 3, 2, 0, 0, 0, 0),
        "2024-02-29T23:59:59.999Z": (2024, 2, 29, 23, 59, 59, 999000),
    }
    for text, parts in taken.items():
        assert to_utc(text) == datetime(*parts, tzinfo=timezone.utc), text
    refused = ["2026-07-20T100000Z", "2026-07-20T10:00:00,5Z", "2026-07-20T24:00:01Z", "2026-07-20T24:00:00.001Z", "2026-13-01T00:00Z", "2026-00-01T00:00Z",
               "2026-07-32T00:00Z", "2026-07-00T00:00Z", "2026-07-20T10Z", "2026-07-20T10:60Z", "2026-07-20T10:00:60Z", "2026-07-20T10:00:00.Z", "2026-07-20T",
               "2026-07-20T10:00:00+24:00", "2026-07-20T10:00:00+5", "2026-07-20T10:00:00Z ", "2026-W30-1T10:00Z", "٢٠٢٦-07-20T10:00Z", "0000-01-01T00:00Z", "9999-12-31T24:00Z"]
    for text in refused:
        with pytest.raises(ValueError, match="invalid timestamp"):
            to_utc(text)
