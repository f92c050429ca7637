"""Validation against a brute-force Python rendering of the rules, on random entries."""

import json
import random
import re
from datetime import datetime, timedelta, timezone

from emberlog import schema as S
from emberlog.operators.validate import validate_entries
from emberlog.sources.envelopes import explode_entries, parse_envelopes

AS_OF = datetime(2026, 7, 20, 14, 0, tzinfo=timezone.utc)
SHAPE = re.compile(S.RFC3339_PATTERN)


def parse_rfc3339(text):
    if not SHAPE.match(text):
        return None
    m = re.match(r"(\d{4})-(\d\d)-(\d\d)[Tt ](\d\d):(\d\d):(\d\d)(\.\d+)?([Zz]|([+-])(\d\d):?(\d\d)?)$", text)
    y, mo, d, h, mi, s = (int(m.group(i)) for i in range(1, 7))
    frac = m.group(7) or ""
    micro = int((frac[1:] + "000000")[:6]) if frac else 0
    try:
        t = datetime(y, mo, d, h, mi, s, micro, tzinfo=timezone.utc)
    except ValueError:
        return None
    if m.group(8) not in ("Z", "z"):
        sign = 1 if m.group(9) == "+" else -1
        t -= sign * timedelta(hours=int(m.group(10)), minutes=int(m.group(11) or 0))
    return t.replace(microsecond=micro // 1000 * 1000)


def expected(e):
    if not isinstance(e, dict):
        return S.REASON_NOT_OBJECT
    for f in S.REQUIRED_FIELDS:
        if f not in e:
            return S.REASON_MISSING.format(field=f)
    if not isinstance(e["timestamp"], str):
        return S.REASON_NOT_STRING.format(field="timestamp")
    ts = parse_rfc3339(e["timestamp"])
    if ts is None:
        return S.REASON_BAD_TIMESTAMP.format(value=e["timestamp"])
    if not isinstance(e["level"], str):
        return S.REASON_NOT_STRING.format(field="level")
    if e["level"] not in S.LEVELS:
        return S.REASON_BAD_LEVEL.format(value=e["level"])
    for f in ("service", "message"):
        if not isinstance(e[f], str):
            return S.REASON_NOT_STRING.format(field=f)
        if e[f] == "":
            return S.REASON_EMPTY.format(field=f)
    if "attributes" in e:
        a = e["attributes"]
        if not isinstance(a, dict):
            return S.REASON_ATTRS_NOT_OBJECT
        for k in sorted(a):
            if a[k] is None or isinstance(a[k], (dict, list)):
                return S.REASON_BAD_ATTR.format(key=k.replace("~", "~0").replace("/", "~1"))
    if ts > AS_OF + timedelta(minutes=5):
        return S.REASON_FUTURE
    return None


def rand_value(r, depth=0):
    kind = r.choice(["s", "i", "f", "b", "n", "o", "a"] if depth < 2 else ["s", "i", "f", "b", "n"])
    return {
        "s": lambda: r.choice(["", "x", "info", "eu-west", "42", "a/b"]),
        "i": lambda: r.randint(-5, 10**12),
        "f": lambda: r.choice([0.5, 3.14, -2.25, 1e3]),
        "b": lambda: r.choice([True, False]),
        "n": lambda: None,
        "o": lambda: {r.choice(["k", "z", "a/b", "m~n"]): rand_value(r, depth + 1)},
        "a": lambda: [rand_value(r, depth + 1)],
    }[kind]()


def rand_timestamp(r):
    span = r.choice([10**8, 900])  # far past, or around the five-minute future limit
    base = AS_OF + timedelta(seconds=r.randint(-span, 900), microseconds=r.randint(0, 999_999))
    text = base.strftime("%Y-%m-%dT%H:%M:%S") + r.choice(["", ".1", ".123", ".123456", ".1234567"])
    zone = r.choice(["Z", "z", "+00:00", "+02:00", "-05:30", "+0100", "", "+02"])
    spoil = r.random()
    if spoil < 0.05:
        return text[:10]
    if spoil < 0.08:
        return "2026-02-30T10:00:00Z"
    if spoil < 0.1:
        return text.replace("T", r.choice(["t", " ", "_"]), 1) + zone
    return text + zone


def rand_entry(r):
    if r.random() < 0.05:
        return rand_value(r, 2)
    e = {
        "timestamp": rand_timestamp(r) if r.random() > 0.05 else rand_value(r, 2),
        "level": r.choice(list(S.LEVELS) + ["critical", "INFO"]) if r.random() > 0.05 else rand_value(r, 2),
        "service": r.choice(["checkout", "auth", ""]) if r.random() > 0.05 else rand_value(r, 2),
        "message": r.choice(["payment declined", "", "50% done"]) if r.random() > 0.05 else rand_value(r, 2),
    }
    if r.random() < 0.7:
        e["attributes"] = (
            {r.choice(["user_id", "region", "retries", "a/b", "ok"]): rand_value(r, 1) for _ in range(r.randint(0, 3))}
            if r.random() > 0.1 else rand_value(r, 1)
        )
    for f in S.REQUIRED_FIELDS:
        if r.random() < 0.04:
            e.pop(f, None)
    if r.random() < 0.1:
        e["trace_id"] = "t"
    return e


def test_random_entries_match_brute_force(spark):
    r = random.Random(11)
    entries = [rand_entry(r) for _ in range(3000)]
    doc = json.dumps({"logs": entries})
    docs = spark.createDataFrame([("d", doc)], "doc_id string, value string")
    out = validate_entries(explode_entries(parse_envelopes(docs)), as_of=AS_OF).select(
        "entry_index", "reason", "ts").collect()
    got = {row["entry_index"]: row for row in out}
    mismatches = []
    for i, e in enumerate(entries):
        want = expected(e)
        if got[i]["reason"] != want:
            mismatches.append((i, e, want, got[i]["reason"]))
        elif want is None:
            ts = parse_rfc3339(e["timestamp"])
            assert got[i]["ts"] == ts.replace(tzinfo=None), (e, got[i]["ts"])
    assert not mismatches, mismatches[:5]
    reasons = [expected(e) for e in entries]
    assert reasons.count(None) > 200  # plenty accepted
    assert reasons.count(S.REASON_FUTURE) > 20
    assert len({x.split(":")[0] for x in reasons if x}) >= 10  # most rules fire
