"""Entry validation: every rule and reason, in order (mixed batch and unit cases)."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.operators.validate import validate_entries
from emberlog.sources.envelopes import explode_entries, parse_envelopes

AS_OF = datetime(2026, 7, 20, 14, 40, 0, tzinfo=timezone.utc)
BASE = {
    "timestamp": "2026-07-20T14:32:01.123Z",
    "level": "info",
    "service": "checkout",
    "message": "payment declined",
    "attributes": {"user_id": "42"},
}
NESTED = "attribute '{k}' must be a string, number or boolean; nested objects and arrays are not allowed"


def _with(**kw):
    e = dict(BASE)
    for k, v in kw.items():
        if v is ...:
            e.pop(k)
        else:
            e[k] = v
    return e


def run(spark, entries, as_of=AS_OF):
    doc = json.dumps({"logs": entries})
    docs = spark.createDataFrame([("d1", doc)], "doc_id string, value string")
    ex = explode_entries(parse_envelopes(docs))
    out = validate_entries(ex, as_of=as_of).orderBy("entry_index")
    return out.select("entry_index", "reason", "ts", "level", "service", "message", "attributes").collect()


def test_mixed_batch(spark):
    entries = [
        BASE,
        _with(level="critical"),
        _with(timestamp="garbage"),
        _with(service=""),
        _with(message=""),
        _with(attributes={"nested": {"a": 1}}),
        _with(attributes=[1, 2]),
        _with(attributes={"v": None}),
        _with(timestamp="2026-07-20T14:50:00.000Z"),
        _with(attributes={"user_id": "42", "retries": 3, "ok": True}),
    ]
    rows = run(spark, entries)
    reasons = [r["reason"] for r in rows]
    assert reasons == [
        None,
        "invalid level: 'critical'",
        "invalid timestamp: 'garbage'",
        "service must be a non-empty string",
        "message must be a non-empty string",
        NESTED.format(k="nested"),
        "attributes must be a flat object of string, number or boolean values",
        NESTED.format(k="v"),
        "timestamp must not be more than five minutes in the future",
        None,
    ]
    assert rows[0]["ts"] == datetime(2026, 7, 20, 14, 32, 1, 123000)
    assert json.loads(rows[9]["attributes"]) == {"user_id": "42", "retries": 3, "ok": True}


@pytest.mark.parametrize(
    "entry,reason",
    [
        (_with(service=...), "missing required field: 'service'"),
        (_with(timestamp=...), "missing required field: 'timestamp'"),
        (_with(level=..., message=...), "missing required field: 'level'"),
        (_with(timestamp=12345), "timestamp must be a string"),
        (_with(timestamp="yesterday at noon"), "invalid timestamp: 'yesterday at noon'"),
        (_with(timestamp="2026-07-20"), "invalid timestamp: '2026-07-20'"),
        (_with(timestamp="2026-06-30T23:59:60Z"), "invalid timestamp: '2026-06-30T23:59:60Z'"),
        (_with(timestamp="2026-02-30T10:00:00Z"), "invalid timestamp: '2026-02-30T10:00:00Z'"),
        (_with(attributes={"tags": ["a"]}), NESTED.format(k="tags")),
        (_with(attributes={"trace": None}), NESTED.format(k="trace")),
        (_with(attributes={"a/b": None}), NESTED.format(k="a~1b")),
        (_with(service=None), "service must be a string"),
        (_with(level=3), "level must be a string"),
        (_with(message=["x"]), "message must be a string"),
        (_with(attributes="flat"), "attributes must be a flat object of string, number or boolean values"),
        (None, "entry must be a object"),
        (42, "entry must be a object"),
        ("string", "entry must be a object"),
        ([], "entry must be a object"),
        (True, "entry must be a object"),
    ],
)
def test_single_rules(spark, entry, reason):
    assert run(spark, [entry])[0]["reason"] == reason


def test_accepted_variants(spark):
    rows = run(
        spark,
        [
            _with(attributes=...),
            _with(timestamp="2026-07-20T14:45:00.000Z"),  # exactly as_of + 5 min
            _with(attributes={"s": "x", "n": 3.14, "b": False}),
            dict(BASE, trace_id="abc", nested={"x": 1}),
            _with(timestamp="2026-07-20t14:32:01.5+02:00"),
            _with(timestamp="1999-01-01T00:00:00Z"),  # no past limit
        ],
    )
    assert [r["reason"] for r in rows] == [None] * 6
    assert rows[0]["attributes"] == "{}"
    assert rows[4]["ts"] == datetime(2026, 7, 20, 12, 32, 1, 500000)


def test_future_boundary_is_inclusive(spark):
    rows = run(spark, [_with(timestamp="2026-07-20T14:45:00.001Z")])
    assert rows[0]["reason"] == "timestamp must not be more than five minutes in the future"


def test_duplicate_keys_last_wins(spark):
    doc = '{"logs":[{"timestamp":"2026-07-20T14:32:01Z","level":"warn","level":"info","service":"s","message":"m"}]}'
    docs = spark.createDataFrame([("d", doc)], "doc_id string, value string")
    r = validate_entries(explode_entries(parse_envelopes(docs)), as_of=AS_OF).collect()[0]
    assert r["reason"] is None and r["level"] == "info"


def test_bad_envelopes(spark):
    docs = spark.createDataFrame(
        [("a", "{ not json"), ("b", "{}"), ("c", '{"logs":"nope"}'), ("d", '{"logs":42}'),
         ("e", "[]"), ("f", '"hello"'), ("g", "null"), ("h", '{"logs":[]}'), ("i", "")],
        "doc_id string, value string",
    )
    p = parse_envelopes(docs)
    got = {r["doc_id"]: r["envelope_error"] for r in p.collect()}
    assert got["a"] == "malformed JSON body"
    assert got["i"] == "malformed JSON body"
    for k in "bcdefg":
        assert got[k] == "request body must be a JSON object with a 'logs' array", k
    assert got["h"] is None
    assert explode_entries(p).count() == 0
    assert p.where(F.col("doc_id") == "h").select(F.size("logs")).first()[0] == 0


def test_only_one_strict_json_value_is_a_body(spark):
    from emberlog.sources.envelopes import MALFORMED_BODY, NOT_ENVELOPE, parse_envelopes

    bodies = {
        '{"logs":[1]}': None, ' {"logs":[]}\n': None, '{"a":1,"a":2,"logs":[]}': None, '{"logs":"x","logs":[2]}': None,
        '{"logs":[1]} garbage': MALFORMED_BODY, '{"logs":[1]}}': MALFORMED_BODY, '{"logs":[1]}{"logs":[]}': MALFORMED_BODY,
        '{"logs":[]}] x': MALFORMED_BODY, '{"logs":[]},1': MALFORMED_BODY, "{'logs':[]}": MALFORMED_BODY, "": MALFORMED_BODY,
        '{"logs":[{"a":NaN}]}': MALFORMED_BODY, '{"logs":[1],"logs":"nope"}': NOT_ENVELOPE, "[]": NOT_ENVELOPE, '{"logs":null}': NOT_ENVELOPE,
    }
    got = parse_envelopes(spark.createDataFrame([(b, b) for b in bodies], "doc_id string, value string"))
    assert {r["doc_id"]: r["envelope_error"] for r in got.select("doc_id", "envelope_error").collect()} == bodies


def test_offsets_to_the_end_of_the_day_and_no_year_zero(spark):
    from pyspark.sql import functions as F

    from emberlog.operators.validate import parse_timestamp

    cases = {"2024-01-02T00:00:00+23:59": "2024-01-01 00:01:00", "2024-01-02T00:00:00.5-19:30": "2024-01-02 19:30:00.5",
             "2024-01-02T00:00:00+24:00": None, "0000-06-01T00:00:00Z": None, "0001-01-01T00:00:00+01:00": None,
             "0001-01-01T00:00:00Z": "0001-01-01 00:00:00", "2024-01-02t10:00:00z": "2024-01-02 10:00:00", "2024-02-30T00:00:00+19:00": None}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["p"] for r in df.select("t", parse_timestamp(F.col("t")).cast("string").alias("p")).collect()} == cases


def checked(spark, body, as_of=AS_OF):
    from emberlog.plans.ingest import validate_batch

    docs = spark.createDataFrame([("d", body)], "doc_id string, value string")
    return [r["reason"] for r in validate_batch(docs, as_of=as_of).entries.orderBy("entry_index").collect()]


@pytest.mark.parametrize("attributes,key", [
    ('{"z":[1],"a":[1]}', "z"), ('{"ok":1,"b":{},"a":null}', "b"), ('{"z":[1],"10":null,"9":{},"a":[1]}', "9"), ('{"01":[1],"z":[1],"1":"x"}', "01"),
    ('{"z":[1],"y":[],"z":"fine"}', "y"), ('{"z":1,"y":[],"z":[2]}', "z"), ('{"b/c":{"x":{"a":1}},"a~":[]}', "b~1c"), ('{"4294967295":[],"7":[],"é":[]}', "7"),
    ('{"4294967295":[],"é":[]}', "4294967295"), ('{"é":[],"4294967295":[]}', "é"),
])
def test_first_bad_attribute_is_the_first_of_the_text(spark, attributes, key):
    """Keys in the order of the text, those that are array indexes first in ascending order, a repeated key where it first stands."""
    base = '"timestamp":"2026-07-20T14:32:01Z","level":"info","service":"s","message":"m"'
    body = '{"x":{"logs":7},"logs":[4,{' + base + ',"attributes":{"q":[]}},{' + base + ',"attributes":' + attributes + "}]}"
    assert checked(spark, body) == ["entry must be a object", NESTED.format(k="q"), NESTED.format(k=key)]
