"""The driver's ``events`` table as a stream of ingest request bodies.

Every event becomes one request document ``{"logs": [...]}`` carrying that
event as a log entry. A rule on the event id picks how the entry (or the
document) is spoiled, so every validation rule and both whole-document
refusals occur at a known rate, and an oracle can compute the expected
outcome of each request straight from ``events``. All rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.spread import spread
from emberlog.sources.events import logs_from_events

# The outcome of each selector value (event_id % 20).
SPOIL_RULES = {
    0: "level 'critical'",
    1: "timestamp 'garbage'",
    2: "empty service",
    3: "message missing",
    4: "nested attribute value",
    5: "attributes is an array",
    6: "timestamp is a number",
    7: "entry is a number",
    8: "timestamp a year ahead",
    9: "document is not JSON",
    10: "logs is not an array",
    11: "valid, extra field, string and boolean attributes",
    12: "two entries: valid, then level 'fatal'",
    # 13 to 19: a valid entry as is.
}
SELECTOR_MOD = 20
AS_OF = "2024-02-01T00:00:00Z"  # validation clock for generated requests


def _entry(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]))


def requests_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, value, tenant_id, service, event_id): one request body per event."""
    # A body costs far more than the event it is made of, and a file of one row group is read by one task.
    df = spread(logs_from_events(spark, sf_dir), "id", "ts", "message")
    sel = F.col("id") % SELECTOR_MOD
    text = F.col("attributes")
    written_at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    year_ahead = F.date_format(F.col("ts") + F.expr("INTERVAL 366 DAYS"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    # One choice for each field, not one entry for each rule: the generated code of an entry for each rule, several times
    # in a body, is too long for the JVM to compile.
    ts_text = F.when(sel == 1, F.lit("garbage")).when(sel == 8, year_ahead).otherwise(written_at)
    # sel 11: attributes become {"k": "<k as text>", "ok": true}.
    k_text = F.get_json_object("attributes", "$.k")
    attrs = F.parse_json(
        F.when(sel == 4, F.concat(F.lit('{"k":'), text, F.lit("}")))
        .when(sel == 5, F.concat(F.lit("["), text, F.lit("]")))
        .when(sel == 11, F.concat(F.lit('{"k":"'), k_text, F.lit('","ok":true}')))
        .otherwise(text))
    # A field that is NULL is left out.
    fields = dict(
        level=F.when(sel == 0, F.lit("critical")).otherwise(F.col("level")),
        service=F.when(sel == 2, F.lit("")).otherwise(F.col("service")),
        message=F.when(~F.coalesce(sel == 3, F.lit(False)), F.col("message")),
        attributes=attrs,
        trace_id=F.when(sel == 11, F.concat(F.lit("t-"), F.col("id").cast("string"))))
    entry = (
        F.when(sel == 6, _entry(timestamp=F.unix_millis("ts"), **fields))
        .when(sel == 7, F.col("id").cast("string"))
        .otherwise(_entry(timestamp=ts_text, **fields))
    )
    fatal = _entry(timestamp=written_at, level=F.lit("fatal"), service=F.col("service"), message=F.col("message"), attributes=F.parse_json("attributes"))
    end = (
        F.when(sel == 9, F.lit("]"))
        .when(sel == 10, F.lit("}"))
        .when(sel == 12, F.concat(F.lit(", "), fatal, F.lit("]}")))
        .otherwise(F.lit("]}"))
    )
    body = F.concat(F.when(sel == 10, F.lit('{"logs": ')).otherwise(F.lit('{"logs": [')), entry, end)
    return df.select(
        F.format_string("req-%010d", F.col("id")).alias("doc_id"),
        body.alias("value"),
        "tenant_id",
        "service",
        F.col("id").alias("event_id"),
    )
