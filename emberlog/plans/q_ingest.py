"""Catalog entries for batch ingest: envelopes, validation, receipts (S1, S2, S9, V1-V11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog import schema as S
from emberlog.functions.timefns import iso_ms
from emberlog.functions.written import written
from emberlog.plans import oracle as O
from emberlog.plans.catalog import register
from emberlog.plans.ingest import ID_SHIFT, parse_batch, validate_batch, validate_parsed, with_ids
from emberlog.session import configure
from emberlog.sources.envelopes import MALFORMED_BODY, NOT_ENVELOPE, explode_entries, parse_envelopes
from emberlog.sources.events import read_table
from emberlog.sources.requests import AS_OF, SELECTOR_MOD, requests_from_events
from emberlog.spec import to_utc

def ingest_frames(spark, sf_dir):
    configure(spark)
    docs = requests_from_events(spark, sf_dir).select("doc_id", "value", "tenant_id")
    return validate_batch(docs, as_of=to_utc(AS_OF))


def _q(s: str) -> str:
    return O.str_lit(s)


# Expected outcome of each generated request, computed from ``events`` alone.
REQ_CTE = f"req AS (SELECT *, id % {SELECTOR_MOD} AS sel, printf('req-%010d', id) AS doc_id FROM logs)"
EXPECTED_REASON = (
    "CASE sel "
    f"WHEN 0 THEN {_q(S.REASON_BAD_LEVEL.format(value='critical'))} "
    f"WHEN 1 THEN {_q(S.REASON_BAD_TIMESTAMP.format(value='garbage'))} "
    f"WHEN 2 THEN {_q(S.REASON_EMPTY.format(field='service'))} "
    f"WHEN 3 THEN {_q(S.REASON_MISSING.format(field='message'))} "
    f"WHEN 4 THEN {_q(S.REASON_BAD_ATTR.format(key='k'))} "
    f"WHEN 5 THEN {_q(S.REASON_ATTRS_NOT_OBJECT)} "
    f"WHEN 6 THEN {_q(S.REASON_NOT_STRING.format(field='timestamp'))} "
    f"WHEN 7 THEN {_q(S.REASON_NOT_OBJECT)} "
    f"WHEN 8 THEN {_q(S.REASON_FUTURE)} "
    "ELSE NULL END"
)
ENTRIES_SQL = (
    f"SELECT doc_id, 0 AS entry_index, sel, {EXPECTED_REASON} AS reason FROM req WHERE sel NOT IN (9, 10)\n"
    f"UNION ALL SELECT doc_id, 1, sel, {_q(S.REASON_BAD_LEVEL.format(value='fatal'))} FROM req WHERE sel = 12"
)


@register(
    "ingest_explode",
    O.with_logs(
        "SELECT doc_id, entry_index, sel <> 7 AS is_object FROM entries",
        REQ_CTE + f",\nentries AS ({ENTRIES_SQL})",
    ),
)
def q_ingest_explode(spark, sf_dir):
    configure(spark)
    docs = requests_from_events(spark, sf_dir)
    e = explode_entries(parse_envelopes(docs))
    return e.select("doc_id", "entry_index", F.schema_of_variant("v").startswith("OBJECT").alias("is_object"))


@register(
    "ingest_bad_batches",
    O.with_logs(
        f"SELECT doc_id, CASE sel WHEN 9 THEN {_q(MALFORMED_BODY)} ELSE {_q(NOT_ENVELOPE)} END AS error\n"
        "FROM req WHERE sel IN (9, 10)",
        REQ_CTE,
    ),
)
def q_ingest_bad_batches(spark, sf_dir):
    return ingest_frames(spark, sf_dir).bad


@register(
    "validate_counts",
    O.with_logs("SELECT reason, count(*) AS n FROM entries GROUP BY reason", REQ_CTE + f",\nentries AS ({ENTRIES_SQL})"),
)
def q_validate_counts(spark, sf_dir):
    return ingest_frames(spark, sf_dir).entries.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register(
    "validate_reasons",
    O.with_logs(
        "SELECT doc_id, entry_index, reason FROM entries WHERE reason IS NOT NULL",
        REQ_CTE + f",\nentries AS ({ENTRIES_SQL})",
    ),
)
def q_validate_reasons(spark, sf_dir):
    return ingest_frames(spark, sf_dir).rejected.select("doc_id", "entry_index", "reason")


ACCEPT_SQL = (
    "SELECT doc_id, 0 AS entry_index, " + O.iso("ts") + " AS ts, level, service, message,\n"
    "  CASE WHEN sel = 11 THEN '{\"k\":\"' || json_extract(attributes, '$.k') || '\",\"ok\":true}'\n"
    "       ELSE '{\"k\":' || json_extract(attributes, '$.k') || '}' END AS attributes, tenant_id\n"
    "FROM req WHERE sel >= 11"
)


@register("ingest_accept", O.with_logs(ACCEPT_SQL, REQ_CTE))
def q_ingest_accept(spark, sf_dir):
    v = ingest_frames(spark, sf_dir).entries.where(F.col("reason").isNull())
    return v.select("doc_id", "entry_index", iso_ms("ts").alias("ts"), "level", "service", "message",
                    F.to_json("attributes_v").alias("attributes"), "tenant_id")


# Ids by document order: the entries of earlier documents, then the place in the document.
IDS_SQL = (
    "SELECT doc_id, entry_index, CAST(row_number() OVER (ORDER BY doc_id, entry_index) - 1 AS BIGINT) AS position, TRUE AS same\n"
    "FROM entries"
)
ID_BATCH = 3


@register("ingest_ids", O.with_logs(IDS_SQL, REQ_CTE + f",\nentries AS ({ENTRIES_SQL})"))
def q_ingest_ids(spark, sf_dir):
    """Position of every entry in its batch, numbered over two partitionings of the same documents."""
    configure(spark)
    docs = requests_from_events(spark, sf_dir).select("doc_id", "value", "tenant_id")

    def ids(dealt, name):
        documents = validate_parsed(parse_batch(dealt), as_of=to_utc(AS_OF))
        return with_ids(documents, ID_BATCH).select("doc_id", "entry_index", F.col("id").alias(name))

    one, other = ids(docs.repartition(3), "id"), ids(docs.repartition(11, "value"), "again")
    both = one.join(other, ["doc_id", "entry_index"], "full_outer")
    return both.select("doc_id", "entry_index", (F.col("id") - ID_BATCH * ID_SHIFT).alias("position"), (F.col("id") == F.col("again")).alias("same"))


RECEIPT_SQL = (
    "SELECT doc_id,\n"
    "  CAST(CASE WHEN sel >= 11 THEN 1 ELSE 0 END AS BIGINT) AS accepted,\n"
    "  CAST(CASE WHEN sel IN (9, 10) THEN 0 WHEN sel = 12 THEN 1 WHEN sel >= 11 THEN 0 ELSE 1 END AS BIGINT) AS rejected,\n"
    "  CASE WHEN sel IN (9, 10) THEN 'bad_batch' WHEN sel >= 11 THEN 'accepted' ELSE 'refused' END AS status,\n"
    "  CASE sel WHEN 9 THEN "
    + _q(MALFORMED_BODY)
    + " WHEN 10 THEN "
    + _q(NOT_ENVELOPE)
    + " END AS error\nFROM req"
)
REJECTIONS_SQL = (
    "SELECT r.*, coalesce(x.rejections, '[]') AS rejections FROM (" + RECEIPT_SQL + ") r LEFT JOIN (\n"
    "  SELECT doc_id, '[' || string_agg('{\"index\":' || entry_index || ',\"reason\":\"' || reason || '\"}', ',' ORDER BY entry_index) || ']' AS rejections\n"
    "  FROM entries WHERE reason IS NOT NULL GROUP BY doc_id) x ON x.doc_id = r.doc_id"
)


@register("ingest_receipt", O.with_logs(REJECTIONS_SQL, REQ_CTE + f",\nentries AS ({ENTRIES_SQL})"))
def q_ingest_receipt(spark, sf_dir):
    """What each sender is told, with the list of rejected entries as JSON text."""
    return ingest_frames(spark, sf_dir).receipts.withColumn("rejections", F.to_json("rejections"))


def _pct(p: int) -> str:
    return (f"coalesce(max(value) FILTER (WHERE rk = least(n - 1, CAST(floor({p}.0 / 100.0 * n) AS BIGINT))), 0) AS p{p}")


LOAD_SQL = (
    "SELECT s.*, l.p50, l.p95, l.p99 FROM (SELECT service, count(*) AS sent, CAST(sum(accepted) AS BIGINT) AS accepted,\n"
    "  CAST(sum(rejected) AS BIGINT) AS rejected,\n"
    "  count(*) FILTER (WHERE status = 'accepted') AS docs_accepted,\n"
    "  count(*) FILTER (WHERE status = 'refused') AS docs_refused,\n"
    "  count(*) FILTER (WHERE status = 'bad_batch') AS docs_bad,\n"
    "  CASE WHEN sum(accepted) + sum(rejected) > 0 THEN CAST(sum(accepted) AS DOUBLE) / "
    "CAST(sum(accepted) + sum(rejected) AS DOUBLE) END AS accept_ratio,\n"
    "  (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS window_s,\n"
    "  CAST(sum(accepted) AS DOUBLE) / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000, 0) AS accepted_per_s\n"
    "FROM (" + RECEIPT_SQL.replace("SELECT doc_id,", "SELECT doc_id, service, ts,", 1) + ") r GROUP BY service) s\n"
    "JOIN (SELECT service, " + ", ".join(_pct(p) for p in (50, 95, 99)) + "\n"
    "  FROM (SELECT l.service, e.value, row_number() OVER (PARTITION BY l.service ORDER BY e.value) - 1 AS rk,\n"
    "        count(e.value) OVER (PARTITION BY l.service) AS n FROM logs l JOIN events e ON e.event_id = l.id) t GROUP BY service) l\n"
    "ON l.service = s.service"
)


@register("load_summary", O.with_logs(LOAD_SQL, REQ_CTE))
def q_load_summary(spark, sf_dir):
    """The load of each service: outcomes, arrival window, rate, and percentiles of the value that stands for a latency."""
    from emberlog.operators.report import load_summary

    configure(spark)
    docs = requests_from_events(spark, sf_dir)
    receipts = validate_batch(docs.select("doc_id", "value", "tenant_id"), as_of=to_utc(AS_OF)).receipts
    # The label of a request is the service that sent it (from the view, not the body).
    arrived = read_table(spark, sf_dir, "events").select(F.col("event_id"), F.col("ts").alias("arrived"), F.col("value").alias("latency"))
    sent = docs.select("doc_id", "service", "event_id").join(arrived, "event_id")
    # Read more than once (counts, then the bins of the latencies).
    rows = written(receipts.join(sent, "doc_id").select("service", "accepted", "rejected", "status", "arrived", "latency"), "load-receipts")
    return load_summary(rows, "service", "arrived", "latency")
