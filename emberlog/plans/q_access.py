"""Catalog entries for access control (J1, X1-X4, S8) and retention (R1, R4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from emberlog import schema as S
from emberlog.operators.access import key_rows, stamp_tenant, verdicts
from emberlog.operators.aggregate import render_buckets, rollup_counts
from emberlog.operators.retention import cutoff_of, expire, expired_count
from emberlog.operators.rollup import build_rollup
from emberlog.plans import oracle as O
from emberlog.plans.catalog import register
from emberlog.plans.q_ingest import RECEIPT_SQL, REQ_CTE
from emberlog.session import checkpoint_dir, configure
from emberlog.sources.events import read_table
from emberlog.sources.store import LogStore
from emberlog.spec import AggregateSpec, to_utc

# Fixed key list of the access checks: (plaintext, scopes, tenant).
API_KEYS = [
    ("key-0", ["ingest", "query"], None),
    ("key-1", ["ingest"], None),
    ("key-2", ["ingest", "query"], "a"),
    ("key-3", ["query"], "b"),
]  # key-4 is never issued


def _keys(spark):
    df = spark.createDataFrame(
        [(k, f"name-{k}", sc, t) for k, sc, t in API_KEYS],
        "key string, name string, scopes array<string>, tenant_id string",
    )
    return key_rows(df)


def _requests(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    uid = F.col("user_id")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.when(uid % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("key-"), (uid % 5).cast("string"))).alias("api_key"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("query")).otherwise(F.lit("ingest")).alias("need"),
    )


KEYS_SQL = "keys(key_hash, scopes, tenant_id) AS (" + " UNION ALL ".join(
    f"SELECT sha256({O.str_lit(k)}), [{', '.join(O.str_lit(s) for s in sc)}], "
    f"{O.str_lit(t) if t else 'CAST(NULL AS VARCHAR)'}"
    for k, sc, t in API_KEYS
) + ")"
REQ_SQL = (
    "req AS (SELECT event_id AS request_id,\n"
    "  CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('key-', CAST(user_id % 5 AS VARCHAR)) END AS api_key,\n"
    "  CASE WHEN event_type IN ('view', 'click') THEN 'query' ELSE 'ingest' END AS need FROM events)"
)
VERDICT_SQL = (
    "verdicts AS (SELECT request_id, need,\n"
    f"  CASE WHEN api_key IS NULL OR length(api_key) = 0 OR length(api_key) > {S.MAX_KEY_LENGTH} "
    f"THEN {O.str_lit(S.VERDICT_MALFORMED)}\n"
    f"       WHEN k.key_hash IS NULL THEN {O.str_lit(S.VERDICT_UNKNOWN)}\n"
    "       WHEN NOT list_contains(k.scopes, need) THEN '403 insufficient permissions: scope ''' || need || ''' required'\n"
    "       ELSE 'ok' END AS verdict, k.tenant_id AS k_tenant\n"
    "  FROM req LEFT JOIN keys k ON sha256(req.api_key) = k.key_hash)"
)


@register(
    "access_verdict",
    f"WITH {KEYS_SQL},\n{REQ_SQL},\n{VERDICT_SQL}\n"
    "SELECT request_id, verdict, CASE WHEN verdict = 'ok' THEN k_tenant END AS key_tenant FROM verdicts",
)
def q_access_verdict(spark, sf_dir):
    configure(spark)
    v = verdicts(_requests(spark, sf_dir), _keys(spark), F.col("need"))
    return v.select("request_id", "verdict", "key_tenant")


@register(
    "access_stamp",
    f"WITH {KEYS_SQL},\n{REQ_SQL},\n{VERDICT_SQL}\n"
    "SELECT request_id, k_tenant AS tenant_id FROM verdicts WHERE verdict = 'ok' AND need = 'ingest'",
)
def q_access_stamp(spark, sf_dir):
    configure(spark)
    v = verdicts(_requests(spark, sf_dir), _keys(spark), F.col("need"))
    return stamp_tenant(v).where(F.col("need") == "ingest").select("request_id", "tenant_id")


@register(
    "key_seed",
    "WITH u AS (SELECT user_id, bool_or(event_type = 'signup') AS first FROM events GROUP BY user_id)\n"
    "SELECT sha256(concat('user-key-', CAST(user_id AS VARCHAR))) AS key_hash,\n"
    "  CASE WHEN first THEN 'first' ELSE 'second' END AS name,\n"
    "  CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'a' ELSE 'b' END AS tenant_id FROM u",
)
def q_key_seed(spark, sf_dir):
    """Stored seeds of signed-up users (repeated once for each signup), then of every user, then the first once more:
    the first seed of a key wins."""
    configure(spark)
    ev = read_table(spark, sf_dir, "events")
    uid = F.col("user_id")

    def users(df, name):
        return df.select(
            F.concat(F.lit("user-key-"), uid.cast("string")).alias("key"),
            F.lit(name).alias("name"),
            F.lit(None).cast("array<string>").alias("scopes"),
            F.when(uid % 3 == 0, F.lit(None).cast("string")).when(uid % 3 == 1, "a").otherwise("b").alias("tenant_id"),
        )

    store = LogStore(f"{checkpoint_dir(spark)}/keys-{uuid.uuid4().hex}")
    signups = users(ev.where(F.col("event_type") == "signup"), "first")
    for keys in (signups, users(ev, "second"), signups):
        store.seed_keys(spark, keys)
    return store.keys(spark).select("key_hash", "name", "tenant_id")


# ---------------------------------------------------------------------------
# Retention
# ---------------------------------------------------------------------------
RET_AS_OF = to_utc("2024-01-20T00:00:00.500Z")
RET_HOURS = 240
RET_CUT = cutoff_of(RET_AS_OF, RET_HOURS)


@register(
    "retention_kept",
    O.with_logs(
        f"SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM logs WHERE ts >= {O.ts_lit(RET_CUT)} GROUP BY 1"
    ),
)
def q_retention_kept(spark, sf_dir):
    from emberlog.plans.catalog import logs_of

    kept, _, _ = expire(logs_of(spark, sf_dir), None, RET_AS_OF, RET_HOURS)
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@register(
    "retention_expired_count",
    O.with_logs(f"SELECT count(*) AS expired FROM logs WHERE ts < {O.ts_lit(RET_CUT)}"),
)
def q_retention_expired_count(spark, sf_dir):
    from emberlog.plans.catalog import logs_of

    return expired_count(logs_of(spark, sf_dir), RET_AS_OF, RET_HOURS)


RET_SPEC = AggregateSpec("2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z", "1h", "level")


@register(
    "retention_counts",
    O.with_logs(
        f"SELECT {O.iso(O.bucket_sql('ts', 3600))} AS bucket_start, level AS group_name, count(*) AS count\n"
        f"FROM logs WHERE ts >= {O.ts_lit(RET_CUT)} GROUP BY 1, 2"
    ),
)
def q_retention_counts(spark, sf_dir):
    """After expiry the rollup answers exactly what the kept rows say."""
    from emberlog.plans.catalog import logs_of

    logs = logs_of(spark, sf_dir)
    kept, kept_counts, _ = expire(logs, build_rollup(logs), RET_AS_OF, RET_HOURS)
    return render_buckets(rollup_counts(kept, kept_counts, RET_SPEC))




# ---------------------------------------------------------------------------
# Ingest behind the key check (X1 + S9): request bodies from events, each
# sent with its sender's key.
# ---------------------------------------------------------------------------
@register(
    "access_ingest",
    O.with_logs(
        "SELECT r.doc_id,\n"
        "  CASE WHEN v.verdict <> 'ok' THEN 'denied' WHEN r.status = 'bad_batch' THEN 'bad_batch' ELSE r.status END AS status,\n"
        "  CASE WHEN v.verdict <> 'ok' THEN v.verdict ELSE r.error END AS error,\n"
        "  CASE WHEN v.verdict <> 'ok' THEN CAST(0 AS BIGINT) ELSE r.accepted END AS accepted,\n"
        "  CASE WHEN v.verdict <> 'ok' THEN CAST(0 AS BIGINT) ELSE r.rejected END AS rejected\n"
        "FROM receipts r JOIN verdicts v ON r.event_id = v.request_id",
        "\n,".join([
            REQ_CTE,
            KEYS_SQL,
            "reqk AS (SELECT event_id AS request_id,\n"
            "  CASE WHEN user_id % 11 = 0 THEN '' ELSE concat('key-', CAST(user_id % 5 AS VARCHAR)) END AS api_key,\n"
            "  'ingest' AS need FROM events)",
            VERDICT_SQL.replace("FROM req LEFT JOIN", "FROM reqk req LEFT JOIN"),
            "receipts AS (" + RECEIPT_SQL.replace("SELECT doc_id,", "SELECT doc_id, id AS event_id,", 1) + ")",
        ]),
    ),
)
def q_access_ingest(spark, sf_dir):
    from emberlog.plans.ingest import validate_batch
    from emberlog.sources.requests import AS_OF, requests_from_events

    configure(spark)
    uid_key = _requests(spark, sf_dir).select(F.col("request_id").alias("event_id"), "api_key")
    docs = requests_from_events(spark, sf_dir).join(uid_key, "event_id").select("doc_id", "value", "api_key")
    fr = validate_batch(docs, as_of=to_utc(AS_OF), keys=_keys(spark))
    return fr.receipts.select("doc_id", "status", "error", "accepted", "rejected")
