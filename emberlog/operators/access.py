"""Key-based access as table work: key seeding, verdicts, tenant stamping.

Keys are stored only as SHA-256 hex of the plaintext. A request's verdict is
a left join of its key hash on the key table plus one CASE column; the key
table is a small dimension and is broadcast behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog import schema as S
from emberlog.functions.sizing import maybe_broadcast


KEY_COLUMNS = ["key_hash", "name", "scopes", "tenant_id", "created_at"]


def key_rows(keys: DataFrame) -> DataFrame:
    """(key, name, scopes, tenant_id[, created_at, position]) plaintext → stored key rows (with their position, if given)."""
    created = F.col("created_at") if "created_at" in keys.columns else F.current_timestamp()
    scopes = F.coalesce(F.col("scopes"), F.array(*[F.lit(s) for s in S.DEFAULT_SCOPES]))
    return keys.select(
        F.sha2(F.col("key"), 256).alias("key_hash"),
        F.col("name"),
        scopes.alias("scopes"),
        F.col("tenant_id").cast("string").alias("tenant_id"),
        created.cast("timestamp").alias("created_at"),
        *([F.col("position").cast("bigint").alias("position")] if "position" in keys.columns else []),
    )


def first_seeds(rows: DataFrame) -> DataFrame:
    """One row for each key: of the earliest seed, in it of the lowest position, and of rows equal in both the
    first in the order of name, tenant and scopes. The same whatever the order of the rows."""
    place = F.struct("seed", "position", "name", "tenant_id", "scopes", "created_at")
    kept = rows.groupBy("key_hash").agg(F.min(place).alias("k"))
    return kept.select("key_hash", *[F.col(f"k.{c}").alias(c) for c in (*KEY_COLUMNS[1:], "seed", "position")])


def seed_rows(new_keys: DataFrame, seed: int) -> DataFrame:
    """The rows of one seed (key, name, scopes, tenant_id[, created_at, position]), one for each key."""
    rows = key_rows(new_keys)
    if "position" not in rows.columns:
        rows = rows.withColumn("position", F.lit(0).cast("bigint"))
    return first_seeds(rows.withColumn("seed", F.lit(seed).cast("bigint")))


def seed_keys(existing: DataFrame | None, new_keys: DataFrame) -> DataFrame:
    """Idempotent insert: keys already present keep their row (existing wins); of a key that the new ones repeat the first counts."""
    fresh = seed_rows(new_keys, 0).select(*KEY_COLUMNS)
    if existing is None:
        return fresh
    return existing.unionByName(fresh.join(existing.select("key_hash"), "key_hash", "left_anti"))


def verdicts(requests: DataFrame, keys: DataFrame, scope: str | Column,
             key_col: str = "api_key") -> DataFrame:
    """Add ``verdict`` and the caller's ``key_tenant`` to every request row.

    Missing, empty or over-long key → 401 malformed; unknown hash → 401;
    key without the needed scope → 403; else ok.
    """
    need = F.lit(scope) if isinstance(scope, str) else scope
    k = F.col(key_col)
    table = keys.select("key_hash", F.col("scopes").alias("_scopes"), F.col("tenant_id").alias("key_tenant"))
    joined = requests.join(
        maybe_broadcast(table, 1_000_000),
        F.sha2(k, 256) == F.col("key_hash"),
        "left",
    )
    verdict = (
        F.when(k.isNull() | (F.length(k) == 0) | (F.length(k) > S.MAX_KEY_LENGTH), F.lit(S.VERDICT_MALFORMED))
        .when(F.col("key_hash").isNull(), F.lit(S.VERDICT_UNKNOWN))
        .when(~F.array_contains(F.col("_scopes"), need),
              F.concat(F.lit("403 insufficient permissions: scope '"), need, F.lit("' required")))
        .otherwise(F.lit(S.VERDICT_OK))
    )
    ok = verdict == S.VERDICT_OK
    return joined.select(
        *[F.col(c) for c in requests.columns],
        verdict.alias("verdict"),
        F.when(ok, F.col("key_tenant")).alias("key_tenant"),
    )


def stamp_tenant(requests_with_verdict: DataFrame) -> DataFrame:
    """Accepted callers only, with the tenant that their rows are stored under."""
    return requests_with_verdict.where(F.col("verdict") == S.VERDICT_OK).withColumn(
        "tenant_id", F.col("key_tenant")
    )
