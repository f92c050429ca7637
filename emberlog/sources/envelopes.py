"""JSON batch documents ``{"logs": [entry, ...]}`` → one row per entry.

Each document is read whole (one request body per file) and must be one
strict JSON value (the last of repeated keys counts); the envelope becomes
``array<variant>`` so every entry, whatever its JSON type, keeps its position. Documents that are not JSON, or
have no ``logs`` array, are refused as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed texts of the refusal of a whole document.
MALFORMED_BODY = "malformed JSON body"
NOT_ENVELOPE = "request body must be a JSON object with a 'logs' array"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` → (doc_id, value): one row per file, whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), "value"
    )


def parse_envelopes(docs: DataFrame) -> DataFrame:
    """Add ``logs`` (array<variant> or NULL) and ``envelope_error`` (NULL when fine)."""
    # The parser reads one value and leaves the rest of a text unread. Inside an array that ends with the
    # body's own hash, anything but exactly one strict JSON value breaks the array or moves the hash.
    seal = F.xxhash64("value")
    sealed = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit(","), seal.cast("string"), F.lit("]")))
    whole = F.coalesce(F.try_variant_get("_sealed", "$[1]", "bigint") == seal, F.lit(False))
    logs = F.when(whole, F.try_variant_get("_sealed", "$[0].logs", "array<variant>"))
    error = (
        F.when(F.col("logs").isNotNull(), F.lit(None).cast("string"))
        .when(~whole, F.lit(MALFORMED_BODY))
        .otherwise(F.lit(NOT_ENVELOPE))
    )
    # Each step is a column: written into one expression, every use of the sealed body would parse it anew.
    parsed = docs.withColumn("_sealed", sealed).withColumn("logs", logs)
    return parsed.withColumn("envelope_error", error).drop("_sealed")


def bad_documents(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("envelope_error").isNotNull()).select("doc_id", F.col("envelope_error").alias("error"))


def explode_entries(parsed: DataFrame, keep: list[str] | None = None, outer: bool = False) -> DataFrame:
    """(doc_id, entry_index, v [, keep...]) for every entry of every good document.

    With ``outer`` a refused or empty document still yields one row with a
    NULL ``entry_index``, so per-document outcomes can come from the same rows.
    """
    keep = keep or []
    # The plain form would first filter on the array, and so parse every document a second time.
    out = parsed.select("doc_id", *keep, F.posexplode_outer("logs").alias("entry_index", "v"))
    return out if outer else out.where("entry_index IS NOT NULL")
