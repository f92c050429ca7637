"""Queries over the driver tables, one per operator, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import (bpe_codec, chat_format, decontaminate, hamming_topk, lang_id, license_scan, line_dedup, merkle,
                          near_dup, sharding, token_count, vector_codes, warc)
from emberlog.llm.common import table
from emberlog.llm.oracle import ORACLES  # noqa: F401

VOCABULARY = "byte_bpe_50k.json"
# A conversation that holds every control string of the template.
PLANTED_TURN = "\\### Assistant: </turn> ok"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(docs, vocabulary()).select("doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_codec.encode_texts(docs, vocabulary(), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return hamming_topk.top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED_TURN), (-7, 1, "assistant", PLANTED_TURN)], rows.schema)
    return chat_format.conversation_digests(chat_format.format_turns(rows.unionByName(planted)))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", lang_id.held_out("doc_id"))
    model = lang_id.train(docs.where("doc_id IS NOT NULL AND NOT held_out"))
    return lang_id.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.groups_of(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(vector_codes.codebooks_digest(books)))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard_rows(docs, tie_cols=("size", "text_crc32")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), fold_text=merkle.tampered())


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_decontamination, op3_bpe, op4_line_dedup, op5_hamming_topk, op6_warc,
                                   op7_chat_format, op8_language, op9_near_duplicates, op10_licenses, op11_vector_codes,
                                   op12_sharding, op13_merkle_manifest)}
