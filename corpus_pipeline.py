"""From raw documents to token ids: language, repeated lines, near copies, benchmark passages, encoding.

Every stage works on all that its predecessor kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm import bpe_codec, decontaminate, lang_id, line_dedup, near_dup
from emberlog.llm.common import free_names, materialize, table
from emberlog.llm.queries import vocabulary

# Scores of the language stage (for the mean word of a text): the least for a text without a label, and from where a prediction
# replaces a label. Set on held-out texts: 0.07 % of those with the predicted label are below 0.5, 98 % reach 0.9; 0.08 % of all have
# another label and reach 0.9 (they mix two languages).
LIKELY = 0.5
CERTAIN = 0.9
# Near copies share so much of their word shingles, at least. (85, the contract of op9, binds that query only.)
NEAR_PERCENT = 80


def _aside(docs: DataFrame, added: list[str]) -> DataFrame:
    """``docs`` with columns named like one that an operator adds under free names, in the same order."""
    return docs.toDF(*[free_names(docs, f"{c}__")[0] if c.lower() in added else c for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go; the others get the predicted language in ``lang`` where they have none, or where the
    prediction is as good as certain. An unlabelled text of which no language is more likely than all others together
    goes too, as nothing says what it is. Where no row has a label there is no learned language: all texts with
    letters stay, without a language. A text is judged by a model of the other half of the texts, never by its own label, and a
    label that this model has not learned stays. Null and empty texts go; repeated rows fare alike; ties go to the first language;
    texts of any length count whole; other columns stay as they are."""
    half = F.pmod(F.xxhash64("text"), F.lit(2))  # copies of a text are on one side
    models = [lang_id.train(docs.where(half != side), train_docs=lang_id.TRAIN_DOCS // 2) for side in (0, 1)]
    if not all(m.langs for m in models):  # too few labels for two models
        models = [lang_id.train(docs)] * 2
    if not models[0].langs:
        return docs.where(lang_id.has_letters("text"))
    return _decided(docs, docs.where(half == 0), models[0]).unionByName(_decided(docs, docs.where(half == 1), models[1]))


def _decided(docs: DataFrame, rows: DataFrame, model: lang_id.Model) -> DataFrame:
    """The rows that stay, with the columns of ``docs`` and the language decided by ``model``."""
    rows = _aside(rows, ["lang_pred", "score"])
    found = lang_id.identify(rows, model)
    label = F.col("lang")
    found = found.where((F.col("lang_pred") != lang_id.UNDECIDED) & (label.isNotNull() | (F.col("score") >= LIKELY)))
    decided = F.when(label.isNull() | (label.isin(model.langs) & (F.col("score") >= CERTAIN)), F.col("lang_pred")).otherwise(label)
    return found.select(*[decided.alias("lang") if c == "lang" else F.col(f"`{own}`").alias(c)
                          for c, own in zip(docs.columns, rows.columns, strict=True)])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; documents left without any text go. Rows that repeat an id
    count as one holder of their lines and keep them alike; null texts stay; other columns, whatever their names, stay."""
    rows = _aside(docs, line_dedup.ADDED)
    out = line_dedup.drop_repeated_lines(rows)
    out = out.where((F.col("n_dropped") == 0) | (F.btrim("kept_text", F.lit(line_dedup.STRIPPED)) != ""))
    changed = F.col("n_dropped") > 0
    return out.select(*[
        F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text") if c == "text"
        else F.when(changed, F.char_length("kept_text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars"
        else F.col(f"`{own}`").alias(c) for c, own in zip(docs.columns, rows.columns, strict=True)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of NEAR_PERCENT) stays: the one of the smallest id. Null
    and empty texts are near to nothing and stay; long texts count whole; columns and their names stay."""
    return near_dup.near_duplicates_dropped(docs, percent=NEAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more are benchmark passages go. Null and empty texts have no words and stay, as all
    do beside an empty benchmark; repeated rows fare alike; long texts count whole; columns and their names stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids (little-endian uint32) of every text, and whether they decode to the text
    again (round_trip). A null text counts as an empty one; a row for every row; long texts are encoded whole."""
    out = bpe_codec.encode_texts(docs.select("doc_id", "lang", "source", "text"), vocabulary())
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", same.alias("round_trip"))


STAGES = [
    ("language", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
# BPE and the language model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
