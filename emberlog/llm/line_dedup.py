"""Operator 4, line dedup: explode normalised lines, hash, find hashes of several documents, drop, reassemble by position.

Line texts never travel: a line is two 64-bit hashes of its key and its place. Repeated keys
are found by an aggregate that combines before the shuffle; the table of repeated keys is
written, so the join that marks the lines is one adaptive execution may split at a hot line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, free_names, materialize, require, without

# Fixed value: the white space stripped from a line's ends.
STRIPPED = " \t\n\x0b\x0c\r"
ADDED = ("kept_text", "n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(STRIPPED)))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                        min_docs: int = 2) -> DataFrame:
    """Add kept_text, n_lines (before dropping) and n_dropped to every row.

    A line's key is the line stripped at both ends and lower-cased in A-Z. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents lose all their lines except in the smallest id
    holding them. Null or empty text: one empty line, kept_text ''. Rows with the same id are one
    document, and each row is cut on its own; a null id is one more document, after all others. Lines
    repeated within the owning document stay. A text is cut whole, however long; only the places of its dropped
    lines are gathered for it. Empty tables give empty results; other columns stay whatever their names, and
    input columns named like an added one are replaced (the id and text columns may not be).
    """
    require(docs, id_col, text_col)
    if {id_col.lower(), text_col.lower()} & set(ADDED):
        raise ValueError(f"the id and text columns may not be named like one of {ADDED}")
    docs = without(docs, ADDED)
    own_id, own_hash, own_gone, own_lines, own_text_hash = free_names(docs, "__id", "__th", "__gone", "__lines", "__hash")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = (
        docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
        .select("id", "th", "pos", F.btrim("line", F.lit(STRIPPED)).alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("id", "th", "pos", ascii_lower(F.col("line")).alias("key"))
        .select("id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(min_chars), "key").alias("h2"))
    )
    if min_docs == 2:
        # Two different documents: the smallest and largest id differ, or one of several has no id.
        keys = lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("most"),
                                             F.max(F.col("id").isNull()).alias("no_id"))
        keys = keys.where((F.col("owner") != F.col("most")) | (F.col("owner").isNotNull() & F.col("no_id")))
    else:
        keys = lines.groupBy("h1", "h2").agg(
            F.min("id").alias("owner"), F.max(F.col("id").isNull()).alias("no_id"),
            F.count_distinct("id").alias("n"))
        keys = keys.where(F.col("n") + F.col("no_id").cast("int") >= min_docs)
    keys = materialize(keys.select("h1", "h2", "owner"), "repeated-lines")
    dropped = (
        lines.join(keys, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("owner")))
        .groupBy("id", "th").agg(F.collect_set("pos").alias(own_gone))
        .withColumnsRenamed({"id": own_id, "th": own_hash})
    )
    rows = docs.withColumn(own_text_hash, F.xxhash64(text))
    rows = rows.join(dropped, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(own_text_hash) == F.col(own_hash)), "left")
    rows = rows.withColumn(own_lines, F.split(text, "\n", -1))
    n = F.size(own_lines)
    # Positions to keep by a hash set, then their lines in order.
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(1), n), F.transform(own_gone, lambda p: p + 1)),
                                    lambda i: F.element_at(own_lines, i)), "\n")
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.when(F.col(own_gone).isNull(), text).otherwise(kept).alias("kept_text"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size(own_gone), F.lit(0)).cast("long").alias("n_dropped"),
    )
