"""Operator 12, shards by proportional stratified interleaving.

1. Within each source the rows are put in a seeded random order: by the digest of seed and document id.
2. The row at place r of a source of n rows gets the fractional rank (2 r + 1) / (2 n), so every source is spread
   evenly over 0 to 1.
3. All rows are sorted by fractional rank and cut into shards of equal counts. Any stretch of that order holds the
   sources in their proportions (each within a row), so every shard matches the mixture of the whole.

Both orders are exact ranks over written tables (``operators.ranking``): a source, or a document id, that holds
a third of all rows is spread over many tasks. Only ids, sources and the caller's other columns move; texts need not
be among them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import require, without
from emberlog.operators.ranking import with_rank

SHARDS = 16
SEED = 42
LAW = "rows"
_OWN = ("__digest", "__source", "__id", "__place", "__of", "__share", "__rank", "__all")


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source",
               tie_cols: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with law (``rows``: counts of shards differ by one at most), shard (0 to ``shards`` - 1) and slot (the place
    in the shard, from 0 without gaps); columns of these names are replaced, all others stay.

    The result depends on ids, sources, ``seed`` and the number of rows alone, not on files or partitions. Null sources
    are one source and null ids one id. Rows of one source that repeat an id stand together in the order of
    ``tie_cols`` (numbers or texts); rows equal in these too take the places of one another. Equal fractional ranks
    of several sources are ordered by the digest. With fewer rows than shards the last shards stay empty; an empty table gives no
    rows. Texts are not looked at, whatever their length.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    require(docs, id_col, source_col, *tie_cols)
    taken = [c for c in docs.columns if c in _OWN]
    if taken:
        raise ValueError(f"column names of the operator itself: {taken}")
    rows = without(docs, ["law", "shard", "slot"])
    columns = rows.columns
    named = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-"))
    rows = rows.withColumn("__digest", F.md5(F.concat(F.lit(f"{seed}:"), named))).withColumn(
        "__source", F.col(f"`{source_col}`").cast("string"))
    ties = list(tie_cols)
    placed = with_rank(rows, ["__digest", *ties], ["__source"], rank_col="__place", total_col="__of")
    placed = placed.withColumn("__share", (2 * F.col("__place") + 1) / (2 * F.col("__of")))
    ranked = with_rank(placed, ["__share", "__digest", "__source", *ties], rank_col="__rank", total_col="__all")
    # Shard s begins at rank ceil(s * all / shards).
    out = ranked.withColumn("shard", F.expr(f"__rank * {shards} div __all"))
    out = out.withColumn("slot", F.expr(f"__rank - (shard * __all + {shards - 1}) div {shards}"))
    return out.select(*[F.col(f"`{c}`") for c in columns], F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), "slot")


def write_shards(sharded: DataFrame, folder: str, rows_per_file: int = 100_000) -> None:
    """One folder ``shard=N`` for each shard; its files hold ``rows_per_file`` consecutive slots each, in order."""
    piece = F.expr(f"slot div {int(rows_per_file)}")
    cut = sharded.withColumn("piece", piece).repartition("shard", "piece").sortWithinPartitions("shard", "slot")
    cut.write.partitionBy("shard", "piece").parquet(folder)
