"""Operator 5, exact top-k over binary codes by incremental multi-index hashing.

A vector's signs are its code, cut into segments of 16 bits. A code within distance
m * (r + 1) - 1 of a query has one of its m segments within r of the query's, so after all
segments have been searched up to radius r, every such code has been verified. The radius grows
from 0 until the kth verified distance is covered.

The distinct codes are dealt into parts, the stated query set into blocks, both of bounded size. A task
meets one block and one part, builds the part's index and returns the part's exact k best codes of
each query; the k best of all parts are the answer. Only counts reach the driver.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import materialize, require

SEGMENT = 16
# Distinct query codes of a block and distinct codes of a part: what one task holds.
QUERY_BLOCK = 100_000
INDEX_CODES = 1_000_000
_ONES = np.array([bin(i).count("1") for i in range(1 << 8)], dtype=np.uint8)


def popcount(x: np.ndarray) -> np.ndarray:
    """Set bits of uint16 values."""
    return _ONES[x & 0xFF] + _ONES[x >> 8]


@functools.lru_cache(maxsize=None)
def masks(radius: int) -> np.ndarray:
    """All 16-bit values with ``radius`` bits set."""
    return np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(SEGMENT), radius)], dtype=np.uint16)


def codes_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dims (the vector's length) and code (array<int> of 16-bit segments; a bit is set where the value is positive)."""
    segment = lambda s: F.aggregate(
        F.slice("v", s * SEGMENT + 1, F.lit(SEGMENT)), F.lit(0), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))
    last = F.ceil(F.size("v") / SEGMENT).cast("int") - 1
    return rows.select("id", F.size("v").alias("dims"), F.transform(F.sequence(F.lit(0), last), segment).alias("code"))


class SegmentIndex:
    """Codes of one task, findable by the value of each segment; of equal distances the lower row is the better."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, s], kind="stable") for s in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, s], np.arange((1 << SEGMENT) + 1)) for s, o in enumerate(self.order)]

    def at(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows with some segment at just this distance."""
        wanted = masks(radius)
        if len(self.codes) <= len(wanted):
            return np.flatnonzero((popcount(self.codes ^ query) == radius).any(axis=1))
        found = []
        for s in range(self.codes.shape[1]):
            keys = (wanted ^ query[s]).astype(np.int64)
            lo, hi = self.starts[s][keys], self.starts[s][keys + 1]
            full = hi > lo
            lo, n = lo[full], (hi - lo)[full]
            if len(n):
                ends = np.cumsum(n)
                found.append(self.order[s][np.arange(ends[-1]) + np.repeat(lo - (ends - n), n)])
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of the k best: the radius grows until the kth distance is covered."""
        rows = np.zeros(0, dtype=np.int64)
        for radius in range(SEGMENT + 1):
            rows = np.unique(np.concatenate([rows, self.at(query, radius)]))
            d = popcount(self.codes[rows] ^ query).sum(axis=1, dtype=np.int64)
            # What is not among the k best so far never will be.
            best = np.argsort(d, kind="stable")[:k]
            rows, d = rows[best], d[best]
            if len(rows) == len(self.codes) or len(rows) == k and d[-1] < self.codes.shape[1] * (radius + 1):
                break
        return rows, d


def top_k(df: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, neighbor_id, distance): for every row of ``queries`` the k rows of ``df`` of smallest
    Hamming distance between sign codes, ties by smaller id; all rows count, a query's own row too.

    Ids may be of any type with an order. Vectors may be of any length; a query is compared with the vectors of its own
    length. Rows without an id, or whose vector is null or empty, have no code: they are not found and get no answer.
    Null values give bit 0, NaN bit 1 (Spark orders it above all numbers). Rows that repeat an id and code count once. Where there are fewer than k rows all are
    given; empty tables give an empty result. Other columns are not read.
    """
    require(df, id_col, vector_col)
    require(queries, id_col, vector_col)
    # Repeated rows are merged first. Of each code only its k smallest ids can be answers; the limit applies before the shuffle too.
    ids = codes_of(df, id_col, vector_col).distinct()
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("dims", "code").orderBy("id"))).where(F.col("r") <= k)
    index = materialize(ids.groupBy("dims", "code").agg(F.array_sort(F.collect_set("id")).alias("ids")), "codes")
    asked = materialize(codes_of(queries, id_col, vector_col).distinct(), "queries")
    wanted = materialize(asked.select("dims", "code").distinct(), "query-codes")
    parts = max(1, -(-index.count() // INDEX_CODES))
    # Blocks of a bounded size, and enough of them for every core.
    blocks = max(1, -(-wanted.count() // QUERY_BLOCK), -(-2 * df.sparkSession.sparkContext.defaultParallelism // parts))
    place = ["dims", "block", "part"]
    dealt = lambda rows, n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select("dims", every(blocks).alias("block"), dealt(index, parts).alias("part"), "code", "ids")
    right = wanted.select("dims", dealt(wanted, blocks).alias("block"), every(parts).alias("part"), "code")
    # A number of its own: adaptive execution would merge these small but laborious partitions.
    left, right = (rows.repartition(2 * blocks * parts, *place).groupBy(*place) for rows in (left, right))
    id_type = asked.schema["id"].dataType.simpleString()
    found = left.cogroup(right).applyInArrow(
        functools.partial(_search, k), f"dims int, code array<int>, found array<struct<distance: int, ids: array<{id_type}>>>")
    found = found.select("dims", "code", F.explode("found").alias("f")).select("dims", "code", "f.distance", F.explode("f.ids").alias("id"))
    order = Window.partitionBy("dims", "code").orderBy("distance", "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumnRenamed("id", "neighbor_id")
    return asked.join(best, ["dims", "code"]).select(F.col("id").alias("query_id"), "rank", "neighbor_id", "distance")


def _search(k: int, index: pa.Table, wanted: pa.Table) -> pa.Table:
    """dims, code and the k best codes (distance, ids) of every wanted code, among those of one part."""
    kind = index.schema.field("ids").type
    if not index.num_rows or not wanted.num_rows:
        return pa.table({"dims": pa.array([], pa.int32()), "code": pa.array([], pa.list_(pa.int32())),
                         "found": pa.array([], pa.list_(pa.struct([("distance", pa.int32()), ("ids", kind)])))})
    segments = -(-index.column("dims")[0].as_py() // SEGMENT)
    matrix = lambda t: t.column("code").combine_chunks().flatten().to_numpy().astype(np.uint16).reshape(-1, segments)
    # Rows in order of their smallest ids: the lower row wins a tie.
    ids = index.column("ids").combine_chunks()
    order = pc.sort_indices(ids.values.take(ids.offsets[:-1]))
    found = SegmentIndex(matrix(index)[order.to_numpy()])
    rows, distances = zip(*(found.nearest(query, k) for query in matrix(wanted)), strict=True)
    offsets = np.cumsum([0, *map(len, rows)])
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(distances).astype(np.int32)), ids.take(order).take(pa.array(np.concatenate(rows)))],
                                       names=["distance", "ids"])
    return pa.table({"dims": wanted.column("dims"), "code": wanted.column("code"),
                     "found": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)})
