"""Exact rank of every row inside its group without a single-partition window.

The rows are written once. A sample of the written keys (group, order) gives splitters, which enter
the plan as a literal array; a binary search over them numbers each row's bucket. The buckets are
slices of the global order, so a group holding a third of the table is spread over many of them, and
rows of one key that fills several slices are dealt over all of these. Row counts per (bucket, group)
and the rows themselves read the same written table and the same literal splitters: no exchange has
to be reused, and nothing is sampled twice. A row's rank is its group's count in earlier buckets plus
its place in its own bucket.

The sample decides only how even the buckets are, never a rank.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.written import written

# Splitters that one plan holds at most, rows of a bucket at least, and sampled keys per bucket.
MAX_BUCKETS = 16_384
ROWS_PER_BUCKET = 2_000
SAMPLED_PER_BUCKET = 20
# Buckets for each task that reads them: they are dealt by hash, so a few for each even the tasks out.
BUCKETS_PER_TASK = 4

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def sort_key(df: DataFrame, order: list[str]) -> Column:
    """The columns of ``order`` as one struct that sorts ascending; a leading ``-`` turns a column round.

    Nulls come first, in a column turned round last. Times count as microseconds, dates as days.
    """
    parts = []
    for i, name in enumerate(order):
        down, name = name.startswith("-"), name.removeprefix("-")
        kind, x = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            x, kind = F.unix_micros(x.cast("timestamp")), T.LongType()
        elif isinstance(kind, T.DateType):
            x, kind = F.unix_date(x), T.IntegerType()
        if down:
            if not isinstance(kind, _INTEGRAL):
                raise ValueError(f"cannot rank {name} downwards: {kind.simpleString()}")
            parts.append(x.isNull().alias(f"n{i}"))
            x = F.bitwise_not(x)
        parts.append(x.alias(f"k{i}"))
    return F.struct(*parts)


def _literal(value, kind: T.DataType) -> str:
    if isinstance(kind, T.StructType):
        return "named_struct(" + ", ".join(f"'{f.name}', {_literal(value[f.name], f.dataType)}" for f in kind) + ")"
    if value is None:
        return f"cast(null as {kind.simpleString()})"
    if isinstance(value, (bytes, bytearray)):
        return f"unhex('{value.hex()}')"
    if isinstance(value, str):
        return f"decode(unbase64('{base64.b64encode(value.encode()).decode()}'), 'UTF-8')"
    return f"cast('{value}' as {kind.simpleString()})"


def splitters(table: DataFrame, key: Column, rows: int, num_buckets: int) -> list:
    """At most ``num_buckets`` - 1 keys of about equal distance in the order, from a sample of the keys.

    The sample is bounded by SAMPLED_PER_BUCKET keys for each bucket; only the chosen keys reach the driver.
    """
    if num_buckets < 2:
        return []
    want = num_buckets * SAMPLED_PER_BUCKET
    sample = table.select(key.alias("k"))
    if rows > want:
        sample = sample.sample(min(1.0, 1.2 * want / rows), seed=7)
    ranked = sample.select("k", F.row_number().over(Window.orderBy("k")).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    step = F.greatest(F.col("n") / num_buckets, F.lit(1.0))
    cut = ranked.where((F.floor(F.col("r") / step) != F.floor((F.col("r") - 1) / step)) & (F.col("r") < F.col("n")))
    return [r["k"] for r in cut.orderBy("r").select("k").collect()]


def bucketed(table: DataFrame, cuts: list, kind: T.DataType) -> DataFrame:
    """Add ``_bucket``, the number of the slice of the order that holds ``_key``. A key that several slices begin
    with may go to any of them; ``_salt`` chooses."""
    if not cuts:
        return table.withColumn("_bucket", F.lit(0))
    slices = F.expr("array(" + ", ".join(_literal(c, kind) for c in cuts) + ")")
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def passed(cut_passes) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when(cut_passes(F.get(slices, at + s - 1)), at + s).otherwise(at))

    table = table.withColumn("_lo", passed(lambda c: c < F.col("_key")))
    high = F.when(F.get(slices, F.col("_lo")) == F.col("_key"), passed(lambda c: c <= F.col("_key"))).otherwise(F.col("_lo"))
    table = table.withColumn("_hi", high)
    return table.withColumn("_bucket", (F.col("_lo") + F.pmod("_salt", F.col("_hi") - F.col("_lo") + 1)).cast("int"))


def with_rank(df: DataFrame, order: list[str], group_cols: list[str] | None = None, rank_col: str = "rank",
              total_col: str | None = None, num_partitions: int | None = None, weight_col: str | None = None,
              is_written: bool = False) -> DataFrame:
    """Add a 0-based ``rank_col`` by ``order`` (column names, ``-`` before one that goes down) within
    ``group_cols``, and the group's size as ``total_col`` when given.

    With ``weight_col`` a row counts that often: its rank is the sum of the weights before it. Rows that tie in
    all of ``order`` get distinct ranks in no defined order. Null groups are one group. A ``df`` that ``is_written`` (a
    selection of columns of a written table) is read as it is; rows of one key are then not dealt over several slices.
    """
    spark = df.sparkSession
    group_cols = list(group_cols or [])
    clash = {"_salt", "_bucket", "_group", "_key", "_off", "_lo", "_hi"} & set(df.columns)
    if clash:
        raise ValueError(f"column names of the rank itself: {sorted(clash)}")
    kept = df.withColumn("_salt", F.lit(0)) if is_written else written(df.withColumn("_salt", F.monotonically_increasing_id()), "rank-rows")
    rows = kept.count()
    most = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = sort_key(kept, group_cols + list(order))
    kind = kept.select(key.alias("k")).schema["k"].dataType
    cuts = splitters(kept, key, rows, min(BUCKETS_PER_TASK * most, MAX_BUCKETS, max(BUCKETS_PER_TASK * (num_partitions or 0), rows // ROWS_PER_BUCKET)))
    group = F.struct(*[F.col(f"`{g}`") for g in group_cols]) if group_cols else F.lit(0)
    dealt = bucketed(kept.withColumn("_key", key), cuts, kind).withColumn("_group", group)

    one = F.col(f"`{weight_col}`") if weight_col else F.lit(1)
    stats = dealt.groupBy("_bucket", "_group").agg(F.sum(one).cast("bigint").alias("_n"))
    w = Window.partitionBy("_group")
    before = F.coalesce(F.sum("_n").over(w.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stats = stats.select("_bucket", "_group", before.alias("_off"),
                         *([F.sum("_n").over(w).alias(total_col)] if total_col else []))
    inside = Window.partitionBy("_bucket", "_group").orderBy("_key")
    place = F.row_number().over(inside) - 1 if not weight_col else F.coalesce(
        F.sum(one).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if num_partitions:
        dealt = dealt.repartition(num_partitions, "_bucket", "_group")
    out = dealt.withColumn(rank_col, place.cast("bigint"))
    if not cuts:
        sizes = [F.sum(one).over(Window.partitionBy("_group")).cast("bigint").alias(total_col)] if total_col else []
        return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in (rank_col, total_col)], rank_col, *sizes)
    # Without groups there is one row per bucket; with groups one for each of them more, and the planner decides by size.
    out = out.join(stats if group_cols else F.broadcast(stats), ["_bucket", "_group"], "left")
    return out.withColumn(rank_col, F.col("_off") + F.col(rank_col)).select(
        *[F.col(f"`{c}`") for c in df.columns if c not in (rank_col, total_col)], rank_col, *([total_col] if total_col else []))
