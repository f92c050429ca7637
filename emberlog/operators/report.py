"""Measurement reports: exact nearest-rank percentiles, load summary, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.written import written

DEFAULT_PERCENTILES = (50, 95, 99)
# Bins that one pass cuts a range of values into, and rows of a bin that one task sorts at most.
BINS = 4096
SORTED_ROWS = 500_000


def _bin(v: Column, low: Column, high: Column, kind: T.DataType) -> Column:
    """0 to BINS from ``low`` to ``high``, never falling as the value grows: the upper half of the bins are equal parts
    of the range, the lower half divide its first part by orders of magnitude. Only ``high`` is in the last bin, so a bin
    is always narrower than its range; an infinity or NaN has a bin of its own."""
    if isinstance(kind, T.IntegralType):
        gap = lambda a, b: F.coalesce(F.try_subtract(a.cast("bigint"), b.cast("bigint")).cast("double"),
                                      a.cast("double") - b.cast("double"))
    else:
        gap = lambda a, b: a.cast("double") / 2 - b.cast("double") / 2
    share, half = F.try_divide(gap(v, low), gap(high, low)), BINS // 2
    inner = F.when(share * half >= 1, half + F.least(F.floor(share * (half - 1)), F.lit(half - 1))).when(
        share > 0, 1 + F.floor((F.log2(share) + 1100) / 1100 * (half - 2))).otherwise(1)
    out = F.when(v <= low, 0).when(v >= high, BINS).otherwise(inner).cast("int")
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        return out
    return F.when(F.isnan(v), BINS + 2).when(v == float("inf"), BINS + 1).when(v == float("-inf"), -1).otherwise(out)


def _histogram(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """Per range (_g, _lo, _hi) and bin: rows in it and before it, smallest and largest value. Counted before the shuffle."""
    bins = rows.withColumn("_bin", _bin(F.col("_v"), F.col("_lo"), F.col("_hi"), kind))
    bins = bins.groupBy("_g", "_lo", "_hi", "_bin").agg(F.count("*").alias("c"), F.min("_v").alias("mn"), F.max("_v").alias("mx"))
    earlier = Window.partitionBy("_g", "_lo", "_hi").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return written(bins, "percentile-bins").withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))


def percentiles(df: DataFrame, value_col: str, group_cols: list[str], pcts=DEFAULT_PERCENTILES) -> DataFrame:
    """Nearest-rank percentile per group: the value at 0-based rank
    ``min(n - 1, floor(p / 100 * n))`` in ascending order (exact, no interpolation; NaN is the largest).

    Selection without a full sort: a histogram of each group finds the bins that hold the wanted ranks; only their rows
    are looked at again, and only they are shuffled and sorted. A bin of more than SORTED_ROWS rows is first cut into
    bins itself, so a hot group or a narrow peak never meets in one task; many rows of one value are one bin.
    """
    kind = df.schema[value_col].dataType
    if not isinstance(kind, T.NumericType):
        raise ValueError(f"percentiles need numbers; {value_col} is {kind.simpleString()}")
    group = F.struct(*[F.col(f"`{g}`") for g in group_cols]) if group_cols else F.struct(F.lit(0).alias("all"))
    base = df.select(group.alias("_g"), F.col(f"`{value_col}`").alias("_v")).where("_v IS NOT NULL")
    number = F.when(F.abs(F.col("_v").cast("double")) < float("inf"), F.col("_v"))
    low, high = base.agg(F.min(number), F.max(number)).first()
    edge = lambda x: F.lit(0 if x is None else x).cast(kind)

    bins = _histogram(base.withColumn("_lo", edge(low)).withColumn("_hi", edge(high)), kind)
    bins = bins.withColumn("n", F.sum("c").over(Window.partitionBy("_g")))
    ranks = F.array(*[F.struct(F.lit(i).alias("p"), F.least(F.col("n") - 1, F.floor(F.lit(p / 100.0) * F.col("n"))).alias("t"))
                      for i, p in enumerate(pcts)])
    here = F.filter(ranks, lambda x: (x["t"] >= F.col("before")) & (x["t"] < F.col("before") + F.col("c")))
    found = bins.select("_g", "n", "mn", "mx", "c", "before", F.explode(here).alias("x")).select(
        "_g", "n", F.col("x.p").alias("p"), (F.col("x.t") - F.col("before")).alias("r"), F.col("mn").alias("_lo"), F.col("mx").alias("_hi"), "c")
    while True:
        # One row for each group and percentile.
        found = written(found, "percentile-ranges")
        wide = found.where("_lo < _hi")
        worst = wide.agg(F.max("c")).first()[0]
        known = found.where("NOT _lo < _hi").withColumn("value", F.col("_lo"))
        if worst is None:
            break
        rows = base.join(wide.select("_g", "_lo", "_hi").distinct(), "_g").where("_v >= _lo AND _v <= _hi")
        if worst <= SORTED_ROWS:
            place = F.row_number().over(Window.partitionBy("_g", "_lo", "_hi").orderBy("_v")) - 1
            hits = rows.withColumn("r", place.cast("bigint")).join(wide, ["_g", "_lo", "_hi", "r"])
            known = known.unionByName(hits.withColumn("value", F.col("_v")).select(known.columns))
            break
        inside = _histogram(rows, kind).join(wide.drop("c"), ["_g", "_lo", "_hi"]).where("r >= before AND r < before + c")
        inside = inside.select("_g", "n", "p", (F.col("r") - F.col("before")).alias("r"), F.col("mn").alias("_lo"), F.col("mx").alias("_hi"), "c")
        found = known.drop("value").unionByName(inside)
    at = [F.max(F.when(F.col("p") == i, F.col("value"))).alias(f"p{p}") for i, p in enumerate(pcts)]
    out = known.groupBy("_g").agg(F.max("n").alias("n"), *at)
    return out.select(*[F.col(f"_g.`{g}`").alias(g) for g in group_cols], "n", *[f"p{p}" for p in pcts])


def load_summary(receipts: DataFrame, label_col: str, time_col: str | None = None, latency_col: str | None = None,
                 pcts=DEFAULT_PERCENTILES) -> DataFrame:
    """Per label: documents sent, entries accepted and rejected, document
    outcomes by status, and the accepted share of all entries.

    With ``time_col`` (arrival of each document) also the window from the first to the last arrival in seconds and the
    accepted entries per second of it (null for a window of no length); with ``latency_col`` the nearest-rank
    percentiles of the latencies, 0 where a label has none.
    """
    window = [F.min(time_col).alias("_first"), F.max(time_col).alias("_last")] if time_col else []
    out = receipts.groupBy(label_col).agg(
        F.count(F.lit(1)).alias("sent"),
        F.sum("accepted").alias("accepted"),
        F.sum("rejected").alias("rejected"),
        F.count_if(F.col("status") == "accepted").alias("docs_accepted"),
        F.count_if(F.col("status") == "refused").alias("docs_refused"),
        F.count_if(F.col("status") == "bad_batch").alias("docs_bad"),
        *window,
    ).withColumn(
        "accept_ratio",
        F.when((F.col("accepted") + F.col("rejected")) > 0,
               F.col("accepted").cast("double") / (F.col("accepted") + F.col("rejected")).cast("double")),
    )
    if time_col:
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        out = out.withColumn("window_s", (micros("_last") - micros("_first")) / 1_000_000).drop("_first", "_last")
        out = out.withColumn("accepted_per_s", F.try_divide(F.col("accepted").cast("double"), "window_s"))
    if latency_col:
        late = percentiles(receipts, latency_col, [label_col], pcts).drop("n").withColumn("_label", F.struct(label_col)).drop(label_col)
        out = out.withColumn("_label", F.struct(label_col)).join(late, "_label", "left").drop("_label")
        out = out.na.fill(0, [f"p{p}" for p in pcts])
    return out


def reconcile(receipts: DataFrame, visible_logs: DataFrame) -> DataFrame:
    """Per batch: receipts' accepted total vs rows visible, full outer join."""
    acc = receipts.groupBy("batch_id").agg(F.sum("accepted").alias("accepted"))
    vis = visible_logs.groupBy("batch_id").agg(F.count(F.lit(1)).alias("visible"))
    j = acc.join(vis, "batch_id", "full_outer")
    return j.select(
        "batch_id",
        F.coalesce("accepted", F.lit(0)).alias("accepted"),
        F.coalesce("visible", F.lit(0)).alias("visible"),
    ).withColumn("consistent", F.col("accepted") == F.col("visible"))
