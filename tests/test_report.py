"""Nearest-rank percentiles against brute force, with one hot group and ties."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberlog.operators import report
from emberlog.operators.listing import page_index
from emberlog.operators.ranking import with_rank
from emberlog.operators.report import load_summary, percentiles
from emberlog.spec import LogFilter


def brute(values, p):
    s = sorted(values)
    return s[min(len(s) - 1, math.floor(p / 100 * len(s)))]


def test_percentiles_match_brute_force(spark):
    rnd = random.Random(3)
    rows = [("hot", float(rnd.randint(0, 50))) for _ in range(900)]
    rows += [(g, rnd.random() * 100) for g in ("a", "b", "c") for _ in range(rnd.randint(1, 300))]
    rows += [("one", 7.0)] + [(None, float(k % 7)) for k in range(40)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r["g"]: r for r in percentiles(df, "v", ["g"], (50, 95, 99)).collect()}
    for g in {r[0] for r in rows}:  # includes the NULL group
        vals = [v for gg, v in rows if gg == g]
        assert got[g]["n"] == len(vals)
        for p in (50, 95, 99):
            assert got[g][f"p{p}"] == brute(vals, p), (g, p)


def test_rank_is_dense_and_global(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("x"))
    ranked = with_rank(df, ["-x"], rank_col="r").collect()
    assert sorted(r["r"] for r in ranked) == list(range(1000))
    assert all(r["r"] == 999 - r["x"] for r in ranked)


def test_load_summary(spark):
    rec = spark.createDataFrame(
        [("s1", 2, 1, "accepted"), ("s1", 0, 0, "bad_batch"), ("s2", 0, 3, "refused")],
        "svc string, accepted long, rejected long, status string",
    )
    got = {r["svc"]: r for r in load_summary(rec, "svc").collect()}
    assert (got["s1"]["sent"], got["s1"]["accepted"], got["s1"]["docs_bad"]) == (2, 2, 1)
    assert abs(got["s1"]["accept_ratio"] - 2 / 3) < 1e-12
    assert got["s2"]["accept_ratio"] == 0.0


def test_hot_group_is_split_across_tasks(spark):
    """A group holding a third of the rows is ranked by many tasks, not one."""
    hot = spark.range(0, 30000).select(F.lit("hot").alias("g"), (F.col("id") % 977).cast("double").alias("v"))
    cold = spark.range(0, 60000).select((F.col("id") % 50).cast("string").alias("g"), F.rand(1).alias("v"))
    df = hot.unionByName(cold)
    ranked = with_rank(df, ["v"], ["g"], rank_col="r", total_col="n", num_partitions=8)
    parts = ranked.where(F.col("g") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts >= 3
    got = ranked.where(F.col("g") == "hot").agg(F.min("r"), F.max("r"), F.countDistinct("r"), F.max("n")).first()
    assert tuple(got) == (0, 29999, 30000, 30000)


@pytest.fixture()
def no_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    yield
    spark.conf.unset("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rank_with_payload_and_without_exchange_reuse(spark, no_exchange_reuse):
    """Counts and rows read one layout, whatever the plan reuses."""
    rows = spark.range(0, 400_000).select((F.col("id") * 7919 % 400_000).alias("x"), F.repeat(F.lit("p"), 30).alias("payload"),
                                          F.when(F.col("id") % 3 > 0, F.concat(F.lit("g"), F.col("id") % 5)).alias("g"))
    wrong = F.count_if(F.col("r") != 399_999 - F.col("x"))
    got = with_rank(rows, ["-x"], rank_col="r").agg(wrong, F.countDistinct("r"), F.max("r"), F.count("payload")).first()
    assert tuple(got) == (0, 400_000, 399_999, 400_000)
    got = with_rank(rows, ["x"], ["g"], rank_col="r", total_col="n")
    sizes = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    for r in got.groupBy("g").agg(F.countDistinct("r").alias("d"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("n").alias("n")).collect():
        assert (r["d"], r["lo"], r["hi"], r["n"]) == (sizes[r["g"]], 0, sizes[r["g"]] - 1, sizes[r["g"]])


def test_rank_against_brute_force(spark):
    rnd = random.Random(11)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, "", "ä", "z" * 40, "it's"]), rnd.randint(-3, 3), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, s string, w long, k long")
    got = with_rank(df, ["s", "-w", "k"], ["g"], rank_col="r", total_col="n", num_partitions=7).collect()
    for g in ("a", "b", None):
        ours = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, (r[1] or "").encode(), -r[2], r[3]))
        assert [r["k"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["r"])] == [r[3] for r in ours]
        assert {r["n"] for r in got if r["g"] == g} == {len(ours)}
    assert with_rank(df.limit(0), ["k"]).count() == 0


def test_rank_of_weights_and_of_one_repeated_key(spark):
    df = spark.range(0, 60_000).select("id", (F.col("id") % 4).alias("w"), F.lit(1).alias("same"))
    got = with_rank(df, ["id"], rank_col="start", weight_col="w", num_partitions=6)
    assert got.where(F.col("start") != 6 * F.floor(F.col("id") / 4) + F.element_at(F.array(*map(F.lit, (0, 0, 1, 3))), (F.col("id") % 4 + 1).cast("int"))).count() == 0
    # Rows of one key are dealt over all slices that begin with it.
    ties = with_rank(df, ["same"], rank_col="r", num_partitions=6)
    assert tuple(ties.agg(F.countDistinct("r"), F.max("r")).first()) == (60_000, 59_999)
    assert ties.groupBy(F.spark_partition_id()).count().count() >= 3


def test_rank_needs_an_order_it_can_turn_round(spark):
    with pytest.raises(ValueError, match="cannot rank s downwards"):
        with_rank(spark.createDataFrame([("a",)], "s string"), ["-s"])


def test_pages_without_exchange_reuse(spark, no_exchange_reuse):
    logs = spark.range(0, 80_000).select("id", F.timestamp_seconds(F.col("id") % 977 + 1_700_000_000).alias("ts"))
    pages = page_index(logs, LogFilter(), 100).collect()
    assert sorted(p["page_no"] for p in pages) == list(range(800)) and {p["n_rows"] for p in pages} == {100}


@pytest.mark.parametrize("rows_sorted", [0, 100])
def test_selection_of_skewed_values(spark, monkeypatch, rows_sorted):
    """A hot group, a narrow peak beside far values, infinities, NaN and whole numbers that doubles cannot hold."""
    monkeypatch.setattr(report, "SORTED_ROWS", rows_sorted)
    monkeypatch.setattr(report, "BINS", 256)
    rnd = random.Random(5)
    rows = [("hot", 5.0) for _ in range(700)] + [("hot", rnd.gauss(5, 1e-9)) for _ in range(900)]
    rows += [("far", x) for x in (1e308, -1e308, 5e-324, 0.0, float("inf"), float("-inf"), float("nan"))]
    rows += [("far", rnd.random() * 10.0 ** rnd.randint(-300, 300)) for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in percentiles(df, "v", ["g"], (0, 50, 95, 99, 100)).collect()}
    for g in ("hot", "far"):
        vals = sorted((v for gg, v in rows if gg == g), key=lambda v: (v != v, v))
        for p in (0, 50, 95, 99, 100):
            want = vals[min(len(vals) - 1, math.floor(p / 100 * len(vals)))]
            assert got[g][f"p{p}"] == want or (want != want and got[g][f"p{p}"] != got[g][f"p{p}"]), (g, p)
    whole = [rnd.choice([-2**63, 2**63 - 1, 2**62 + rnd.randint(0, 9), rnd.randint(-5, 5)]) for _ in range(400)]
    row = percentiles(spark.createDataFrame([(v,) for v in whole], "v long"), "v", [], (1, 40, 60, 90)).first()
    assert [row[f"p{p}"] for p in (1, 40, 60, 90)] == [brute(whole, p) for p in (1, 40, 60, 90)]


def test_percentiles_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "g string, v double")
    assert percentiles(df, "v", ["g"]).collect() == []


def test_load_summary_with_window_and_latencies(spark):
    rows = [("s1", 2, 1, "accepted", "2026-07-20 10:00:00", 5.0), ("s1", 1, 0, "accepted", "2026-07-20 10:00:04", 9.0), ("s1", 0, 0, "bad_batch", "2026-07-20 10:00:01", None),
            (None, 0, 3, "refused", "2026-07-20 10:00:00", None)]
    rec = spark.createDataFrame(rows, "svc string, accepted long, rejected long, status string, t string, ms double").withColumn("t", F.to_timestamp("t"))
    got = {r["svc"]: r for r in load_summary(rec, "svc", "t", "ms").collect()}
    assert (got["s1"]["window_s"], got["s1"]["accepted_per_s"], got["s1"]["p50"], got["s1"]["p99"]) == (4.0, 0.75, 9.0, 9.0)
    assert (got[None]["window_s"], got[None]["accepted_per_s"], got[None]["p50"]) == (0.0, None, 0.0)
    assert got["s1"]["docs_bad"] == 1 and got[None]["docs_refused"] == 1
