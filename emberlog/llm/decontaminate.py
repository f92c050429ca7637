"""Operator 2, benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words; every k-gram of words gets a hash, and of each run of w successive
k-grams the smallest hash is kept as a fingerprint. Two texts that share k + w - 1 words in
a row keep the same fingerprint inside them, so with k + w - 1 = 13 no shared window is
missed. Fingerprints of documents and items are joined; each hit is extended to both sides
by comparing the words themselves, which also removes hash collisions. Items shorter than a
window are one window, found by the hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, materialize, require

# Fixed value: what is no word after A-Z has been lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
GRAM = 6
# Benchmarks of at most so many words are broadcast (some 50 MB of fingerprints); larger ones are shuffled.
BROADCAST_WORDS = 400_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _span(n: Column) -> Column:
    """0 .. n - 1, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _gram(words: str, i: Column, k: int) -> Column:
    """Hash of k words in the upper half, place in the lower: the smallest is the leftmost of equals."""
    h = F.xxhash64(F.slice(words, i + 1, F.lit(k)), F.lit(k))
    return F.shiftleft(h, 32).bitwiseOR(i.cast("long"))


def _all_grams(words: str, n: Column, k: int) -> Column:
    return F.transform(_span(n - k + 1), lambda i: F.struct(F.lit(k).alias("k"), _gram(words, i, k).alias("v")))


def fingerprints(df: DataFrame, words: str, keep: list[str], window: int, gram: int, short: list[int],
                 whole: bool) -> DataFrame:
    """(keep..., k, h, pos) rows: winnowed grams and, for each short length, all grams of that many words
    (``whole``: only of texts of just that length)."""
    n = F.size(words)
    run = window - gram + 1
    df = df.select(*keep, words, F.when(n >= window, F.transform(_span(n - gram + 1), lambda i: _gram(words, i, gram))).alias("__g"))
    picked = F.array_distinct(F.transform(_span(F.size("__g") - run + 1), lambda j: F.array_min(F.slice("__g", j + 1, F.lit(run)))))
    families = [F.when(F.col("__g").isNotNull(), F.transform(picked, lambda v: F.struct(F.lit(gram).alias("k"), v.alias("v"))))]
    for k in short:
        fits = n == k if whole else n >= k
        families.append(F.when(fits, _all_grams(words, n, k)))
    nothing = F.array().cast("array<struct<k:int,v:bigint>>")
    all_ = F.concat(*[F.coalesce(f, nothing) for f in families]) if len(families) > 1 else families[0]
    rows = df.select(*keep, F.explode(all_).alias("f"))
    return rows.select(*keep, F.col("f.k").alias("k"), F.shiftright("f.v", 32).alias("h"),
                       F.col("f.v").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("pos"))


def _item_fingerprints(classes: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """One row per fingerprint of an item class with the words around it."""
    f = fingerprints(classes, "words", ["class"], window, gram, short, whole=True)
    f = f.join(classes.select("class", "words"), "class")
    reach = window - gram
    left = F.when(F.col("k") == gram, F.least("pos", F.lit(reach))).otherwise(F.lit(0))
    whole = F.size("words") < window
    left = F.when(whole, F.lit(0)).otherwise(left)
    return f.select(
        "class", "k", "h", left.alias("g"), F.when(whole, F.size("words")).otherwise(F.lit(window)).alias("need"),
        F.when(whole, F.col("words")).otherwise(F.slice("words", F.col("pos") - left + 1, left + gram + reach)).alias("ctx"),
    )


def _extended(m: Column) -> Column:
    """How far the words around one hit agree: eq[i] for the words of the context that the document reaches."""
    left = F.least(m["g"], m["pos"])
    mine = F.slice("__words", m["pos"] - left + 1, left + F.size(m["ctx"]) - m["g"])
    theirs = F.slice(m["ctx"], m["g"] - left + 1, F.size(m["ctx"]))
    eq = F.zip_with(mine, theirs, lambda a, b: F.coalesce(a == b, F.lit(False)))
    return F.struct((m["pos"] - left).alias("at"), left.alias("g"), m["k"].alias("k"), m["need"].alias("need"),
                    m["class"].alias("class"), eq.alias("eq"))


def _interval(m: Column) -> Column:
    """[s, e) of the agreeing words around the hit, in document positions."""
    places = _span(F.size(m["eq"]))
    wrong = F.filter(places, lambda i: ~F.get(m["eq"], i))
    s = F.coalesce(F.array_max(F.filter(wrong, lambda i: i < m["g"])) + 1, F.lit(0))
    e = F.coalesce(F.array_min(F.filter(wrong, lambda i: i >= m["g"])), F.size(m["eq"]))
    return F.struct((m["at"] + s).alias("s"), (m["at"] + e).alias("e"), m["class"].alias("class"),
                    ((e - m["g"] >= m["k"]) & (e - s >= m["need"])).alias("ok"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                  share: int = 20) -> DataFrame:
    """One row per document row: id, __th (hash of the text), n_words, n_hit (words inside an occurrence of an
    item's window), n_items, items_sha256 (those ids sorted as strings, comma-joined) and contaminated
    (n_hit > 0 and share * n_hit >= n_words).

    Null or empty texts have no words and no hits; items without words match nothing; items without an id
    mark words but are not counted. Items with the same words are searched once. Repeated document rows give
    a row each; rows with a null id are kept. Empty documents or an empty benchmark give empty or clean
    results. Other columns are not read. Positions are 32-bit: texts of up to 2**31 words.
    """
    require(docs, id_col, text_col)
    require(benchmark, item_col, item_text_col)
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    classes = (
        benchmark.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(item_text_col)).alias("words"))
        .where(F.size("words") > 0)
        .groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("class", F.xxhash64("words"))
    )
    # Bounded: one row, with at most window - 1 lengths.
    seen = classes.agg(F.sum(F.size("words")).alias("n"), F.collect_set(F.when(F.size("words") < window, F.size("words"))).alias("short")).first()
    short = sorted(seen["short"])
    marks = _item_fingerprints(classes, window, gram, short)
    if (seen["n"] or 0) <= BROADCAST_WORDS:
        marks = F.broadcast(marks)
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    prints = fingerprints(keyed.select("id", "th", words_of(F.col("text")).alias("words")), "words", ["id", "th"],
                          window, gram, short, whole=False)
    hits = (
        prints.join(marks, ["k", "h"])
        .groupBy("id", "th").agg(F.collect_set(F.struct("pos", "k", "g", "need", "class", "ctx")).alias("__m"))
        .withColumnsRenamed({"id": "__id", "th": "__h"})
    )
    rows = keyed.join(hits, keyed["id"].eqNullSafe(hits["__id"]) & (keyed["th"] == hits["__h"]), "left")
    rows = rows.select("id", "th", "__m", words_of(F.col("text")).alias("__words"))
    rows = rows.select("id", "th", F.size("__words").cast("long").alias("n_words"),
                       F.filter(F.transform(F.transform("__m", _extended), _interval), lambda x: x["ok"]).alias("__x"))
    first = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        F.array_sort(F.array_distinct(F.transform("__x", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))), first,
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"),
                              (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")),
        lambda a: a["n"])
    rows = rows.select(
        "id", "th", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform("__x", lambda x: x["class"]))), F.array().cast("array<bigint>")).alias("found"))
    rows = materialize(rows, "contamination")
    # Item ids by distinct set of classes, so a passage that many documents share is resolved once.
    sets = rows.where(F.size("found") > 0).select("found").distinct()
    ids = (
        sets.select("found", F.explode("found").alias("class")).join(classes.select("class", "items"), "class")
        .select("found", F.explode("items").alias("item")).groupBy("found")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    # Rows without hits have no key to meet at; the ids are written, so a frequent set of classes may be split.
    ids = materialize(ids, "item-ids")
    none = rows.where(F.size("found") == 0).withColumn("items", F.array().cast("array<string>"))
    rows = rows.where(F.size("found") > 0).join(ids, "found", "left").unionByName(none)
    listed = F.coalesce(F.array_join("items", ","), F.lit(""))
    return rows.select(
        F.col("id").alias(id_col), F.col("th").alias("__th"), "n_words", "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, id_col, text_col, **options).where("contaminated")
    bad = materialize(bad.select(F.col(id_col).alias("__id"), "__th").distinct(), "contaminated")
    th = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"]) & (th == bad["__th"]), "left_anti")
