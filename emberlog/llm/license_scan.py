"""Operator 10, license scans by canonical digests, in DataFrame functions only.

A text is lower-cased, loses its copyright lines, gets a single space for any punctuation or white space and one spelling
of equivalent words; its SHA-256 is then looked up among the digests of known licences, normalised by the same
expressions. A whole document is looked up, and each of its lines as a text of its own. Line breaks of the whole text do not
count: spellings are matched after the lines are joined, and only lines that name an owner go, not prose that starts with
"copyright". As a wrapped owner's line has a rest on the next line, the text without the paragraphs that begin with an
owner's line is looked up as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import ascii_lower, require
from emberlog.llm.license_texts import STATEMENTS, TEXTS

# Equivalent spellings of words and of word pairs, and what begins a line that only names an owner.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("calibre", "caliber"), ("cancell", "cancel"), ("capitaliz", "capitalis"),
    ("catalogue", "catalog"), ("centre", "center"), ("emphasise", "emphasize"), ("favour", "favor"), ("fulfill", "fulfil"),
    ("honour", "honor"), ("initialis", "initializ"), ("judgement", "judgment"), ("labell", "label"), ("licence", "license"),
    ("maximis", "maximiz"), ("modell", "model"), ("optimis", "optimiz"), ("organis", "organiz"), ("practise", "practice"),
    ("programme", "program"), ("recognis", "recogniz"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
]
PAIRS = [("copyright owner", "copyright holder"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("sub license", "sublicense")]
OWNER = r"[ \t]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|(?:\(c\)|©)[ \t]*(?:copyright[ \t]*)?[0-9<\[{])"
OWNER_LINE = f"(?m)^{OWNER}[^\\n]*$"
OWNER_START = r"^[ \t\r\n]*" + OWNER
PARAGRAPHS = r"\n[ \t\r\n]*\n"
# Lines end at line feeds alone, in Java too.
UNIX_LINES = "(?d)"
NOT_WORDS = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
# Known texts of at most so many rows are broadcast.
BROADCAST_TEXTS = 100_000


def _spelt(t: Column, spellings: list[tuple[str, str]]) -> Column:
    """Each spelling replaced in turn. A text that lacks one is only searched, which costs much less than a replacement."""
    pairs = F.array(*[F.struct(F.lit(spelt).alias("spelt"), F.lit(like).alias("like")) for spelt, like in spellings])
    return F.aggregate(pairs, t, lambda s, p: F.when(s.contains(p["spelt"]), F.replace(s, p["spelt"], p["like"])).otherwise(s))


def _spelt_words(lower: Column) -> Column:
    """The words of a lower-cased text with one space between, spelt alike; line feeds stay."""
    return _spelt(F.regexp_replace(lower, NOT_WORDS, " "), SPELLINGS)


def _lines(words: Column) -> Column:
    return F.array_remove(F.transform(F.split(words, "\n", -1), lambda line: F.btrim(line)), "")


def _joined(lines: Column) -> Column:
    return _spelt(F.array_join(lines, " "), PAIRS)


def normalized(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """The columns ``keep`` and what is looked up of a text: whole (the whole), rest (the whole without the paragraphs
    of owners, null if there is none) and lines.

    Each step is a column that the next one reads more than once, so that the planner computes it once a row.
    """
    names = docs.select(*keep).columns
    low = docs.select(*keep, ascii_lower(F.coalesce(text, F.lit(""))).alias("low"))
    low = low.select(*names, "low", (F.col("low").contains("copyright") | F.col("low").contains("(c)") | F.col("low").contains("©")).alias("owner"))
    paragraphs = F.filter(F.split("low", PARAGRAPHS, -1), lambda p: ~p.rlike(OWNER_START))
    words = low.select(
        *names,
        _spelt_words(F.when(F.col("owner"), F.regexp_replace("low", UNIX_LINES + OWNER_LINE, "")).otherwise(F.col("low"))).alias("words"),
        F.when(F.col("owner"), _spelt_words(F.array_join(paragraphs, "\n"))).alias("rest"))
    lines = words.select(*names, _lines(F.col("words")).alias("lines"), _joined(_lines(F.col("rest"))).alias("rest"))
    return lines.select(*names, _joined(F.col("lines")).alias("whole"), "rest", "lines")


def known_licenses(spark: SparkSession, path: str | None = None) -> DataFrame:
    """license_id, text of the licences that come with the library, and of those in a Parquet table at ``path``."""
    known = spark.createDataFrame(STATEMENTS + TEXTS, "license_id string, text string")
    return known if path is None else known.unionByName(spark.read.parquet(path).select("license_id", "text"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, text_sha256 (digest of the whole normalised text), license_id (of the licence
    whose text it is, else null; the first in order where several licences share a text), n_license_lines and
    line_licenses (distinct ids of the licences whose text is a line of it, sorted, comma-joined).

    Null or empty texts, and texts of copyright lines only, normalise to nothing and match nothing, as do known
    texts that do. Repeated rows get a row each; null ids stay; empty tables give an empty result; other columns
    are not read. A very long text is one row's work, whole, and its lines are rows of their own. Lines are combined before
    the shuffle, which carries a row per document and task.
    """
    require(docs, id_col, text_col)
    known = known_licenses(docs.sparkSession) if known is None else known
    texts = normalized(known, F.col("text"), F.col("license_id"))
    digests = (
        texts.select("license_id", F.explode_outer(F.array("whole", "rest")).alias("t")).where("t != ''")
        .groupBy(F.sha2("t", 256).alias("digest")).agg(F.min("license_id").alias("license"))
    )
    if known.count() <= BROADCAST_TEXTS:
        digests = F.broadcast(digests)
    text = F.col(text_col)
    parts = normalized(docs, text, F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"))
    # Digests before the rows are dealt out: a row carries 64 characters, not its text. Unit 0 is the whole, 1 the rest.
    units = F.concat(F.array(F.sha2("whole", 256), F.when(F.col("rest") != "", F.sha2("rest", 256))),
                     F.transform("lines", lambda line: F.sha2(_spelt(line, PAIRS), 256)))
    rows = parts.select("id", "th", (F.col("whole") != "").alias("full"), units.alias("units"))
    # Of an inner explode the planner would infer a filter on the array, push it to the scan and compute every text again.
    rows = rows.select("id", "th", "full", F.posexplode_outer("units").alias("unit", "digest")).where("digest is not null")
    found = rows.join(digests, "digest", "left").withColumn("license", F.when(F.col("full") | (F.col("unit") > 0), F.col("license")))
    # A line that is no known text adds nothing.
    found = found.where((F.col("unit") == 0) | F.col("license").isNotNull())
    whole, part, line = F.col("unit") == 0, F.col("unit") == 1, F.col("unit") > 1
    per = found.groupBy("id", "th").agg(
        F.count_if(whole).alias("copies"),
        F.max(F.when(whole, F.col("digest"))).alias("text_sha256"),
        F.coalesce(F.max(F.when(whole, F.col("license"))), F.max(F.when(part, F.col("license")))).alias("license_id"),
        F.count(F.when(line, F.col("license"))).alias("n"),
        F.array_sort(F.collect_set(F.when(line, F.col("license")))).alias("ids"),
    )
    # Rows that repeat an id and text were one group: each gets its row again.
    per = per.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return per.select(F.col("id").alias(id_col), "text_sha256", "license_id",
                      (F.col("n") / F.col("copies")).cast("long").alias("n_license_lines"),
                      F.array_join("ids", ",").alias("line_licenses"))
