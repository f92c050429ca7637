"""Operator 8, language identification: known words first, shorter and shorter character n-grams for the rest.

Training counts words per language over distinct labelled texts, at most a bounded number of each language. A word the model knows adds
its log frequency per language; an unknown word adds the mean log frequency of its known n-grams of the longest
order that has any, from ORDERS downwards. The best sum is the language. The score is the posterior that the mean
word alone would give: the sums would be all but certain of any text of some length, of mixed or senseless ones too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.llm.common import give_back, materialize, require, without

WORD = re.compile(r"[^\W\d_]+")
# The same characters for the JVM: Python's word characters (no combining marks) without digits and underscore.
WORD_SQL = r"[\p{L}\p{Nl}\p{No}]+"
UNDECIDED = "und"
ORDERS = (4, 3, 2, 1)
# Bounds of the classifier: distinct labelled texts it is fitted on, words and n-grams kept, each per language.
TRAIN_DOCS = 6000
WORDS_PER_LANGUAGE = 40_000
GRAMS_PER_LANGUAGE = 20_000
SMOOTH = 0.5
CACHE_WORDS = 50_000


def held_out(doc_id: str):
    """True for ids whose crc32 (of the id as text) leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


class Model:
    """Log frequencies per language of words and n-grams."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        """counts: (word, language, occurrences)."""
        self.langs = sorted({lang for _, lang, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        words: dict[str, np.ndarray] = {}
        grams = {n: {} for n in ORDERS}
        for word, lang, c in counts:
            words.setdefault(word, np.zeros(len(at)))[at[lang]] += c
        for word, row in words.items():
            for n in ORDERS:
                for g in grams_of(word, n):
                    grams[n][g] = grams[n].get(g, 0) + row
        self.memory: dict[str, np.ndarray] = {}
        self.words = self._logs(words, WORDS_PER_LANGUAGE)
        self.grams = {n: self._logs(grams[n], GRAMS_PER_LANGUAGE) for n in ORDERS}

    def _logs(self, counts: dict[str, np.ndarray], keep: int) -> tuple[dict[str, int], np.ndarray]:
        """The most frequent entries of each language: their row by name, and log frequencies by row and language."""
        if not counts:
            return {}, np.zeros((0, len(self.langs)), dtype=np.float32)
        names = sorted(counts)
        table = np.array([counts[n] for n in names])
        total = table.sum(axis=0)
        rows = set()
        for lang in range(table.shape[1]):
            best = np.argsort(-table[:, lang], kind="stable")[:keep]
            rows.update(best[table[best, lang] > 0].tolist())
        rows = sorted(rows)
        logs = np.log(table[rows] + SMOOTH) - np.log(total + SMOOTH * len(names))
        return {names[r]: i for i, r in enumerate(rows)}, logs.astype(np.float32)

    def unseen(self, word: str) -> np.ndarray:
        """Mean log frequencies of the known n-grams of the longest order that has any."""
        found = self.memory.get(word)
        if found is None:
            found = np.zeros(len(self.langs), dtype=np.float32)
            for n in ORDERS:
                rows, logs = self.grams[n]
                known = [rows[g] for g in grams_of(word, n) if g in rows]
                if known:
                    found = logs[known].mean(axis=0)
                    break
            if len(self.memory) >= CACHE_WORDS:
                self.memory.clear()
            self.memory[word] = found
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = Counter(WORD.findall((text or "").lower()))
        # Number signs such as a half are word characters, yet no letters.
        if not self.langs or not any(c.isalpha() for w in counts for c in w):
            return UNDECIDED, 0.0
        rows, logs = self.words
        known = [(rows[w], c) for w, c in counts.items() if w in rows]
        total = np.zeros(len(self.langs))
        if known:
            at, times = zip(*known, strict=True)
            total += np.array(times, dtype=np.float64) @ logs[list(at)]
        for w, c in counts.items():
            if w not in rows:
                total += c * self.unseen(w).astype(np.float64)
        best = int(np.argmax(total))
        mean = (total - total[best]) / sum(counts.values())
        return self.langs[best], float(1.0 / np.exp(mean).sum())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between two marks; of order 1 its letters."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i:i + n] for i in range(len(marked) - n + 1)]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on the rows with a language and text: per language on each distinct text once, all of them up to
    ``train_docs``, else the ``train_docs`` of the smallest hashes (by text, so any ids, order or number of copies
    give the same model). What reaches the driver is bounded by WORDS_PER_LANGUAGE words per language."""
    require(docs, lang_col, text_col)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.withColumn("h", F.xxhash64("text"))
    # One row per language: small enough for every task.
    rows = rows.join(F.broadcast(last_hashes(rows, train_docs)), "lang").where("h <= last").select("lang", "h", "text")
    rows = first_copies(rows).dropDuplicates(["lang", "h"])
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD_SQL), F.lit(0))).alias("word"))
    counts = words.groupBy("lang", "word").count()
    top = Window.partitionBy("lang").orderBy(F.col("count").desc(), "word")
    counts = counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= WORDS_PER_LANGUAGE)
    return Model([(r["word"], r["lang"], r["count"]) for r in counts.select("word", "lang", "count").toLocalIterator()])


def last_hashes(rows: DataFrame, n: int) -> DataFrame:
    """(lang, last): the n-th smallest distinct h of each language, or the largest where it has no more than n.

    Hashes are spread evenly, so only those below a share of their range that holds n of them all but surely
    (eight standard deviations) are put in order: one task sees about n rows of a language, at any size.
    """
    hashes = materialize(rows.select("lang", "h").distinct(), "text-hashes")
    share = hashes.groupBy("lang").agg(((n + 8 * n**0.5 + 100) / F.count("*")).alias("share"))
    low = hashes.join(F.broadcast(share), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    low = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= n)
    return low.groupBy("lang").agg(F.max("h").alias("last"))


def first_copies(rows: DataFrame) -> DataFrame:
    """Rows (lang, h, text) without those that repeat a (lang, h) of their task, so copies do not all travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()
        for batch in batches:
            keep = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return rows.mapInArrow(run, "lang string, h bigint, text string")


def has_letters(text_col: str):
    """True where ``identify`` finds a letter in the text; false for null."""
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add lang_pred (a learned language, ``und`` without letters or for null text) and score (0 to 1: its
    posterior for the mean word; 0 for und).

    Only the text is used. Ties go to the first language in alphabetical order. Whole texts of any length count.
    Without training rows every text is ``und``. Repeated rows get the same answer; empty tables give an empty
    result; input columns named like an added one are replaced. Narrow: no shuffle.
    """
    require(docs, text_col)
    rest = without(docs, ["lang_pred", "score"])
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.predict(v.as_py()) for v in batch.column(batch.schema.get_field_index(text_col))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"])
        m.memory.clear()
        give_back()

    return rest.mapInArrow(run, f"{fields}, lang_pred string, score double")
