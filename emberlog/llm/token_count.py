"""Operator 1, token counts by prefix dynamic programming.

For every prefix of a word the last token of its encoding is the one suffix token that
is compatible with the last token of what precedes it, so one pass gives the exact
token count of every prefix. Words (pieces of the split pattern) add up, which gives the
exact count of every prefix of the text: a truncation point or a budget question is a
lookup in that table, with no second encoding.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberlog.llm.bpe_tables import CACHE_WORD_CHARS, new_words, pieces, runs_of, split, split_all, tables
from emberlog.llm.common import require, without

SPACE_RUN = regex.compile(r"\p{White_Space}{2,}+")
TWO_SPACES = re.compile(r"\s\s")
# Suffixes the split pattern keeps whole; cut after two characters they fall apart.
SPLIT_SUFFIXES = ("'re", "'ve", "'ll")
CACHE_WORDS = 500_000
BATCH_BYTES = 8_000_000
CACHE_PAIRS = 1_000_000


class PrefixCounter:
    """Exact token counts of all prefixes (in code points) of a text."""

    def __init__(self, path: str):
        self.path = path
        self.t = tables(path)
        self._words: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}
        self._states: dict[bytes, tuple] = {}  # at most one per beginning of a token
        self._begins = {b[:k] for b in self.t.id_of for k in range(len(b) + 1)}

    def _walk(self, a: int, b: int) -> bool:
        """``BpeTables.compatible`` for one pair."""
        rank, left, right, merges = self._lists()
        la = lb = 1 << 60
        while True:
            found = merges.get((a, b))
            if found and found[0] < la and found[0] <= lb:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                la, a = ra, right[a]
            else:
                lb, b = rb, left[b]

    def _lists(self):
        if not hasattr(self, "_as_lists"):
            t = self.t
            self._as_lists = t.rank.tolist(), t.left.tolist(), t.right.tolist(), t.merge_of
        return self._as_lists

    def _state(self, ending: bytes) -> tuple[dict, list[tuple[int, int]], bytes]:
        """What is known after reading some bytes: next states by byte, (length, token) of all tokens that
        end here with the longest first, and the longest ending that some token begins with."""
        while ending not in self._begins:
            ending = ending[1:]
        known = self._states.get(ending)
        if known is None:
            id_of = self.t.id_of
            ends = [(len(ending) - j, t) for j in range(len(ending)) if (t := id_of.get(ending[j:])) is not None]
            known = self._states[ending] = ({}, ends, ending)
        return known

    def _counts(self, raws: list[bytes]) -> Iterator[list[int]]:
        """Tokens of word[:i] for i = 0 .. len(word), for sorted words: a word goes on where it leaves the one before."""
        start = self._state(b"")
        last, count, states, before = [-1], [0], [start], b""
        pairs, size, walk = self._pairs, self.t.size, self._walk
        if len(pairs) > CACHE_PAIRS:
            pairs.clear()
        for word in raws:
            same = len(commonprefix((word, before)))
            del last[same + 1:], count[same + 1:], states[same + 1:]
            state = states[-1]
            for i in range(same + 1, len(word) + 1):
                byte = word[i - 1]
                moved = state[0].get(byte)
                if moved is None:
                    moved = state[0][byte] = self._state(state[2] + word[i - 1:i])
                state = moved
                for k, token in state[1]:  # noqa: B007
                    if k == i:
                        break
                    pair = last[i - k] * size + token
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = walk(last[i - k], token)
                    if fits:
                        break
                last.append(token)
                count.append(count[i - k] + 1)
                states.append(state)
            before = word
            yield count

    def _solve(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """int32 counts after each character of each piece, as bytes."""
        order = sorted((w.encode(), w) for w in words)
        for (raw, piece), count in zip(order, self._counts([r for r, _ in order]), strict=True):
            if len(raw) == len(piece):
                out = count[1:]
            else:
                out = [c for c, b in zip(count[1:], [*raw[1:], 0], strict=True) if b & 0xC0 != 0x80]
            if piece in SPLIT_SUFFIXES:
                out[1] = 2  # the quote and one letter are two pieces
            yield piece, array("i", out).tobytes()

    def learn(self, parts: list) -> None:
        """Solve the new words of a batch of texts together, so that they share their beginnings."""
        words = new_words(parts, self._words)
        if len(self._words) + len(words) > CACHE_WORDS:
            self._words.clear()
            words = new_words(parts, self._words)
        self._words.update(self._solve(words))

    def word_counts(self, piece: str) -> bytes:
        known = self._words.get(piece)
        if known is None:
            known = next(self._solve([piece]))[1]
            if len(piece) <= CACHE_WORD_CHARS:
                if len(self._words) >= CACHE_WORDS:
                    self._words.clear()
                self._words[piece] = known
        return known

    def _sum(self, words: list[str], spaced: bool) -> np.ndarray:
        """Table of a run of words: counts within each word on top of the words before it."""
        known = self._words
        try:
            solved = list(map(known.__getitem__, words))
        except KeyError:
            solved = [known[p] if p in known else self.word_counts(p) for p in words]
        table = np.frombuffer(b"".join(solved), dtype=np.int32)
        if not len(table):
            return table
        lengths = np.fromiter(map(len, solved), dtype=np.int64, count=len(solved)) // 4
        before = np.cumsum(table[np.cumsum(lengths) - 1])
        table = table + np.repeat(np.append(0, before[:-1]), lengths).astype(np.int32)
        if spaced:
            text = "".join(words)
            for run in SPACE_RUN.finditer(text):
                if run.end() < len(text):
                    # A prefix that ends with the whole run of spaces keeps the run in one piece.
                    start = int(table[run.start() - 1]) if run.start() else 0
                    table[run.end() - 1] = start + np.frombuffer(self.word_counts(run.group()), dtype=np.int32)[-1]
        return table

    def table(self, text: str, parts: list | None = None) -> np.ndarray:
        """int32 array: entry i is the exact token count of text[:i + 1]; ``parts``: its ``split``, if at hand."""
        base, out = 0, []
        spaced = TWO_SPACES.search(text) is not None
        for words, special in parts if parts is not None else split(self.path, text):
            counts = self._sum(words, spaced) + np.int32(base)
            out.append(counts)
            if special:
                # A cut inside a special string leaves ordinary text behind.
                before = "".join(words)
                cut = self._sum(pieces(self.path, before + special[:-1]), True) + np.int32(base)
                out.append(cut[len(before):])
            base = int(counts[-1]) if len(counts) else base
            if special:
                base += 1
                out.append(np.array([base], dtype=np.int32))
        return np.concatenate(out)


def cut_at(table: np.ndarray, budget: int) -> int:
    """Longest prefix, in code points, of at most ``budget`` tokens (counts may fall again as a prefix grows)."""
    fits = np.flatnonzero(table <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


ADDED = ("n_bytes", "n_tokens", "over_limit", "cut_chars", "prefix_tokens")


def token_counts(df: DataFrame, vocab: str, text_col: str = "text", limit: int = 1024,
                 with_table: bool = False) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), cut_chars (code points of the
    longest prefix of at most ``limit`` tokens) and, if asked for, prefix_tokens (array<int>: tokens of
    every prefix; texts of any length, so keep it only where it is wanted).

    A null text counts as empty: 0 bytes, 0 tokens, an empty table. Rows, ids and ties are never
    merged: repeated rows each get their counts; an empty table gives an empty result. Input columns
    named like an added one are replaced. Narrow: no shuffle, one pass, memory bounded by a batch.
    """
    require(df, text_col)
    names = ADDED if with_table else ADDED[:-1]
    if text_col in names:
        raise ValueError(f"the text column may not be named {text_col}")
    rest = without(df, names)
    types = (T.LongType(), T.LongType(), T.BooleanType(), T.LongType(), T.ArrayType(T.IntegerType()))
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, t) for n, t in zip(names, types, strict=False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(vocab)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            rows: list[tuple] = []
            tables_: list = []
            for lo, hi in runs_of(column, BATCH_BYTES):
                texts = [v.as_py() or "" for v in column.slice(lo, hi - lo)]
                parts = split_all(vocab, texts)
                counter.learn(parts)
                for text, part in zip(texts, parts, strict=True):
                    table = counter.table(text, part)
                    n = int(table[-1]) if len(table) else 0
                    rows.append((len(text.encode()), n, n > limit, cut_at(table, limit) if n > limit else len(text)))
                    if with_table:
                        tables_.append(table)
            cols = list(zip(*rows, strict=True)) or [()] * 4
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.bool_()),
                      pa.array(cols[3], pa.int64())]
            if with_table:
                arrays.append(pa.array(tables_, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return rest.mapInArrow(run, schema)
