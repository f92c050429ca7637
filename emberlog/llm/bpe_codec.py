"""Operator 3, BPE encoding and decoding: speculate and verify.

Each distinct word of a batch is cut greedily into the longest tokens. One vectorised
check then tests every adjacent pair of all words at once; a word whose pairs are all
compatible is proven right, and only the words that fail are merged exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberlog.llm.bpe_tables import CACHE_WORD_CHARS, new_words, runs_of, split, split_all, tables
from emberlog.llm.common import give_back, require, without

CACHE_WORDS = 120_000
BATCH_BYTES = 2_000_000


class BpeCodec:
    """encode/decode of whole texts, as the tokenizers library without added begin or end tokens."""

    def __init__(self, path: str):
        self.path = path
        self.t = tables(path)
        self._ids: dict[str, bytes] = {}
        self.proposed = self.failed = 0

    def _propose(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match from left to right, as (all ids in order, ids per word)."""
        if all(len(w) <= 4 * CACHE_WORD_CHARS for w in words):
            return self.t.longest_matches(words)
        found = [self._propose_one(w) for w in words]
        return np.array(list(chain.from_iterable(found)), dtype=np.int64), np.array(list(map(len, found)))

    def _propose_one(self, word: bytes) -> list[int]:
        step, ends = self.t.step, self.t.ends
        out, i = [], 0
        while i < len(word):
            node = 0
            for j in range(i, len(word)):
                node = step.get(node << 8 | word[j])
                if node is None:
                    break
                if ends[node] >= 0:
                    found, end = ends[node], j + 1
            out.append(found)
            i = end
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each word."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        flat, lengths = self._propose(raw)
        word_of = np.repeat(np.arange(len(words)), lengths)
        seams = np.flatnonzero(word_of[1:] == word_of[:-1])
        bad = ~self.t.compatible(flat[seams], flat[seams + 1])
        wrong = set(word_of[seams[bad]].tolist())
        self.proposed += len(words)
        self.failed += len(wrong)
        packed = flat.astype("<u4").tobytes()
        ends = (np.cumsum(lengths) * 4).tolist()
        out = [packed[end - 4 * n:end] for end, n in zip(ends, lengths.tolist(), strict=True)]
        short = [k for k in wrong if len(raw[k]) <= CACHE_WORD_CHARS]
        if short:
            ids, sizes = self.t.merge_words([raw[k] for k in short])
            packed, ends = ids.astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
            for k, end, n in zip(short, ends, sizes.tolist(), strict=True):
                out[k] = packed[end - 4 * n:end]
        for k in wrong:
            if len(raw[k]) > CACHE_WORD_CHARS:
                out[k] = np.array(self.t.merge_exactly(raw[k]), dtype="<u4").tobytes()
        return out

    def encode(self, text: str, parts: list | None = None) -> bytes:
        """Ids of a whole text as little-endian uint32; ``parts``: its ``split``, if at hand."""
        out: list[bytes] = []
        known = self._ids
        for words, special in parts if parts is not None else split(self.path, text):
            try:
                out.extend([known[w] for w in words])
            except KeyError:
                new = [w for w in dict.fromkeys(words) if w not in known]
                found = dict(zip(new, self.encode_words(new), strict=True))
                out.extend([found[w] if w in found else known[w] for w in words])
            if special:
                out.append(np.array([self.t.special[special]], dtype="<u4").tobytes())
        return b"".join(out)

    def learn(self, parts: list) -> None:
        """Encode the new words of a batch in one go, so the vectorised check sees long arrays."""
        words = new_words(parts, self._ids)
        if len(self._ids) + len(words) > CACHE_WORDS:
            self._ids.clear()
            words = new_words(parts, self._ids)
        self._ids.update(zip(words, self.encode_words(words), strict=True))

    def decode(self, ids: bytes) -> str:
        """Text of little-endian uint32 ids, special tokens kept, broken UTF-8 replaced."""
        return b"".join(map(self.t.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


ADDED = ("n_tokens", "token_ids", "decoded")


def encode_texts(df: DataFrame, vocab: str, text_col: str = "text", decode: bool = True,
                 digests: bool = False) -> DataFrame:
    """Add n_tokens, token_ids (binary: ids as little-endian uint32) and, with ``decode``, decoded (the
    text those ids decode to). With ``digests`` the two real outputs give way to ids_sha256 and
    decoded_sha256 (lower-case hex), computed from them in the same pass.

    A null text counts as empty: no tokens, decoded ''. Repeated rows are encoded each, an empty table
    gives an empty result, other columns stay; columns named like an added one are replaced. Very long
    texts are cut where no word crosses, so memory is bounded by one text and the word cache. Narrow: no shuffle.
    """
    require(df, text_col)
    names = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["token_ids", *(["decoded"] if decode else [])])]
    if text_col in names:
        raise ValueError(f"the text column may not be named {text_col}")
    rest = without(df, names)
    kinds = [T.LongType(), *([T.StringType()] * 2 if digests else [T.BinaryType(), *([T.StringType()] if decode else [])])]
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BpeCodec(vocab)
        arrow = [pa.int64(), *([pa.string()] * 2 if digests else [pa.binary(), pa.string()])]
        for whole in batches:
            place = whole.schema.get_field_index(text_col)
            for lo, hi in runs_of(whole.column(place), BATCH_BYTES):
                batch = whole.slice(lo, hi - lo)
                texts = [v.as_py() or "" for v in batch.column(place)]
                parts = split_all(vocab, texts)
                codec.learn(parts)
                rows: list[tuple] = []
                for text, part in zip(texts, parts, strict=True):
                    ids = codec.encode(text, part)
                    row: tuple = (len(ids) // 4,)
                    if digests:
                        row += (hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                    else:
                        row += (ids, codec.decode(ids)) if decode else (ids,)
                    rows.append(row)
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array(c, k) for c, k in zip(cols, arrow, strict=False))],
                    names=[*batch.schema.names, *names])
        give_back()

    return rest.mapInArrow(run, schema)
