"""Byte-level BPE tables and the exact test of whether two tokens may stand side by side.

A token sequence is the BPE encoding of a word exactly if every token encodes to
itself and every adjacent pair is compatible: replaying the merges in rank order,
nothing ever merges across the boundary of the pair. Only the tokens that touch the
boundary matter, so a pair is decided by undoing its merges from the boundary outwards.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# The split pattern and the printable stand-ins of byte-level BPE.
PIECE_PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                 r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
VISIBLE_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

# Blocks whose letters and numbers are the same in every recent Unicode version.
SETTLED = ("\u0000-\u0557\u0600-\u086f\u1e00-\u2070\u2090-\u209c\u20a0-\u2bff\u3000-\u30ff\u3400-\u4db5"
           "\u4e00-\u9fa5\uac00-\ud7a3\ue000-\ufaff\uff00-\uffff\U0001f000-\U0001fbef")

PIECES = regex.compile(PIECE_PATTERN)
UNSETTLED = re.compile(f"[^{SETTLED}]")
# No piece crosses a single space between two visible characters.
SAFE_CUT = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
CHUNK_CHARS = 1 << 20
CACHE_WORD_CHARS = 64
NEVER = np.int64(1) << 40


def stand_ins() -> dict[str, int]:
    """Printable character -> byte: visible bytes stand for themselves, the others follow from U+0100."""
    out = {chr(b): b for b in VISIBLE_BYTES}
    hidden = [b for b in range(256) if b not in set(VISIBLE_BYTES)]
    return out | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class BpeTables:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if (model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"]
                or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout")):
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        to_byte = stand_ins()
        size = max([*model["vocab"].values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that strip or need word limits are not supported")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.bytes_of: list[bytes] = [b""] * size
        for name, i in model["vocab"].items():
            if name not in self.special:
                self.bytes_of[i] = bytes(to_byte[c] for c in name)
        id_of = {b: i for i, b in enumerate(self.bytes_of) if b}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.size = size
        self.byte_id = np.array([id_of[bytes([b])] for b in range(256)], dtype=np.int64)
        # How each token was made: rank of its merge (-1: a byte) and its two parts.
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = (id_of[bytes(to_byte[c] for c in x)] for x in (a, b))
            made = id_of[self.bytes_of[left] + self.bytes_of[right]]
            if self.rank[made] >= 0:
                raise ValueError("a token made by two merges is not supported")
            self.rank[made], self.left[made], self.right[made] = rank, left, right
            self.merge_of[left, right] = rank, made
        keys = np.array([a * size + b for a, b in self.merge_of], dtype=np.int64)
        self._made = np.array([m for _, m in self.merge_of.values()], dtype=np.int64)
        order = np.argsort(keys)
        self._keys = keys[order]
        self._ranks = np.array([r for r, _ in self.merge_of.values()], dtype=np.int64)[order]
        # Tokens that encode to themselves: both parts do, and nothing crosses their seam before the last merge.
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        seam_ok = self.compatible(self.left[made], self.right[made], self.rank[made])
        stable = self.rank < 0
        for t, ok, a, b in zip(made.tolist(), seam_ok.tolist(), self.left[made].tolist(), self.right[made].tolist(), strict=True):
            stable[t] = ok and stable[a] and stable[b]
        self.id_of = {b: i for b, i in id_of.items() if stable[i]}
        self.id_of.update({bytes([b]): int(i) for b, i in enumerate(self.byte_id)})
        # The tokens as a tree of bytes: (node << 8 | byte) -> node, and the token that ends at a node or -1.
        self.step: dict[int, int] = {}
        ends = [-1]
        for b, i in sorted(self.id_of.items()):
            node = 0
            for byte in b:
                node = self.step.setdefault(node << 8 | byte, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        self.ends = ends
        self._steps = np.array(sorted(self.step), dtype=np.int64)
        self._nodes = np.array([self.step[k] for k in self._steps.tolist()], dtype=np.int64)
        self._ends = np.array(ends, dtype=np.int64)

    def longest_matches(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many non-empty short words at once, as (all ids in order, ids per word): every
        word reads a byte per round, and takes its longest token when no token goes on."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        data = np.append(np.frombuffer(b"".join(words), dtype=np.uint8), 0).astype(np.int64)
        end = np.cumsum(lengths)
        at, word = end - lengths, np.arange(len(words))
        node, token, after = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64), at.copy()
        out, owner = [], []
        while len(word):
            key = node << 8 | data[at]
            i = np.minimum(np.searchsorted(self._steps, key), len(self._steps) - 1)
            on = (self._steps[i] == key) & (at < end)
            node = np.where(on, self._nodes[i], 0)
            at = at + on
            t = self._ends[node]
            hit = on & (t >= 0)
            token[hit], after[hit] = t[hit], at[hit]
            off = np.flatnonzero(~on)
            if len(off):
                out.append(token[off])
                owner.append(word[off])
                at[off] = after[off]
                if (after[off] == end[off]).any():
                    go = on | (after < end)
                    word, at, end, node, token, after = word[go], at[go], end[go], node[go], token[go], after[go]
        owner = np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(out)[order], np.bincount(owner, minlength=len(words))

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; NEVER where there is none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | int = NEVER) -> np.ndarray:
        """For each pair of tokens: does nothing merge across their boundary (before the given rank)?

        ``la``/``lb`` is when the piece now at the boundary is consumed by its own
        side. A merge across at rank m happens first if m < la and m <= lb (on equal
        ranks the leftmost pair goes first). The piece made later is undone first.
        """
        a, b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        la = np.broadcast_to(np.asarray(before, dtype=np.int64), a.shape).copy()
        lb = np.where(la == NEVER, NEVER, la - 1)
        ok = np.ones(a.shape, dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            m = self.merge_rank(x, y)
            crossed = (m < la[live]) & (m <= lb[live])
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~crossed & ((rx >= 0) | (ry >= 0))
            undo_a = go & (rx > ry)
            undo_b = go & ~undo_a
            i = live[undo_a]
            la[i], a[i] = rx[undo_a], self.right[x[undo_a]]
            i = live[undo_b]
            lb[i], b[i] = ry[undo_b], self.left[y[undo_b]]
            live = live[go]
        return ok

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """BPE by its definition for many short words at once, as (all ids in order, ids per word): in each round
        every word merges its leftmost pair of lowest rank; only the pairs beside a merge are looked up again."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ids = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        ranks = self._seam_ranks(ids, word, np.arange(len(ids)))
        done_ids, done_words = [], []
        while len(ids):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            best = np.minimum.reduceat(ranks, starts)
            over = best == NEVER
            if over.any():
                ended = np.repeat(over, sizes)
                done_ids.append(ids[ended])
                done_words.append(word[ended])
                ids, word, ranks = ids[~ended], word[~ended], ranks[~ended]
                if not len(ids):
                    break
                sizes, best = sizes[~over], best[~over]
            hits = np.flatnonzero(ranks == np.repeat(best, sizes))
            at = hits[np.append(True, word[hits[1:]] != word[hits[:-1]])]
            ids[at] = self._made[ranks[at]]
            keep = np.ones(len(ids), dtype=bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            ids, word, ranks = ids[keep], word[keep], ranks[keep]
            near = np.concatenate((at, np.maximum(at - 1, 0)))
            ranks[near] = self._seam_ranks(ids, word, near)
        owner = np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(done_ids)[order], np.bincount(owner, minlength=len(words))

    def _seam_ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Merge ranks of the pairs that start at the given places; NEVER at the end of a word."""
        after = np.minimum(at + 1, len(ids) - 1)
        ranks = self.merge_rank(ids[at], ids[after])
        return np.where((word[at] == word[after]) & (after > at), ranks, NEVER)

    def merge_exactly(self, word: bytes) -> list[int]:
        """The same for one long word, with a heap over a linked list."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = self.merge_of.get((ids[i], ids[i + 1]))
            if found:
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = made, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                found = self.merge_of.get((made, ids[nxt[i]]))
                if found:
                    heapq.heappush(heap, (found[0], i, made, ids[nxt[i]], found[1]))
            if prev[i] >= 0:
                found = self.merge_of.get((ids[prev[i]], made))
                if found:
                    heapq.heappush(heap, (found[0], prev[i], ids[prev[i]], made, found[1]))
        return [t for t in ids if t >= 0]


@functools.lru_cache(maxsize=4)
def tables(path: str) -> BpeTables:
    """Tables of a file, loaded once per Python process."""
    return BpeTables(path)


@functools.lru_cache(maxsize=4)
def special_pattern(path: str):
    names = sorted(tables(path).special, key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None


def segments(path: str, text: str) -> Iterator[tuple[str, str | None]]:
    """(ordinary text, the special string that follows it or None) from left to right."""
    pattern = special_pattern(path)
    parts = pattern.split(text) if pattern else [text]
    for i in range(0, len(parts), 2):
        yield parts[i], parts[i + 1] if i + 1 < len(parts) else None


@functools.lru_cache(maxsize=4)
def library_split(path: str):
    """The tokenizers library's own splitter."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


def pieces(path: str, text: str) -> list[str]:
    """The words that BPE sees. Characters whose class depends on the Unicode version go by the library's split."""
    if text.isascii() or not UNSETTLED.search(text):
        return PIECES.findall(text)
    return [text[a:b] for _, (a, b) in library_split(path).pre_tokenize_str(text)]


def chunks(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Very long texts in parts that no piece crosses, so memory stays bounded."""
    start = 0
    while len(text) - start > size:
        cut = SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def split(path: str, text: str) -> Iterator[tuple[list[str], str | None]]:
    """(words of a part, the special string right after it or None), part by part."""
    for ordinary, special in segments(path, text):
        before = None
        for part in chunks(ordinary):
            if before is not None:
                yield before, None
            before = pieces(path, part)
        yield before, special


def split_all(path: str, texts: list[str]) -> list:
    """``split`` of each text, kept as a list to be used twice; very long texts stay lazy."""
    return [list(split(path, t)) if len(t) <= CHUNK_CHARS else None for t in texts]


def new_words(parts: list, known: dict) -> list[str]:
    """Distinct short words of ``split_all`` that are not known yet."""
    seen: set[str] = set()
    for part in parts:
        for words, _ in part or ():
            seen.update(words)
    return [w for w in seen if w not in known and len(w) <= CACHE_WORD_CHARS]


def runs_of(column: pa.Array, most_bytes: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    lo = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most_bytes:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
