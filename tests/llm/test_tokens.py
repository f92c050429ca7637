"""Operators 1 and 3 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from emberlog.llm.bpe_codec import BpeCodec, encode_texts
from emberlog.llm.bpe_tables import UNSETTLED, pieces, split_all
from emberlog.llm.token_count import PrefixCounter, cut_at, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'re", "'ll", "'s", "<|endoftext|>", "é", "日本", "1", "23", "!!", "<|", "the", "ing",
         "\u00a0", "👍🏽", "aaaa", "\x1c", "—", "\u0558", "\ua7d2"]
SCHEMA = "doc_id long, text string, n_tokens string, extra int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, longest, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_every_prefix_has_the_librarys_count(library):
    counter = PrefixCounter(PATH)
    for text in texts(300, 12):
        table = counter.table(text)
        assert table.tolist() == [len(library.encode(text[:i + 1], add_special_tokens=False).ids) for i in range(len(text))]
        for budget in (0, 1, 5):
            assert cut_at(table, budget) == max([i + 1 for i, n in enumerate(table) if n <= budget], default=0)


def test_encode_and_decode_equal_the_library(library):
    codec = BpeCodec(PATH)
    sample = texts(800, 40) + ["a" * 5000, "xyz" * 3000, " " * 3000, "".join(random.Random(1).choices("abcdefgh", k=20000))]
    codec.learn(split_all(PATH, sample[:400]))
    for text in sample:
        ids = codec.encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, dtype="<u4").tolist() == want
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert 0 < codec.failed < codec.proposed


def test_split_of_unsettled_characters_is_the_librarys(library):
    for c in ["\u0558", "\u088f", "\ua7d2", "ab"]:
        text = f"a{c}{c}b 1{c} {c}"
        assert pieces(PATH, text) == [text[x:y] for _, (x, y) in library.pre_tokenizer.pre_tokenize_str(text)]
    assert not UNSETTLED.search("plain é 日本 👍")


def test_rows_nulls_repeats_and_clashing_names(spark, library):
    rows = [(1, "Hello world", "x", 1), (1, "Hello world", "x", 1), (None, None, None, None), (3, "", "y", 2), (4, "tok " * 3000, "z", 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = token_counts(df, PATH, with_table=True)
    assert got.columns == ["doc_id", "text", "extra", "n_bytes", "n_tokens", "over_limit", "cut_chars", "prefix_tokens"]
    out = got.collect()
    assert len(out) == 5
    for r in out:
        text = r["text"] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 1024)
        assert len(r["prefix_tokens"]) == len(text)
        assert len(library.encode(text[:r["cut_chars"]], add_special_tokens=False).ids) <= 1024
    enc = {(r["doc_id"], r["text"]): r for r in encode_texts(df, PATH).collect()}
    assert enc[1, "Hello world"]["decoded"] == "Hello world" and enc[None, None]["n_tokens"] == 0
    dig = encode_texts(df, PATH, digests=True).where("doc_id = 3").first()
    assert dig["ids_sha256"] == dig["decoded_sha256"] == hashlib.sha256(b"").hexdigest()


def test_empty_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert token_counts(df, PATH).count() == 0
    assert encode_texts(df, PATH).count() == 0
    with pytest.raises(ValueError, match="missing columns"):
        token_counts(df, PATH, text_col="body")
