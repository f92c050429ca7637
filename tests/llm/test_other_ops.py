"""Operators 5, 6, 7, 8 and the pipeline."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import chat_format, hamming_topk, lang_id, warc
from emberlog.llm.common import shared_path

# -- exact top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(400, 64))
    vectors[100:250] = vectors[0]  # one hot code
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(400, None), (401, [1.0] * 63), (None, [1.0] * 64), (402, [None] * 64), (402, [None] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hamming_topk.top_k(df, df.where("vec_id % 50 = 0"), k=7).collect()
    bits = np.vstack([vectors > 0, np.zeros((1, 64), dtype=bool)])
    ids = [*range(400), 402]
    want = set()
    for q in range(0, 400, 50):
        d = (bits[q] != bits).sum(axis=1)
        for rank, k in enumerate(sorted(range(len(ids)), key=lambda k: (d[k], ids[k]))[:7], 1):
            want.add((q, rank, ids[k], int(d[k])))
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_top_k_of_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0] * 64), (50, [-1.0] * 64)], "vec_id long, embedding array<float>")
    assert hamming_topk.top_k(df, df, k=5).count() == 4
    assert hamming_topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_any_length_and_id(spark, monkeypatch):
    # Several parts and blocks; vectors of 24 and 32 values, text ids, repeated rows, columns named like the operator's own.
    monkeypatch.setattr(hamming_topk, "INDEX_CODES", 40)
    monkeypatch.setattr(hamming_topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(11)
    rows = [(f"v{i}", [float(x) for x in rng.normal(size=24 if i % 3 else 32)]) for i in range(150)]
    rows += [("w", rows[1][1]), ("a", rows[1][1])] + rows[:40] * 3 + [("none", None), ("empty", [])]
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "vec_id string, embedding array<double>, code string, dims int, part int")
    got = {tuple(r) for r in hamming_topk.top_k(df, df, k=6).collect()}
    bits = {i: np.array(v) > 0 for i, v in rows if v}
    want = set()
    for q, x in bits.items():
        near = sorted((int((x != y).sum()), i) for i, y in bits.items() if len(x) == len(y))[:6]
        want |= {(q, rank, i, d) for rank, (d, i) in enumerate(near, 1)}
    assert got == want


# -- WARC

PAGES = "page_id long, url string, html string, digest int"


def test_archives_read_back(spark):
    rows = [(5, "http://a/\r\n%x", "<p>é</p>", 1), (2, "http://b", "<p>é</p>", 1), (3, None, None, 1), (4, "http://c", "", 1),
            (None, "http://d", "", 1), (7, "http://e", "z" * 200_000, 1), (7, "http://e", "z" * 200_000, 1), (9, "http://f", "\r\n\r\nWARC/1.1", 1)]
    df = spark.createDataFrame(rows, PAGES)
    folder = shared_path(spark, "warc-test")
    index = warc.write_archives(df, folder)
    back = warc.read_records(index, folder).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted([
        (5, len("<p>é</p>".encode()), digest("<p>é</p>"), "revisit", 2), (2, len("<p>é</p>".encode()), digest("<p>é</p>"), "response", None),
        (3, 0, digest(""), "response", None), (4, 0, digest(""), "revisit", 3), (None, 0, digest(""), "revisit", 3),
        (7, 200_000, digest("z" * 200_000), "response", None), (7, 200_000, digest("z" * 200_000), "response", None),
        (9, 12, digest("\r\n\r\nWARC/1.1"), "response", None)], key=str)
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back], key=str) == want
    assert {r["page_id"]: r["url"] for r in back}[5] == "http://a/\r\n%x"
    # One selected record is one gzip member at its place.
    row = index.where("page_id = 2").first()
    system, path = warc.file_system(folder)
    with system.open_input_file(f"{path}/{row['file']}") as f:
        raw = zlib.decompress(f.read_at(row["length"], row["offset"]), 31)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith("<p>é</p>\r\n\r\n".encode())
    # The block of a response is an HTTP response: its own header, an empty line, the payload.
    headers, block = raw.split(b"\r\n\r\n", 1)
    assert b"WARC-Type: response\r\n" in headers and b"Content-Type: application/http; msgtype=response\r\n" in headers
    assert block.startswith(b"HTTP/1.1 200 OK\r\n") and f"Content-Length: {len('<p>é</p>'.encode())}\r\n\r\n".encode() in block
    assert warc.read_records(index.where("page_id = 9"), folder).count() == 1
    big = warc.write_archives(df, shared_path(spark, "warc-test"), min_bytes=100)
    assert big.where("record_type = 'revisit'").count() == 0
    assert warc.write_archives(df.limit(0), folder).count() == 0


def test_archives_are_read_by_several_tasks(spark):
    rng = random.Random(4)
    rows = [(i, f"http://a/{i}", rng.randbytes(3000).hex(), i) for i in range(600)]
    folder = shared_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), folder, date="2025-05-05T00:00:00Z")
    assert index.select("file").distinct().count() == 1
    back = warc.read_records(index, folder)
    # A file of a few megabytes is still dealt to several tasks; each page comes back once.
    assert back.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in back.collect()} == {i: h for i, _, h, _ in rows}
    assert b"WARC-Date: 2025-05-05T00:00:00Z\r\n" in warc.build_record(1, "u", b"x", "d", "response", None, "2025-05-05T00:00:00Z")


def test_ranges_are_coalesced():
    ranges = [(0, 10), (10, 10), (30, 5), (200, 10), (210, 1000)]
    assert list(warc.coalesced(ranges, gap=15, most=100)) == [(0, 3, 0, 35), (3, 4, 200, 210), (4, 5, 210, 1210)]


# -- chat


def test_round_trip_of_random_turns():
    rng = random.Random(3)
    parts = ["\\", "###", "### ", "</turn>", " ", "\n", ":", ": ", "a", " </turn>\n", "#", "### Assistant: x", "<", "\\</turn>", "\\0"]
    roles = [None, "", "user", "a:b", "x: y", "### q", "\\", "\n", "\\0", "\\:", ":", "a\\", "</turn>"]
    for _ in range(5000):
        rows = [(rng.choice(roles), "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))) for _ in range(rng.randint(1, 3))]
        whole = "".join(chat_format.render(*r) for r in rows)
        back = chat_format.parse(whole)
        assert [(r, t) for r, t, _, _ in back] == rows
        assert [chat_format.unmasked(whole, a, b) for _, _, a, b in back] == [t for _, t in rows]
    assert chat_format.render("user", "plain: text") == "### user: plain: text </turn>\n"
    for bad in ("x", "### user", "### user: a", "### user: a </turn>", "### user: ### b </turn>\n", "### user:a </turn>\n"):
        with pytest.raises(ValueError):
            chat_format.parse(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a </turn>"), (1, 2, "assistant", None), (2, None, None, "x"), (None, 0, "assistant", "é" * 50_000),
            (1, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn int, role string, text string, segment string")
    out = {r["conv_id"]: r for r in chat_format.conversation_digests(chat_format.format_turns(df)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (out[1]["n_turns"], out[1]["turns_sha256"]) == (4, sha("user\na </turn>\nassistant\nb\nassistant\nb\nassistant\n\n"))
    assert (out[1]["loss_chars"], out[1]["loss_sha256"]) == (2, sha("bb"))
    assert out[2]["turns_sha256"] == sha("\nx\n") and out[None]["loss_chars"] == 50_000
    assert chat_format.conversation_digests(chat_format.format_turns(df.limit(0))).count() == 0


# -- language

WORDS = {"aa": ["the", "and", "house", "water"], "bb": ["der", "und", "haus", "wasser"]}


def test_language(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(WORDS[lang], k=12)), lang) for i in range(80) for lang in WORDS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lang_id.train(df)
    asked = spark.createDataFrame([(1, "the house", "x"), (2, "UND Haus!", "x"), (3, None, "x"), (4, "12 + 3", "x"), (5, "wassers", "x"), (6, "", "x"),
                                   (7, "ш", "x"), (8, "½ ²", "x"), (1, "the house", "x")], "doc_id long, text string, score string")
    out = lang_id.identify(asked, model).collect()
    assert len(out) == 9
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert {k: v[0] for k, v in got.items()} == {1: "aa", 2: "bb", 3: "und", 4: "und", 5: "bb", 6: "und", 7: "aa", 8: "und"}
    assert all(0 <= s <= 1 for _, s in got.values()) and got[7][1] == 0.5
    empty = lang_id.train(df.limit(0))
    assert {r["lang_pred"] for r in lang_id.identify(asked, empty).collect()} == {"und"}
    assert lang_id.identify(asked.limit(0), model).count() == 0


def test_training_takes_each_distinct_text_once_and_every_language(spark):
    rare = ["wasser haus", "wasser und"]
    rows = [(f"the w{i}", "aa") for i in range(300)] + [("the copy", "aa")] * 200 + [(t, "bb") for t in rare] + [(None, "aa"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    model = lang_id.train(df, train_docs=20)
    assert model.langs == ["aa", "bb"] and {"wasser", "haus", "und"} <= set(model.words[0])
    hashes = df.where("lang = 'aa' AND text IS NOT NULL").selectExpr("text", "xxhash64(text) AS h").distinct().orderBy("h").limit(20)
    assert {w for r in hashes.collect() for w in lang_id.WORD.findall(r["text"])} == {w for w in model.words[0]} - {"wasser", "haus", "und"}
    # Copies neither add weight nor crowd others out.
    once = lang_id.train(df.distinct(), train_docs=20)
    assert once.words[0] == model.words[0] and (once.words[1] == model.words[1]).all()
    same = spark.createDataFrame([("the water", "aa")] * 500, "text string, lang string")
    assert lang_id.train(same, train_docs=20).langs == ["aa"]


def test_held_out_rows_are_those_of_the_checksum(spark):
    ids = [None, *range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("h", lang_id.held_out("doc_id"))
    assert {r["doc_id"]: r["h"] for r in df.collect()} == {i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids}
