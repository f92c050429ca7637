"""Operators 2, 4, 9 and 10 against brute force on small tables."""

import hashlib
import random
import re
import textwrap
from collections import defaultdict

import pytest

from emberlog.llm import decontaminate, license_scan, line_dedup, near_dup
from emberlog.llm.license_texts import FILES, TEXTS
from emberlog.llm.setsketch import merge, most_likely, registers, shingle_set

DOCS = "doc_id long, text string, n_lines string, extra int"


def docs_df(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 0) for i, t in rows], DOCS)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# -- line dedup


def brute_lines(rows, min_docs=2):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < min_docs
                or i == min(held[key(x)], key=lambda v: (v is None, v or 0))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, min_docs):
    rng = random.Random(3)
    common = [f"Common line number {k} É" for k in range(5)]
    rows = [(i, "\n".join(rng.choice([*common, "short", "", " \t" + common[0].upper() + "\r", prose(rng, 4)]) for _ in range(rng.randint(1, 8))))
            for i in range(40)]
    rows += [(None, common[0] + "\n" + common[1]), (50, None), (51, ""), (52, common[0] + "\n" + common[0]), (53, "x" * 30000)]
    rows += [rows[7]]  # a repeated row
    got = line_dedup.drop_repeated_lines(docs_df(spark, rows), min_docs=min_docs)
    assert got.columns == ["doc_id", "text", "extra", "kept_text", "n_lines", "n_dropped"]
    assert sorted([(r["doc_id"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()], key=str) == brute_lines(rows, min_docs)


# -- decontamination


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c.isascii() and (c.isdigit() or c.islower()) or ord(c) > 127 else " " for c in low).split(" ")


def brute_contamination(rows, items):
    windows = defaultdict(set)
    for i, t in items:
        w = [x for x in words(t) if x]
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add(None if i is None else str(i))
    out = []
    for i, t in rows:
        w = [x for x in words(t) if x]
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        found.discard(None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_contamination_with_short_and_repeated_items(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice([13, 14, 20, 40]), 60)) for k in range(12)]
    items += [(20, "ÉTÉ one"), (21, "Single"), (22, ""), (23, None), (24, items[0][1]), (None, items[1][1]), (25, prose(rng, 12, 60)), (10, items[3][1])]
    rows = []
    for i in range(60):
        passage = (rng.choice(items)[1] or "").split()
        a = rng.randrange(len(passage) + 1)
        rows.append((i, prose(rng, rng.randrange(40), 60) + " -- " + " ".join(passage[a:a + 30]).upper() + "; " + prose(rng, rng.randrange(20), 60)))
    rows += [(70, None), (71, ""), (72, items[0][1]), (None, items[0][1]), rows[3], (73, "single ÉtÉ ONE"), (74, " ".join([items[2][1]] * 40))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs_df(spark, rows), bench)
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got.collect()],
                  key=str) == brute_contamination(rows, items)
    clean = decontaminate.clean_documents(docs_df(spark, rows), bench)
    assert clean.columns == ["doc_id", "text", "n_lines", "extra"]
    assert clean.count() == sum(not r[-1] for r in brute_contamination(rows, items))


def test_contamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", 0)
    rng = random.Random(5)
    items = [(k, prose(rng, 20)) for k in range(3)]
    rows = [(1, items[0][1]), (2, prose(rng, 50))]
    got = decontaminate.contamination(docs_df(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["contaminated"] for r in got.collect()} == {1: True, 2: False}


# -- near duplicates


def test_sketch_estimates_and_merges():
    a, b = shingle_set(" ".join(f"a{i}" for i in range(3000))), shingle_set(" ".join(f"a{i}" for i in range(300, 3300)))
    ra, rb = registers(a), registers(b)
    estimate = most_likely(len(a), len(b), (ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum())
    assert abs(float(estimate) - 2696 / 3296) < 0.12
    import numpy as np

    assert (merge(ra, rb) == registers(np.union1d(a, b))).all()


def brute_groups(rows):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", w) if x]
        return frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted([(i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets], key=str)


@pytest.mark.parametrize("few", [8, 0])
def test_near_duplicate_chains_and_groups(spark, monkeypatch, few):
    monkeypatch.setattr(near_dup, "FEW", few)
    rng = random.Random(6)
    rows, base = [], prose(rng, 150, 5000).split()
    for i in range(60):  # copies of copies: links that the hub does not have
        text = list(base)
        for _ in range(rng.randint(0, 6)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
        if i % 3 == 0:
            base = text
    rows += [(100 + i, prose(rng, rng.randint(1, 60), 5000)) for i in range(20)]
    rows += [(200, "one two"), (201, "ONE\ttwo"), (202, None), (203, ""), (204, " \n"), (None, rows[0][1]), rows[5], (205, rows[5][1]), (206, "É a b c d e"), (207, "é a b c d e")]
    got = near_dup.groups_of(docs_df(spark, rows))
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute_groups(rows)


def test_near_duplicates_dropped_keeps_columns(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (2, "other words here at last now")]
    out = near_dup.near_duplicates_dropped(docs_df(spark, rows))
    assert out.columns == ["doc_id", "text", "n_lines", "extra"]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2]


# -- licences


def test_license_scan(spark):
    mit = dict(TEXTS)["MIT"].replace("<year> <copyright holders>", "1999 Somebody").replace("MIT License", "mit LICENCE")
    rows = [(1, mit), (2, "text\nReleased under the MIT licence!\nCopyright (c) 2001 Me\nlicensed under CC-BY-NC 4.0\n"), (3, None), (4, ""),
            (5, "Copyright 2020 Me"), (None, "Released under the MIT License."), (2, "x"), (2, "x"), (6, "The MIT License is fine.")]
    got = {(r["doc_id"], r["license_id"], r["n_license_lines"], r["line_licenses"]) for r in license_scan.scan(docs_df(spark, rows)).collect()}
    assert license_scan.scan(docs_df(spark, rows)).count() == len(rows)
    assert got == {(1, "MIT", 0, ""), (2, None, 2, "CC-BY-NC-4.0,MIT"), (3, None, 0, ""), (4, None, 0, ""), (5, None, 0, ""),
                   (None, "MIT", 1, "MIT"), (2, None, 0, ""), (6, None, 0, "")}


def rewrapped(text: str, width: int, crlf: bool = False) -> str:
    paragraphs = re.split(r"\n[ \t]*\n", text)
    out = "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in paragraphs)
    return out.replace("\n", "\r\n") if crlf else out


def test_line_breaks_of_a_whole_text_do_not_count(spark):
    names = {f.stem for f in FILES.glob("*.txt")} | {"MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Unlicense"}
    texts = {}
    for name, text in TEXTS:
        texts.setdefault(name, text)
    rows = [(name, rewrapped(texts[name], width, width == 72)) for name in sorted(names) for width in (50, 60, 72, 100, 10**9)]
    rows += [("Apache-2.0", texts["Apache-2.0"].replace("copyright owner", "copyright\nowner")),
             ("Apache-2.0", texts["Apache-2.0"].replace("copyright owner", "Copyright  Owner")),
             ("Apache-2.0", "Copyright 2001 A\nCopyright (C) 2002 B\n\n" + texts["Apache-2.0"]),
             # A line of prose that starts with "copyright" is no owner's, so it counts.
             (None, texts["Apache-2.0"] + "\ncopyright law applies\n")]
    got = license_scan.scan(docs_df(spark, [(k, t) for k, (_, t) in enumerate(rows)])).orderBy("doc_id").collect()
    missed = [(i, k) for k, ((i, _), r) in enumerate(zip(rows, got, strict=True)) if r["license_id"] != i]
    assert not missed


def test_spellings_at_the_ends_of_texts_and_lines(spark):
    known = spark.createDataFrame([("L1", "You shall fulfil."), ("L2", "Ask the copyright holder"), ("L3", "ten percent, non-commercial")],
                                  "license_id string, text string")
    rows = [(1, "you shall FULFILL"), (2, "ask the\ncopyright\n  owner"), (3, "Ten per cent\nnoncommercial"), (4, "x\nask the copyright  owner!\n"),
            (5, "(c) ask the copyright owner"), (6, "\n\n\n\n"), (7, "©"), (8, "Copyright (c)\n\nask the copyright owner")]
    got = {r["doc_id"]: (r["license_id"], r["line_licenses"]) for r in license_scan.scan(docs_df(spark, rows), known).collect()}
    assert got == {1: ("L1", "L1"), 2: ("L2", ""), 3: ("L3", ""), 4: (None, "L2"), 5: (None, ""), 6: (None, ""), 7: (None, ""), 8: ("L2", "L2")}


def test_whole_texts_of_long_licenses_and_of_a_table(spark, tmp_path):
    own = tmp_path / "known"
    spark.createDataFrame([("LicenseRef-own", "Use it\nas you like.")], "license_id string, text string").write.parquet(str(own))
    bsd = next(t for i, t in TEXTS if i == "BSD-3-Clause").replace("<year>, <copyright holders>", "2020 Somebody")
    rows = [("BSD-3-Clause", bsd), ("BSD-3-Clause", bsd.replace("Somebody", "Somebody\nAll rights reserved."))]
    rows += [(f.stem, f.read_text(encoding="utf-8").upper()) for f in sorted(FILES.glob("*.txt"))]
    rows += [("LicenseRef-own", "use it as you like"), (None, bsd.replace("endorse", "praise"))]
    assert {i for i, _ in rows} >= {"Apache-2.0", "MPL-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "LGPL-3.0-only", "CC0-1.0"}
    out = license_scan.scan(docs_df(spark, [(k, t) for k, (_, t) in enumerate(rows)]), license_scan.known_licenses(spark, str(own)))
    assert [r["license_id"] for r in out.orderBy("doc_id").collect()] == [i for i, _ in rows]


def test_empty_tables(spark):
    none = docs_df(spark, [])
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert line_dedup.drop_repeated_lines(none).count() == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert not decontaminate.contamination(docs_df(spark, [(1, "a b c")]), bench.limit(0)).first()["contaminated"]
    assert near_dup.groups_of(none).count() == 0
    assert license_scan.scan(none).count() == 0
