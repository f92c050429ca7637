"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from emberlog.llm.common import LOWER, UPPER
from emberlog.llm.license_scan import NOT_WORDS, OWNER_LINE, OWNER_START, PAIRS, PARAGRAPHS, SPELLINGS
from emberlog.llm.license_texts import STATEMENTS, TEXTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lowered(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"


WORDS = "regexp_extract_all(" + lowered("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
d AS (SELECT doc_id, {WORDS} AS w FROM documents),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_KEY = lowered(r"trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
OP4 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM d),
k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM x),
r AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT k.*, r.owner IS NOT NULL AND r.owner <> doc_id AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP5 = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
e AS (SELECT vec_id, unnest(bits) AS bit, unnest(range(1, 65)) AS i FROM c),
s AS (SELECT vec_id, sum(CASE WHEN i <= 32 THEN bit * (1::BIGINT << (i - 1)) ELSE 0 END)::BIGINT AS a,
             sum(CASE WHEN i > 32 THEN bit * (1::BIGINT << (i - 33)) ELSE 0 END)::BIGINT AS b FROM e GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, s.vec_id AS neighbor_id, bit_count(xor(q.a, s.a)) + bit_count(xor(q.b, s.b)) AS distance
      FROM s q, s WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, neighbor_id, CAST(distance AS INTEGER) AS distance FROM r WHERE rank <= 10
"""

# Base 32 of the SHA-1: each digit from five bits of the hexadecimal text's bit string.
OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT hex AS h, min(page_id) AS first FROM p GROUP BY hex),
v AS (SELECT p.*, list_transform(range(0, 40), lambda i: instr('0123456789abcdef', substr(hex, CAST(i + 1 AS BIGINT), 1)) - 1) AS x FROM p),
b AS (SELECT *, array_to_string(list_transform(x, lambda n: CAST((n // 8) % 2 AS VARCHAR) || CAST((n // 4) % 2 AS VARCHAR)
             || CAST((n // 2) % 2 AS VARCHAR) || CAST(n % 2 AS VARCHAR)), '') AS bits FROM v)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
           + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b JOIN g ON b.hex = g.h
"""

_SHINGLE_WORDS = "regexp_extract_all(" + lowered("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SHINGLE_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.a = d.doc_id
"""


def _spelt(t: str, spellings: list[tuple[str, str]]) -> str:
    for spelt, like in spellings:
        t = f"replace({t}, {quoted(spelt)}, {quoted(like)})"
    return t


def _words_of_lines(t: str) -> str:
    t = _spelt(f"regexp_replace({t}, {quoted(NOT_WORDS)}, ' ', 'g')", SPELLINGS)
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda z: trim(z)), lambda z: z <> '')"


def _licence_forms(table: str, key: str, body: str) -> str:
    """key, l (lines), whole and rest of every row."""
    rest = f"array_to_string(list_filter(string_split_regex(t, {quoted(PARAGRAPHS)}), lambda p: NOT regexp_matches(p, {quoted(OWNER_START)})), chr(10))"
    pairs = lambda lines: _spelt(f"array_to_string({lines}, ' ')", PAIRS)
    return f"""SELECT {key}, list_transform(l, lambda z: {_spelt('z', PAIRS)}) AS l, {pairs('l')} AS whole, {pairs('r')} AS rest
  FROM (SELECT {key}, {_words_of_lines(f"regexp_replace(t, {quoted(OWNER_LINE)}, '', 'g')")} AS l, {_words_of_lines(rest)} AS r
        FROM (SELECT {key}, {lowered(f"coalesce({body}, '')")} AS t FROM {table}))"""


OP10 = f"""
WITH known(license_id, body) AS (VALUES {', '.join(f'({quoted(i)}, {quoted(t)})' for i, t in STATEMENTS + TEXTS)}),
kd AS ({_licence_forms('known', 'license_id', 'body')}),
k AS (SELECT t, min(license_id) AS license FROM (SELECT license_id, whole AS t FROM kd UNION ALL SELECT license_id, rest FROM kd) WHERE t <> '' GROUP BY t),
d AS ({_licence_forms('documents', 'doc_id', 'text')}),
x AS (SELECT doc_id, license FROM (SELECT doc_id, unnest(l) AS t FROM d) z JOIN k ON k.t = z.t),
y AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS ids FROM x GROUP BY doc_id)
SELECT d.doc_id, sha256(whole) AS text_sha256, coalesce(k.license, k2.license) AS license_id, coalesce(n, 0) AS n_license_lines,
       coalesce(ids, '') AS line_licenses
FROM d LEFT JOIN k ON k.t = whole LEFT JOIN k k2 ON k2.t = rest LEFT JOIN y ON y.doc_id = d.doc_id
"""



def _vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """A statement for each round: nearest entry as the least of distance * 256 + index, then floors of the means."""
    cut = f"[p * (len(q) // {parts}) + 1 : (p + 1) * (len(q) // {parts})]"
    dist = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [f"""k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)""",
             f"x AS MATERIALIZED (SELECT rid, p, q{cut} AS v FROM k, range({parts}) t(p))",
             f"s AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS e, q FROM (SELECT vec_id, min(q) AS q FROM k WHERE vec_id IS NOT NULL GROUP BY vec_id ORDER BY vec_id LIMIT {entries}))",
             f"c0 AS MATERIALIZED (SELECT p, e, q{cut} AS v FROM s, range({parts}) t(p))"]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, x.p, min({dist} * 256 + c.e) AS best FROM x JOIN c{r} c ON c.p = x.p GROUP BY rid, x.p)")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.e, coalesce(l.v, c.v) AS v FROM c{r} c LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT x.p, CAST(best % 256 AS BIGINT) AS e, i, CAST(sum(x.v[i]) AS BIGINT) AS s, count(*) AS n
      FROM x JOIN a{r} a ON a.rid = x.rid AND a.p = x.p, LATERAL (SELECT unnest(range(1, len(x.v) + 1)) AS i) GROUP BY ALL) GROUP BY p, e) l
  ON l.p = c.p AND l.e = c.e)""")
    steps.append(f"""r AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', CAST(best % 256 AS INT)), '' ORDER BY p) AS code,
  CAST(sum(best // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)""")
    steps.append(f"b AS (SELECT sha256(string_agg(CAST(n AS VARCHAR), ',' ORDER BY p, e, i)) AS digest FROM (SELECT p, e, unnest(v) AS n, unnest(range(len(v))) AS i FROM c{rounds}))")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT digest FROM b) AS codebooks_sha256
FROM k JOIN r ON r.rid = k.rid
"""


OP11 = _vector_codes()


def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(expr: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes."""
    steps = f"list_transform(regexp_extract_all(hex(encode({expr})), '..'), lambda z: CAST('0x' || z AS BIGINT))"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), "
            f"lambda c, z: xor(c >> 8, list_extract(CAST({_crc_table()} AS BIGINT[]), (xor(c, z) & 255) + 1))), 4294967295::BIGINT)")


OP12 = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, {crc32("coalesce(text, '')")} AS text_crc32,
                  md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '-')) AS h FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, size, text_crc32) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d),
r AS (SELECT *, row_number() OVER (ORDER BY (2 * place + 1) / (2 * n), h, source NULLS FIRST, size, text_crc32) - 1 AS k, count(*) OVER () AS total FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(k * 16 // total AS INT) AS shard,
       k - ((k * 16 // total) * total + 15) // 16 AS slot, CAST(NULL AS INT) AS grown_shard FROM r
"""


def _field(name: str, value: str | None = None) -> str:
    value = value or f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({value}) AS VARCHAR) || ':' || {value}, '-')"


def _merkle(levels: int = 5, over: int = 2) -> str:
    """Trees of up to 16 ** levels rows a source, and of 16 ** over sources, level by level."""
    leaf = "sha256(" + " || ".join(_field(f) for f in ("doc_id", "source", "lang", "n_chars", "text")) + ")"
    lowered_leaf = "sha256(" + " || ".join([*(_field(f) for f in ("doc_id", "source", "lang", "n_chars")), _field("text", lowered("text"))]) + ")"
    steps = [f"""d AS MATERIALIZED (SELECT doc_id, coalesce('s' || source, '-') AS g, {leaf} AS leaf, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {lowered_leaf} ELSE {leaf} END AS fold FROM documents)""",
             """f0 AS MATERIALIZED (SELECT doc_id, g, leaf, fold, '' AS proof, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY g) AS cnt FROM d)""", "n0 AS (SELECT g, pos, cnt, leaf AS h FROM f0)"]

    def climb(at: int) -> None:
        steps.append(f"r{at} AS MATERIALIZED (SELECT g, pos // 16 AS pos, (cnt + 15) // 16 AS cnt, list(h ORDER BY pos) AS hs FROM n{at} WHERE cnt > 1 GROUP BY g, pos // 16, (cnt + 15) // 16)")
        steps.append(f"n{at + 1} AS MATERIALIZED (SELECT g, pos, cnt, sha256(array_to_string(hs, '')) AS h FROM r{at} UNION ALL SELECT * FROM n{at} WHERE cnt = 1)")
        steps.append(f"""f{at + 1} AS MATERIALIZED (
  SELECT doc_id, f.g, leaf, CASE WHEN f.cnt = 1 THEN fold ELSE sha256(array_to_string(hs[:f.pos % 16] || [fold] || hs[f.pos % 16 + 2:], '')) END AS fold,
         CASE WHEN f.cnt = 1 THEN proof ELSE proof || array_to_string(hs[:f.pos % 16] || hs[f.pos % 16 + 2:], '') END AS proof,
         f.pos // 16 AS pos, (f.cnt + 15) // 16 AS cnt
  FROM f{at} f LEFT JOIN r{at} r ON r.g = f.g AND r.pos = f.pos // 16 AND f.cnt > 1)""")

    for at in range(levels):
        climb(at)
    # Roots of the sources, the null source first ('-' sorts before 's').
    steps.append(f"subs AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS cnt FROM n{levels})")
    steps.append(f"n{levels + 1} AS (SELECT 'all' AS g, pos, cnt, subroot AS h FROM subs)")
    steps.append(f"""f{levels + 1} AS MATERIALIZED (SELECT doc_id, 'all' AS g, leaf, fold, proof, s.pos, s.cnt FROM f{levels} f JOIN subs s ON s.g = f.g)""")
    for at in range(levels + 1, levels + 1 + over):
        climb(at)
    last = levels + 1 + over
    return "WITH " + ",\n".join(steps) + f"""
SELECT f.doc_id, f.leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified
FROM f{last} f JOIN n{last} n ON true JOIN (SELECT doc_id, leaf, g FROM f0) o ON o.doc_id IS NOT DISTINCT FROM f.doc_id AND o.leaf = f.leaf JOIN subs s ON s.g = o.g
"""


OP13 = _merkle()

ORACLES = {
    "op2_decontamination": OP2, "op4_line_dedup": OP4, "op5_hamming_topk": OP5, "op6_warc": OP6,
    "op9_near_duplicates": OP9, "op10_licenses": OP10, "op11_vector_codes": OP11,
    "op12_sharding": OP12, "op13_merkle_manifest": OP13,
}
