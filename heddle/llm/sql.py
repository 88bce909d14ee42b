"""DuckDB SQL for the training-data queries that SQL can express, over the whole tables."""

from __future__ import annotations

from . import quality

OP3 = r"""
WITH RECURSIVE
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(r.b, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(r.b, s.doc_id)) AS kept
FROM sets s LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) r ON r.a = s.doc_id
"""

OP7 = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM t
"""

# The checksum goes over the bytes with the usual table; the deal is one step for each slot.
OP9 = """
WITH RECURSIVE
crcs AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))),
raw AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)) AS b FROM documents),
recs AS (
  SELECT doc_id, size, xor(list_reduce(b, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM raw, crcs),
rows AS (
  SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || text_crc32), 1, 8))::BIGINT % 4096)::INTEGER AS virtual_slot FROM recs),
loads AS (
  SELECT s.slot, coalesce(sum(size), 0)::BIGINT AS bytes, row_number() OVER (ORDER BY coalesce(sum(size), 0) DESC, s.slot) AS k
  FROM range(4096) s(slot) LEFT JOIN rows ON virtual_slot = s.slot GROUP BY s.slot),
deal(k, slot, shard, total) AS (
  SELECT 0::BIGINT, -1::BIGINT, -1, list_transform(range(16), lambda x: 0::BIGINT)
  UNION ALL
  SELECT l.k, l.slot, (list_position(d.total, list_min(d.total)) - 1)::INTEGER,
    list_transform(d.total, lambda x, i: CASE WHEN i = list_position(d.total, list_min(d.total)) THEN x + l.bytes ELSE x END)
  FROM deal d JOIN loads l ON l.k = d.k + 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  NULL::INTEGER AS grown_shard, virtual_slot, 1 AS map_version
FROM rows JOIN deal ON deal.slot = virtual_slot
"""


def op4() -> str:
    """Counts, the two references and the distances; one regular expression for the characters outside of each class."""
    outside = ["[^a-z]", "[^A-Z]", r"[\x00-\x7f]", "[^0-9]", r"[^\x00-\x09\x0b-\x20]", r"[^\n]", "[^.,;:?''\"()-]", "[\\n\\x00-\\x20.,;:?''\"()a-zA-Z0-9\\x80-\\x{10ffff}-]"]
    classes = ", ".join(f"length(regexp_replace(t, '{c}', '', 'g'))" for c in outside)
    common = ", ".join(f"({lang}, {k + 1}, '{w}')" for lang, words in enumerate(quality.COMMON.values()) for k, w in enumerate(words))
    width, n = max(map(len, quality.COMMON.values())), len(outside)

    def reference(where: str = "") -> str:
        return f"""SELECT lang, list(c ORDER BY k) AS c, list(w ORDER BY k) AS w FROM (
    SELECT lang, k, avg(classes[k] / list_sum(classes)) AS c, avg(hist[k] / n_words) AS w
    FROM counted, range(1, {width + 2}) r(k) WHERE NOT base_failed{where} GROUP BY lang, k) GROUP BY lang"""

    def distance(p: str, q: str, length: int) -> str:
        def term(a, b):
            return f"CASE WHEN {a}[k] > 0 THEN {a}[k] * log2({a}[k] / (({a}[k] + {b}[k]) / 2)) ELSE 0 END"

        return f"sqrt(greatest(list_sum(list_transform(range(1, {length + 1}), lambda k: ({term(p, q)} + {term(q, p)}) / 2)), 0))"

    def shares(col: str) -> str:
        return f"list_transform({col}, lambda x: x / greatest(list_sum({col}), 1))"

    return rf"""
WITH
texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS id FROM documents),
spread AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
triples AS (SELECT id, i, count(*) OVER (PARTITION BY id, word, w2, w3) AS n FROM (
  SELECT id, i, word, lead(word) OVER o AS w2, lead(word, 2) OVER o AS w3 FROM spread WINDOW o AS (PARTITION BY id ORDER BY i)) WHERE w3 IS NOT NULL),
again AS (SELECT id, count(DISTINCT i + k) AS n FROM triples, range(3) r(k) WHERE n > 1 GROUP BY id),
lines AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id),
common(lang, k, word) AS (VALUES {common}),
hits AS (SELECT id, lang, k, count(*) AS n FROM spread JOIN common c ON length(spread.word) <= 8 AND c.word = rtrim(lower(spread.word), '.,;:!?') GROUP BY id, lang, k),
spoken AS (SELECT id, arg_max(lang, n * 10 - lang) AS lang FROM (SELECT id, lang, sum(n) AS n FROM hits GROUP BY id, lang) GROUP BY id),
hists AS (SELECT h.id, map_from_entries(list((h.k, h.n))) AS m FROM hits h JOIN spoken s ON s.id = h.id AND s.lang = h.lang GROUP BY h.id),
counted AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_prepend(n_words - coalesce(list_sum(found), 0), found) AS hist FROM (
  SELECT x.id, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, coalesce(s.lang, 0) AS lang, [{classes}] AS classes,
    list_transform(range(1, {width} + 1), lambda k: coalesce(m[k], 0)) AS found
  FROM texts x LEFT JOIN again a ON a.id = x.id LEFT JOIN lines l ON l.id = x.id LEFT JOIN spoken s ON s.id = x.id LEFT JOIN hists h ON h.id = x.id)),
shares AS (SELECT *, {shares('classes')} AS pc, {shares('hist')} AS pw FROM counted),
ref1 AS ({reference()}),
near AS (SELECT s.id FROM shares s JOIN ref1 r ON r.lang = s.lang WHERE {distance('pc', 'r.c', n)} < {quality.NEAR}),
ref2 AS ({reference(' AND id IN (SELECT id FROM near)')}),
refs AS (SELECT l.lang, coalesce(b.c, a.c, list_transform(range({n}), lambda x: 0.0)) AS c, coalesce(b.w, a.w, list_transform(range({width + 1}), lambda x: 0.0)) AS w FROM range({len(quality.LANGS)}) l(lang) LEFT JOIN ref1 a ON a.lang = l.lang LEFT JOIN ref2 b ON b.lang = l.lang),
far AS (SELECT s.*, {distance('pc', 'r.c', n)} AS class_distance, {distance('pw', 'r.w', width + 1)} AS word_distance FROM shares s JOIN refs r ON r.lang = s.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND class_distance <= {quality.CLASS_LIMIT} AND (n_words < {quality.MIN_WORDS} OR word_distance <= {quality.WORD_LIMIT}) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM far
"""
