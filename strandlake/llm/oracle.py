"""SQL of the queries that SQL can express, for the oracle.

Models, signatures and perfect hashes can't be expressed; tests/llm compares those operators with brute force. The SQL
here states the results plainly (all windows, all pairs), which is right for small tables only.
"""

from __future__ import annotations

import math
import re

from .licenses import CONTAINMENT, PHRASES, TEMPLATES

_WORDS = r"[^\x20\x09-\x0D]+"

#: Slots by MD5, 4096 to 40 shards in turn; one more shard takes the highest slots of each. The checksum is a table's
#: step for each byte; the table comes from eight shifts of each value.
SHARDING = r"""
WITH RECURSIVE shifts(b, k, v) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM shifts WHERE k < 8
), steps AS (SELECT list(v ORDER BY b) AS t FROM shifts WHERE k = 8),
bytes AS (
  SELECT doc_id, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: ('0x' || p)::BIGINT) AS x FROM documents
), summed AS (
  SELECT doc_id, 16 + coalesce(octet_length(encode(text)), 0) AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda s, c: xor(s >> 8, t[xor(s & 255, c) + 1])), 4294967295) AS text_crc32,
    (('0x' || substring(md5(coalesce(cast(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % 4096)::INTEGER AS virtual_slot
  FROM bytes, steps
), kept AS (
  SELECT range::INTEGER AS virtual_slot, (range % 40)::INTEGER AS shard, row_number() OVER (PARTITION BY range % 40 ORDER BY range) AS k FROM range(4096)
), map AS (
  SELECT virtual_slot, shard, CASE WHEN k <= 99 + CASE WHEN shard < 4096 - 99 * 41 THEN 1 ELSE 0 END THEN shard ELSE 40 END AS grown_shard FROM kept
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, (coalesce(text_crc32, 0) + size) % 16, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS slot, grown_shard, virtual_slot, sum(size) OVER (PARTITION BY virtual_slot)::BIGINT AS slot_bytes FROM summed JOIN map USING (virtual_slot)
"""

#: Every window of 13 words by its text, the smallest document of each, and the words under another one's.
SUBSTRINGS = rf"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS ws FROM documents WHERE text IS NOT NULL)
), s AS (
  SELECT *, string_agg(word, ' ') OVER f AS win, count(*) OVER f AS n FROM w WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
), least AS (SELECT win, min(doc_id) AS m FROM s WHERE n = 13 GROUP BY win),
h AS (SELECT s.doc_id, s.i, s.word, coalesce(s.n = 13 AND least.m < s.doc_id, false) AS hit FROM s LEFT JOIN least ON s.win = least.win AND s.n = 13),
c AS (SELECT doc_id, i, word, max(hit::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) = 1 AS gone FROM h),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)
"""

_REACH = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS {0}, least(a, min(b)) AS component_id FROM reach GROUP BY a)"""

#: Sets of 2-word shingles, links by counting common shingles of all pairs that share one.
MINHASH = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents WHERE text IS NOT NULL
), w AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
p AS (SELECT doc_id, n, i, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) AS two, word FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN word ELSE two END AS shingle FROM p WHERE n = 1 OR two IS NOT NULL),
z AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
sized AS (SELECT s.*, size FROM s JOIN z USING (doc_id)),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.size) AS m, any_value(y.size) AS n, count(*) AS k FROM sized x JOIN sized y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id AND 100 * x.size >= 80 * y.size AND 100 * y.size >= 80 * x.size GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * k >= 80 * (m + n - k)),
{_REACH.format("doc_id")}
SELECT doc_id, coalesce(size, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept FROM documents LEFT JOIN z USING (doc_id) LEFT JOIN least USING (doc_id)
"""

#: All pairs of vectors by cosine in double precision.
EMBEDDINGS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT vec_id, len(e) AS n, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.n = y.n AND x.vec_id <> y.vec_id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
c AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
{_REACH.format("vec_id")}
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM embeddings LEFT JOIN c USING (vec_id) LEFT JOIN least USING (vec_id)
"""

#: Units by regular expression, cuts by the hash's groups; the restored text is the text.
FIM = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle) ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Checksums of the distinct words by a table's step for each byte; all else is counting.
RESAMPLING = rf"""
WITH RECURSIVE shifts(b, k, v) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM shifts WHERE k < 8
), steps AS (SELECT list(v ORDER BY b) AS tb FROM shifts WHERE k = 8),
w AS (
  SELECT 's' AS corpus, doc_id, unnest({_PLAIN_WORDS}) AS word FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT 't', NULL, unnest({_PLAIN_WORDS}) FROM benchmark WHERE text IS NOT NULL
), x AS (SELECT word, list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda p: ('0x' || p)::BIGINT) AS x FROM (SELECT DISTINCT word FROM w)),
b AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, x), lambda s, c: xor(s >> 8, tb[xor(s & 255, c) + 1])), 4294967295) % 10000 AS bucket FROM x, steps),
counts AS (SELECT bucket, (count(*) FILTER (corpus = 's'))::DOUBLE AS s, (count(*) FILTER (corpus = 't'))::DOUBLE AS t FROM w JOIN b USING (word) GROUP BY bucket),
sums AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS g FROM counts, sums),
f AS (SELECT doc_id, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM w JOIN b USING (word) JOIN gain USING (bucket) WHERE corpus = 's' GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN f USING (doc_id)
), r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, floor(10 * count(*) OVER () / 100) AS drawn FROM d WHERE n_features >= 20)
SELECT d.doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM d LEFT JOIN r USING (doc_id)
"""


def _licenses() -> str:
    """Phrases by looking ahead, and the words of every window of a template's length, counted one by one."""
    tokens = [(i, label, w, len(words), len(set(words)), max(1, math.ceil(CONTAINMENT * len(set(words)) - 1e-9))) for i, (label, text) in enumerate(TEMPLATES) for words in [re.findall("[0-9a-z]+", text.lower())] for w in sorted(set(words))]
    values = ", ".join(f"({i}, '{label}', '{w}', {n}, {m}, {k})" for i, label, w, n, m, k in tokens)
    ahead = lambda words: " AND ".join(f"word{j or ''} = '{w}'" for j, w in enumerate(words))
    phrases = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM v WHERE {ahead(phrase.split())}" for label, phrase in PHRASES.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce({_PLAIN_WORDS}, []) AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS nw, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM d),
v AS (SELECT *, lead(word) OVER o AS word1, lead(word, 2) OVER o AS word2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
base AS ({phrases}),
tok(t, label, word, n, m, k) AS (VALUES {values}),
places AS (SELECT doc_id, t, label, m, k, word, unnest(range(greatest(0, i - n + 1), least(i, greatest(0, nw - n)) + 1)) AS s FROM w JOIN tok USING (word)),
met AS (SELECT doc_id, label, m, count(DISTINCT word) AS c FROM places GROUP BY doc_id, t, label, m, k, s HAVING count(DISTINCT word) >= k),
every AS (SELECT doc_id, label, 1.0::DOUBLE AS c, i FROM base UNION ALL SELECT doc_id, label, c::DOUBLE / m, NULL FROM met),
found AS (
  SELECT doc_id, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, array_to_string(list_sort(list_distinct(list(label) FILTER (i IS NOT NULL))), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(c) AS score FROM every GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN found USING (doc_id)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_sharding": SHARDING, "op5_substrings": SUBSTRINGS, "op7_minhash": MINHASH, "op9_embeddings": EMBEDDINGS,
    "op11_fim": FIM, "op12_resampling": RESAMPLING, "op13_licenses": _licenses(),
}
