"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .chat import OP2_SQL, op2_chat_format
from .decontam import op6_decontamination
from .hidden import op13_hidden_markov
from .html_text import op9_html_text
from .langid import op10_language_id
from .manifest import op12_merkle_manifest
from .neardup import op1_ngram_jaccard
from .prefixes import op11_prefix_trie
from .quality import op4_quality
from .substrings import op7_substring_dedup
from .toxicity import op3_toxicity
from .wordpack import op8_simple8b

QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard, op2_chat_format, op3_toxicity, op4_quality, op5_byte_bpe, op6_decontamination, op7_substring_dedup, op8_simple8b, op9_html_text, op10_language_id, op11_prefix_trie, op12_merkle_manifest, op13_hidden_markov)
}
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i : least(i + 4, len(w))], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 5 * c >= 4 * (x.n + y.n - c) UNION SELECT x.r, y.r FROM d x JOIN d y ON x.text = y.text AND x.r <> y.r),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, c.class_id, coalesce(l.n, 0) AS n_links FROM d
JOIN (SELECT reach.a, min(x.doc_id) AS class_id FROM reach JOIN d x ON x.r = reach.b GROUP BY reach.a) c ON c.a = d.r
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = d.r
"""

_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i) WHERE len(w) > 0),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM d, (SELECT DISTINCT k FROM bw), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i) WHERE len(w) >= k),
hits AS (SELECT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON bw.k = dw.k AND bw.g = dw.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) WHERE len(w) >= 35),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
starts AS (SELECT r, i FROM win SEMI JOIN twice USING (g)),
words AS (SELECT r, i, w[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
marked AS (SELECT r, i, word, max(CASE WHEN s.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM words LEFT JOIN starts s USING (r, i)),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM marked GROUP BY r)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

#: crc32 of a decimal number's digits, by the byte table of the polynomial 0xEDB88320.
_CRC_TABLE = "crc AS (SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(b)))"


def _crc(digits: str) -> str:
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({digits}, ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, ts, {_crc('CAST(conv_id AS VARCHAR)')} % 6 AS h FROM own, crc),
rebuilt AS (SELECT h.conv_id, list_concat(coalesce(b.ts[1 : h], []), h.ts[h + 1 : len(h.ts)]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
member AS (SELECT conv_id, d, ts[1 : d] AS p, len(ts) = d AS is_end FROM rebuilt, LATERAL (SELECT unnest(range(len(ts) + 1)) AS d)),
node AS (SELECT p, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE is_end), '') AS ends,
    CASE WHEN any_value(d) > 0 THEN (count(*) - 1) * length(any_value(p[d].text)) ELSE 0 END AS own FROM member GROUP BY p),
kids AS (SELECT p[1 : d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
sub AS (SELECT a.p[1 : j] AS p, sum(own) AS saved, count(*) FILTER (WHERE k.p IS NULL) AS leaves FROM node a LEFT JOIN kids k ON k.p = a.p, LATERAL (SELECT unnest(range(a.d + 1)) AS j) GROUP BY 1)
SELECT x.conv_id, x.d AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM node x JOIN sub s ON s.p = x.p LEFT JOIN kids k ON k.p = x.p LEFT JOIN node u ON x.d > 0 AND u.d = x.d - 1 AND u.p = x.p[1 : x.d - 1]
"""

_FIELDS = " || ".join(f"CASE WHEN {f} IS NULL THEN '-' ELSE octet_length(encode(CAST({f} AS VARCHAR))) || ':' || {f} END" for f in ("doc_id", "source", "lang", "n_chars"))
_TEXT_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0})) || ':' || {0} END"

OP12_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
rows AS (SELECT doc_id, source, sha256({_FIELDS} || {_TEXT_FIELD.format('text')}) AS leaf,
    CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN sha256({_FIELDS} || {_TEXT_FIELD.format("replace(text, chr(10), '')")}) END AS tampered FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, tampered NULLS FIRST) - 1 AS i FROM rows),
inner_tree(source, k, j, h, n) AS (
  SELECT source, 0, i, leaf, count(*) OVER (PARTITION BY source) FROM leaves
  UNION ALL
  SELECT source, max(k) + 1, j // 3, sha256(string_agg(h, '' ORDER BY j)), (max(n) + 2) // 3 FROM inner_tree WHERE n > 1 GROUP BY source, j // 3),
subroots AS (SELECT source, h, k AS depth, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM inner_tree WHERE n = 1),
top_tree(k, j, h, n) AS (
  SELECT 0, i, h, n FROM subroots
  UNION ALL
  SELECT max(k) + 1, j // 3, sha256(string_agg(h, '' ORDER BY j)), (max(n) + 2) // 3 FROM top_tree WHERE n > 1 GROUP BY j // 3),
tree AS (SELECT source, k AS step, j, h FROM inner_tree WHERE n > 1 UNION ALL SELECT source, depth + k, j, x.h FROM top_tree x, subroots WHERE x.n > 1),
numbered AS (SELECT row_number() OVER () AS r, d.*, s.depth, s.i AS rank, s.h AS subroot FROM leaves d JOIN subroots s ON s.source IS NOT DISTINCT FROM d.source),
up(r, source, depth, rank, step, j, own) AS (
  SELECT r, source, depth, rank, 0, CASE WHEN depth = 0 THEN rank ELSE i END, coalesce(tampered, leaf) FROM numbered
  UNION ALL
  SELECT u.r, any_value(u.source), max(u.depth), max(u.rank), max(u.step) + 1, max(CASE WHEN u.step + 1 = u.depth THEN u.rank ELSE u.j // 3 END), sha256(string_agg(CASE WHEN x.j = u.j THEN u.own ELSE x.h END, '' ORDER BY x.j))
  FROM up u JOIN tree x ON x.source IS NOT DISTINCT FROM u.source AND x.step = u.step AND x.j // 3 = u.j // 3 GROUP BY u.r),
folded AS (SELECT r, arg_max(own, step) AS own FROM up GROUP BY r),
beside AS (SELECT u.r, string_agg(x.h, '' ORDER BY x.step, x.j) AS proof FROM up u JOIN tree x ON x.source IS NOT DISTINCT FROM u.source AND x.step = u.step AND x.j // 3 = u.j // 3 AND x.j <> u.j GROUP BY u.r)
SELECT doc_id, leaf, subroot, (SELECT h FROM top_tree WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256, own AS folded_root, own = (SELECT h FROM top_tree WHERE n = 1) AS verified
FROM numbered JOIN folded USING (r) LEFT JOIN beside USING (r)
"""

SQL = {"op1_ngram_jaccard": OP1_SQL, "op2_chat_format": OP2_SQL, "op6_decontamination": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
