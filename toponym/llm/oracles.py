"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_CONTROL = r"(<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>)"
# each control string gets two more characters, each backslash one
_LONG = "length(regexp_replace(replace({0}, '\\', '\\\\'), '" + _CONTROL + "', '\\1--', 'g'))"

OP2 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM
  (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + {_LONG.format("role")} + 1 + {_LONG.format("text")} + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_WORDS = "list_filter(string_split_regex({0}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
e AS (SELECT doc_id, unnest(g) AS t FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s sx ON sx.doc_id = x JOIN s sy ON sy.doc_id = y WHERE 100 * c >= 90 * (len(sx.g) + len(sy.g) - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS to_id FROM s UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.to_id)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = s.doc_id
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 5
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS keeper, strlen(body) >= 1000 AS large FROM p)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest, CASE WHEN large AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN large AND page_id <> keeper THEN keeper END AS refers_to FROM k
"""

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
g AS (SELECT doc_id, unnest(range(len(ws) - 19)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i : i + 19], ' ')))) AS h FROM d WHERE len(ws) >= 20),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range(20) r(k)),
m AS (SELECT w.doc_id, w.i, w.word, gone.i IS NOT NULL AS cut FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i),
a AS (SELECT doc_id, count(*) AS n_words, CAST(sum(cut::INT) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT cut), '') AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON a.doc_id = d.doc_id
"""

# crc32 of UTF-8 bytes by its polynomial, eight steps for each byte
_STEP = "CASE WHEN {0} % 2 = 1 THEN xor({0} // 2, 3988292384) ELSE {0} // 2 END"

OP11 = f"""
WITH tab AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i::BIGINT, 0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: {_STEP.format("c")}) AS c FROM range(256) r(i))),
words AS (SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents
  UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) FROM benchmark),
bytes AS (SELECT w, list_transform(range(strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT w FROM words)),
crcs AS (SELECT w, CAST(xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c // 256, crc[CAST(xor(c, x) % 256 + 1 AS INT)])), 4294967295) % 10000 AS INT) AS bucket FROM bytes, tab),
f AS (SELECT kind, id, bucket FROM words JOIN crcs USING (w)),
counts AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
sums AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS total FROM f JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY id),
h AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - (total % n + n) % n) // n ELSE 0 END AS weight,
  ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM documents LEFT JOIN sums ON id = doc_id),
sc AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM h),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS held FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN place <= held * 10 // 100 THEN place END AS rank FROM sc LEFT JOIN r ON r.doc_id = sc.doc_id
"""

OP13 = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, g.keeper IS NOT NULL AND g.keeper <> doc_id AS gone FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""

SQL = {"op2_chat_format": OP2, "op5_ngram_jaccard": OP5, "op6_bit_sliced": OP6, "op7_warc": OP7, "op8_substring_dedup": OP8, "op11_importance_resampling": OP11, "op13_line_dedup": OP13}
