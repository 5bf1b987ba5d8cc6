"""What SQL can say of the queries' results, for DuckDB."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

LOWER = f"translate(coalesce(text,''), '{ascii_uppercase}', '{ascii_lowercase}')"
SPACED = r"'[^\x20\x09-\x0D]+'"
SYMBOLS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.b, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT a, min(b) AS b FROM r GROUP BY 1) m ON m.a = w.doc_id"""

OP5 = f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, {SYMBOLS}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, {SYMBOLS}) AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[i:i + 9], ' ') AS x FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT m FROM i),
p AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS x FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, k)),
h AS MATERIALIZED (SELECT doc_id, p.m, i, item_id FROM p JOIN i USING (x) WHERE p.m = i.m),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP6 = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM (VALUES (0), (1)) v(x))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(15 + length(regexp_replace(role, '[\\#<:\n]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

OP8 = """SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id < k THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id < k THEN k END AS refers_to
FROM (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS k FROM pages)"""

#: Sources are capped in turns; each turn shares what is left among those not capped yet.
OP10 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {SPACED})) AS BIGINT) AS size, CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
s AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY 1),
g AS (SELECT 0 AS turn, no, n, CASE no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, false AS capped, sum(n) OVER ()::BIGINT AS total FROM s
UNION ALL SELECT turn + 1, no, n, w, capped OR (total - coalesce(sum(3 * n) FILTER (capped) OVER (), 0)) * w > 3 * n * coalesce(sum(w) FILTER (NOT capped) OVER (), 0), total FROM g WHERE turn < 60),
t AS MATERIALIZED (SELECT no, n, total, CASE WHEN capped THEN CAST(3 * n AS DOUBLE) ELSE CAST(((total - coalesce(sum(3 * n) FILTER (capped) OVER (), 0)) * w) AS DOUBLE) / CAST(sum(w) FILTER (NOT capped) OVER () AS DOUBLE) END AS target FROM g WHERE turn = 60),
q AS (SELECT d.*, t.*, sum(size) OVER (PARTITION BY t.no ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS queued FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source JOIN t ON t.no = s.no),
e AS (SELECT doc_id, size, no, key, e, total, CAST(e * n + queued AS DOUBLE) / target AS f FROM q, (VALUES (0), (1), (2)) v(e) WHERE size > 0 AND target > 0),
c AS (SELECT doc_id, size, sum(size) OVER (ORDER BY f, no, key, doc_id, size, e ROWS UNBOUNDED PRECEDING) <= total AS ok FROM e WHERE f <= 2)
SELECT q.doc_id, q.size, q.n AS source_size, q.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN (SELECT doc_id, sum(size) AS taken FROM c WHERE ok GROUP BY 1) x ON x.doc_id = q.doc_id"""

#: Products of 64 components, added up in the order in which the operator does: eight running sums, then these by pairs.
_SUMS = [" + ".join(f"a.v[{8 * i + j + 1}] * b.v[{8 * i + j + 1}]" for i in range(8)) for j in range(8)]
_PRODUCT = "((({0}) + ({1})) + (({2}) + ({3}))) + ((({4}) + ({5})) + (({6}) + ({7})))".format(*_SUMS)
OP7 = f"""WITH e AS MATERIALIZED (SELECT DISTINCT vec_id, v FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
WHERE len(v) = 64 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, max({_PRODUCT}) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20"""

ORACLE_SQL = {"op2_jaccard_join": OP2, "op5_decontaminate": OP5, "op6_chat_format": OP6, "op7_ann": OP7, "op8_warc": OP8, "op10_mixing": OP10}
