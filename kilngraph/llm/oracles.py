"""DuckDB SQL for the queries that SQL can express; each text stands on its own."""

from __future__ import annotations

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = f"""
WITH d AS (SELECT doc_id, {FOLD} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

OP9 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS a FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(a)) AS size, array_to_string(a[i : i + least(13, len(a)) - 1], ' ') AS gram
       FROM b, range(1, greatest(len(a) - 13, 0) + 2) r(i) WHERE len(a) > 0),
dw AS (SELECT doc_id, i, s.size, array_to_string(a[i : i + s.size - 1], ' ') AS gram
       FROM w, (SELECT DISTINCT size FROM bw) s, range(1, len(a) - s.size + 2) r(i) WHERE len(a) >= s.size),
hits AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, gram)),
marks AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, size FROM hits), range(i, i + size) r(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hits GROUP BY doc_id)
SELECT w.doc_id, len(a)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(a) AS contaminated
FROM w LEFT JOIN marks USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP5 = r"""
WITH l AS (SELECT doc_id, i AS line_no, a[i] AS line, lower(a[i]) AS low
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents), range(1, len(a) + 1) r(i)),
c AS (SELECT low, min((doc_id, line_no)) AS pl, list_distinct(regexp_extract_all(low, '[^\x20\x09-\x0D]+')) AS words FROM l
      WHERE regexp_matches(low, '[^\x20\x09-\x0D]') GROUP BY low),
k AS (SELECT row_number() OVER (ORDER BY pl) AS c, low, pl, len(words) AS n, words FROM c),
w AS (SELECT c, n, unnest(words) AS w FROM k),
p AS (SELECT x.c AS a, y.c AS b, x.n AS n_a, y.n AS n_b, count(*) AS shared FROM w x JOIN w y ON x.w = y.w AND x.c < y.c
      AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) GROUP BY ALL),
gone AS (SELECT DISTINCT b FROM p WHERE 9 * shared >= 4 * (n_a + n_b)),
s AS (SELECT pl.doc_id, pl.line_no FROM (SELECT {'doc_id': pl[1], 'line_no': pl[2]} AS pl FROM k WHERE c NOT IN (SELECT b FROM gone))),
f AS (SELECT l.*, s.line_no IS NOT NULL OR NOT regexp_matches(low, '[^\x20\x09-\x0D]') AS stays FROM l LEFT JOIN s USING (doc_id, line_no))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (stays), '') AS text FROM f GROUP BY doc_id
"""

OP6 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
bits AS (SELECT page_id, string_agg(lpad(bin(('0x' || hex[i])::INT), 4, '0'), '' ORDER BY i) AS s FROM h, range(1, 41) r(i) GROUP BY page_id),
b32 AS (SELECT page_id, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(('0b' || s[5 * i + 1 : 5 * i + 5])::INT) + 1], '' ORDER BY i) AS payload_digest
        FROM bits, range(0, 32) r(i) GROUP BY page_id),
top AS (SELECT hex, max(page_id) AS top_id FROM h GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top_id THEN top_id END AS refers_to
FROM h JOIN b32 USING (page_id) JOIN top USING (hex)
"""

OP7 = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations),
p AS (SELECT conv_id, pos, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY pos) AS chat,
             count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
f AS (SELECT chat, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n_turns GROUP BY chat, n_turns)
SELECT conv_id, n_turns, n_copies, chat FROM f
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = f.n_turns AND p.chat = f.chat)
"""


OP1 = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({FOLD}, '[^\x20\x09-\x0D]+') AS a FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, hash(CASE WHEN len(a) = 1 THEN a[1] ELSE a[i] || ' ' || a[i + 1] END) AS g FROM d, range(1, greatest(len(a), 2)) t(i) WHERE len(a) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
w AS MATERIALIZED (SELECT s.r, s.g, n.n FROM s JOIN n ON n.r = s.r),
p AS MATERIALIZED (SELECT x.r AS a, y.r AS b FROM w x JOIN w y ON x.g = y.g AND x.r < y.r AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
      GROUP BY x.r, y.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
e AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
c(r, other) AS (SELECT r, r FROM d UNION SELECT c.r, e.b FROM c JOIN e ON e.a = c.other)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id, d.doc_id = min(o.doc_id) AS kept
FROM d JOIN c ON c.r = d.r JOIN d o ON o.r = c.other LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""

OP12 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({FOLD}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(a) AS term FROM d) GROUP BY lang, source, term),
v AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
k AS MATERIALIZED (SELECT c.lang, c.source, c.term, c.n FROM c JOIN v ON c.lang = v.lang AND c.term = v.term),
l AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM v GROUP BY lang),
gk AS (SELECT lang, source, sum(n) AS total FROM k GROUP BY lang, source),
g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(gk.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN gk ON d.lang = gk.lang AND d.source = gk.source),
p AS MATERIALIZED (SELECT g.lang, g.source, v.term, coalesce(k.n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 2)) // (g.total + 2 * l.terms)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (v.n + 2)) // (l.total + 2 * l.terms)::HUGEINT AS q
      FROM g JOIN l ON g.lang = l.lang JOIN v ON v.lang = g.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = v.term),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
e AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
t AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM e
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INTEGER AS rank FROM t) WHERE rank <= 10
"""


def _op11() -> str:
    """Four rounds over four part positions, written out; components are doubles that hold whole numbers, so sums and products are exact."""
    steps = []
    for n in range(5):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT vec_id, p, v, d.e AS e, d.d AS d FROM (
  SELECT x.vec_id, x.p, x.v, min({{'d': x.s - 2 * list_dot_product(x.v, b.v) + b.s, 'e': b.e}}) AS d FROM x JOIN b{n} b ON x.p = b.p GROUP BY x.vec_id, x.p, x.v))""")
        if n < 4:
            steps.append(f"""m{n} AS (SELECT p, e, i, floor(sum(w) / count(*)) AS w FROM (SELECT p, e, unnest(range(len(v))) AS i, unnest(v) AS w FROM a{n}) GROUP BY p, e, i),
n{n} AS (SELECT p, e, list(w ORDER BY i) AS v FROM m{n} GROUP BY p, e),
b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.v, b.v) AS v, list_dot_product(coalesce(n.v, b.v), coalesce(n.v, b.v)) AS s FROM b{n} b LEFT JOIN n{n} n ON b.p = n.p AND b.e = n.e)""")
    return f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
     WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
q AS (SELECT vec_id, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS v FROM k, (SELECT unnest(range(4)) AS p)),
x AS MATERIALIZED (SELECT vec_id, p, v, list_dot_product(v, v) AS s FROM q),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k),
b0 AS MATERIALIZED (SELECT x.p, o.e, x.v, x.s FROM x JOIN o ON x.vec_id = o.vec_id WHERE o.e < 256),
{", ".join(steps)},
r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(w::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(range(len(v))) AS i, unnest(v) AS w FROM b4))
SELECT k.vec_id, r.code, r.error, (sum(r.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, h.codebooks_sha256
FROM k JOIN r ON k.vec_id = r.vec_id, h
"""


OP11 = _op11()


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1, "op3_exact_dedup": OP3, "op5_line_dedup": OP5, "op6_warc": OP6, "op7_chat_format": OP7, "op9_decontamination": OP9, "op11_vector_codes": OP11, "op12_source_divergence": OP12}
