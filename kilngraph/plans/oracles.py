"""The same queries as DuckDB SQL, written from their definitions; only rule tables are shared, as data."""

from __future__ import annotations

from collections.abc import Iterable

from kilngraph.functions import fixed_values as fixed
from kilngraph.functions.rules import exact_rules, keyword_rules

ORACLES: dict[str, str] = {}


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def any_of(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {text(w)})" for w in words) + ")"


def type_case(column: str, rules: list[tuple[str, tuple[str, ...], str]], default: str | None) -> str:
    """CASE for an ordered rule table."""
    forms = {
        "contains": lambda w: any_of(column, w),
        "equals": lambda w: f"{column} IN ({', '.join(map(text, w))})",
        "suffix": lambda w: f"ends_with({column}, {text(w[0])})",
        "suffix2": lambda w: f"(ends_with({column}, {text(w[0])}) AND length({column}) > 1)",
        "longer3": lambda w: f"({any_of(column, w)} AND length({column}) > 3)",
        "sum": lambda w: f"(contains({column}, '+') AND {any_of(column, w)})",
    }
    return "CASE " + " ".join(f"WHEN {forms[kind](words)} THEN {text(result)}" for kind, words, result in rules) + f" ELSE {text(default)} END"


def word_case(column: str, table: Iterable[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, {text(w)}) THEN {text(v)}" for w, v in table) + " END"


_KEYWORDS = [(w, i, a) for words, i, a in keyword_rules() for w in words]
_KW = lambda value: "CASE " + " ".join(f"WHEN contains(relation, {text(w)}) THEN {value(w, i, a)}" for w, i, a in _KEYWORDS)
_EXACT = ", ".join(f"({text(r)}, {text(i)}, {a})" for r, i, a in exact_rules())
_NUMERIC = lambda c: f"regexp_matches({c}, '[0-9]')"
_CLASS = lambda c, linked: f"""CASE WHEN {c} = '' THEN 'invalid'
  WHEN regexp_matches({c}, '[、，,]') AND len(list_filter(regexp_split_to_array({c}, '[、，,]'), lambda p: NOT regexp_matches(p, '[0-9]'))) >= 2 THEN 'composite'
  WHEN {_NUMERIC(c)} THEN 'numerical_value' WHEN {linked} OR {any_of(c, fixed.ENTITY_WORDS)} THEN 'entity_reference' ELSE 'numerical_value' END"""  # noqa: E731

IDX = """al AS (SELECT 2 AS cat, s_name AS standard, unnest(['s' || s_suppkey, upper(s_name)]) AS alias, s_suppkey AS ord FROM supplier
  UNION ALL SELECT 4, n_name, 'N' || n_nationkey, n_nationkey FROM nation),
idx0 AS (SELECT standard AS key, standard, 0 AS kind, cat, ord FROM al UNION ALL SELECT lower(trim(alias)), standard, 1, cat, ord FROM al),
idx AS (SELECT key, standard FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY kind, cat, ord) AS n FROM idx0) WHERE n = 1)"""

RAW = """raw AS (SELECT o_orderkey AS seq,
  CASE o_custkey % 7 WHEN 0 THEN c_name || '水库' WHEN 1 THEN c_name || '水文站' WHEN 2 THEN c_name || '河' WHEN 3 THEN 'n' || n_nationkey WHEN 4 THEN c_name WHEN 5 THEN 'S' || (o_custkey % 10) ELSE c_name || '以上' END AS subject,
  CASE o_orderkey % 10 WHEN 0 THEN year(o_orderdate) || '年供水量为' WHEN 1 THEN '总库容为' WHEN 2 THEN '死水位为' WHEN 3 THEN '包括' WHEN 4 THEN '上年降水量为'
    WHEN 5 THEN '与1987~2016年均值相比径流偏少' WHEN 6 THEN 'placed by' WHEN 7 THEN '所在河流为' WHEN 8 THEN '防洪限制水位不超过' || (o_orderkey % 500) || 'm' ELSE '用水量合计总量为' END AS relation,
  CASE o_orderkey % 10 WHEN 0 THEN trunc(o_totalprice)::BIGINT || '亿m³' WHEN 1 THEN (o_orderkey % 400) || '.5亿m³' WHEN 2 THEN (o_orderkey % 3000) || 'm' WHEN 3 THEN c_mktsegment || '河、' || r_name || '区，n' || n_nationkey
    WHEN 4 THEN trunc(o_totalprice)::BIGINT || '毫米' WHEN 5 THEN (o_orderkey % 100) || '%' WHEN 6 THEN '-' WHEN 7 THEN c_mktsegment || '河' WHEN 8 THEN (o_orderkey % 500) || 'm' ELSE trunc(o_totalprice)::BIGINT || '万m³' END AS object,
  o_orderpriority AS context, 0.5::DOUBLE + (o_orderkey % 5)::DOUBLE / 10.0::DOUBLE AS confidence, 'bulletin_' || year(o_orderdate) || '.pdf' AS source_file
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

REL = f"""ex(phrase, xid, xannual) AS (VALUES {_EXACT}),
rel AS (SELECT raw.*, CASE WHEN phrase IS NOT NULL THEN xid ELSE {_KW(lambda w, i, a: text(i))} END END AS relation_id,
  CASE WHEN phrase IS NOT NULL THEN 0.99::DOUBLE WHEN {any_of('relation', [w for w, _, _ in _KEYWORDS])} THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS rel_confidence,
  CASE WHEN phrase IS NOT NULL THEN xannual ELSE {_KW(lambda w, i, a: str(a))} ELSE {any_of('relation', fixed.YEARLY_WORDS)} END END AS is_annual,
  CASE WHEN phrase IS NOT NULL THEN 'exact' ELSE {_KW(lambda w, i, a: text('keyword:' + w))} ELSE 'heuristic' END END AS rel_method
  FROM raw LEFT JOIN ex ON relation = phrase),
yr AS (SELECT *, coalesce(nullif(regexp_extract(regexp_replace(relation, '[0-9]{{4}}~[0-9]{{4}}年', '', 'g'), '([0-9]{{4}})年', 1), '')::INT,
  CASE WHEN contains(relation, '上年') THEN regexp_extract(source_file, '([0-9]{{4}})', 1)::INT - 1 END,
  CASE WHEN is_annual THEN regexp_extract(source_file, '([0-9]{{4}})', 1)::INT END) AS year FROM rel)"""

NORM = f"""sj AS (SELECT yr.*, coalesce(a.standard, b.standard, subject) AS subj, coalesce(a.standard, b.standard) IS NOT NULL AS known
  FROM yr LEFT JOIN idx a ON a.key = subject LEFT JOIN idx b ON b.key = lower(subject)),
ob AS (SELECT sj.*, CASE WHEN {_NUMERIC('object')} AND length(object) < 50 THEN object ELSE coalesce(a.standard, b.standard, object) END AS o1
  FROM sj LEFT JOIN idx a ON a.key = object LEFT JOIN idx b ON b.key = lower(object)),
oc AS (SELECT *, {_CLASS('o1', "(o1 IN (SELECT key FROM idx) OR lower(o1) IN (SELECT key FROM idx))")} AS k1 FROM ob WHERE o1 NOT IN ({', '.join(map(text, fixed.INVALID_OBJECTS))})),
pt AS (SELECT *, CASE WHEN k1 = 'composite' THEN list_filter(list_transform(regexp_split_to_array(o1, '[、，,]'), lambda p: trim(p)), lambda p: p <> '') ELSE [o1] END AS ps FROM oc),
ex2 AS (SELECT * EXCLUDE (ps), unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS part, len(ps) = 1 AS whole FROM pt),
po AS (SELECT ex2.*, CASE WHEN {_NUMERIC('p')} AND length(p) < 50 THEN p ELSE coalesce(a.standard, b.standard, p) END AS o2 FROM ex2 LEFT JOIN idx a ON a.key = p LEFT JOIN idx b ON b.key = lower(p)),
norm AS (SELECT seq, part, subj AS subject, {type_case('subj', fixed.SUBJECT_TYPES, 'Unknown')} AS subject_type, known, relation, relation_id, o2 AS object,
  CASE WHEN whole THEN k1 ELSE {_CLASS('o2', "(o2 IN (SELECT key FROM idx) OR lower(o2) IN (SELECT key FROM idx))")} END AS object_type, year, context, confidence * rel_confidence AS confidence, source_file, rel_method FROM po),
tri AS (SELECT * EXCLUDE n FROM (SELECT *, row_number() OVER (PARTITION BY subject, year, object ORDER BY regexp_matches(relation, '[0-9]{{4}}年') DESC, confidence DESC, seq, part) AS n FROM norm) WHERE n = 1)"""

_HINT = "CASE " + " ".join(f"WHEN relation_id = {text(k)} THEN {text(v)}" for k, v in fixed.LABEL_HINTS.items()) + " END"
GRAPH = f"""lab AS (SELECT *, CASE WHEN subject_type <> 'Unknown' THEN subject_type ELSE coalesce({type_case('subject', fixed.NODE_LABELS, None)}, 'Unknown') END AS s_label,
  CASE WHEN object_type = 'numerical_value' THEN CASE WHEN year IS NOT NULL THEN 'AnnualHydrologyData' ELSE 'Constraint' END
       WHEN object_type = 'entity_reference' THEN coalesce({type_case('object', fixed.NODE_LABELS, None)}, {_HINT}, 'Constraint') ELSE 'Constraint' END AS o_label FROM tri),
ends AS (SELECT *, s_label || '_' || md5(s_label || ':' || subject) AS src, o_label || '_' || md5(o_label || ':' || object) AS dst FROM lab),
men AS (SELECT seq, part, 0 AS e, src AS id, s_label AS label, subject AS name, NULL AS value, NULL::DOUBLE AS numeric_value, NULL AS unit, NULL::INT AS year, NULL AS indicator, NULL AS variable, source_file FROM ends
  UNION ALL SELECT seq, part, 1, dst, o_label, object, CASE WHEN o_label IN ('Constraint', 'AnnualHydrologyData') THEN object END,
    CASE WHEN object_type = 'numerical_value' AND year IS NULL THEN nullif(regexp_extract(object, '([0-9]+\\.?[0-9]*)', 1), '')::DOUBLE END,
    CASE WHEN object_type = 'numerical_value' THEN nullif(trim(regexp_replace(object, '[0-9.]+', '', 'g')), '') END,
    CASE WHEN object_type = 'numerical_value' THEN year END, CASE WHEN object_type = 'numerical_value' AND year IS NOT NULL THEN relation END,
    CASE WHEN object_type = 'numerical_value' AND year IS NULL THEN relation END, source_file FROM ends),
nodes AS (SELECT * EXCLUDE (seq, part, e, n) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, part, e) AS n FROM men) WHERE n = 1),
edges AS (SELECT * EXCLUDE n FROM (SELECT src, dst, relation AS rel, relation_id, year, confidence, substr(context, 1, 500) AS context, source_file AS source_doc,
  row_number() OVER (PARTITION BY src, relation, dst, year ORDER BY seq DESC, part DESC) AS n FROM ends) WHERE n = 1)"""

_L, _R, _N, _G = f"WITH {IDX}", f"WITH {IDX}, {RAW}", f"WITH {IDX}, {RAW}, {REL}, {NORM}", f"WITH {IDX}, {RAW}, {REL}, {NORM}, {GRAPH}"

# --- text ----------------------------------------------------------------------------------------------------------
_STRIP = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
_FIX = "text"
for _wrong, _right in (("there", "here"), ("the", "THE"), ("ing", "in'"), ("|", "")):
    _FIX = f"replace({_FIX}, {text(_wrong)}, {text(_right)})"
ORACLES["clean_replace"] = f"SELECT doc_id, md5({_FIX}) AS digest FROM documents"
_FIXES = "text"
for _wrong, _right in sorted(fixed.TEXT_FIXES, key=lambda p: -len(p[0])):
    _FIXES = f"replace({_FIXES}, {text(_wrong)}, {text(_right)})"
_CLEANED = lambda source: f"""(SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS t FROM (SELECT doc_id, i, {_STRIP('a[i]')} AS l FROM (SELECT doc_id, string_split({source}, chr(10)) AS a FROM documents), range(1, len(a) + 1) r(i))
  WHERE length(l) > 0 AND NOT (length(l) > 5 AND length(regexp_replace(l, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(l) < 0.1) AND NOT (length(l) < 3 AND length(regexp_replace(l, '[^\\p{{L}}\\p{{N}}]', '', 'g')) = 0) GROUP BY doc_id)"""  # noqa: E731
ORACLES["clean_lines"] = f"SELECT doc_id, coalesce(t, '') AS text FROM documents LEFT JOIN {_CLEANED('text')} USING (doc_id)"
ORACLES["clean_text"] = f"SELECT doc_id, md5(coalesce({_STRIP('replace(t, ' + text('--') + ', ' + text('—') + ')')}, '')) AS digest FROM documents LEFT JOIN {_CLEANED(_FIXES)} USING (doc_id)"
_NOISE = f"(length(text) < 10 OR len(regexp_extract_all(text, '-?[0-9]+\\.?[0-9]*')) < 2 OR length(text) < 100)"
ORACLES["noise_flag"] = f"SELECT doc_id, {_NOISE} AS is_noise, length({_STRIP('text')}) >= 20 AND NOT {_NOISE} AS keep FROM documents"
_LETTERS = lambda c: f"translate({c}, 'abcdefgh', '水库调度流域河站')"
_MIXED = f"concat_ws(chr(10), '水 库' || chr(10) || '调 度', chr(10) || chr(10) || '—— 流域--', '!!!!!!!!!!!!!!!!!!!!水', '**', 'a', {_LETTERS('text')})"
_MIXED_FIXED = _MIXED
for _wrong, _right in sorted(fixed.TEXT_FIXES, key=lambda p: -len(p[0])):
    _MIXED_FIXED = f"replace({_MIXED_FIXED}, {text(_wrong)}, {text(_right)})"
_HAN = "[\\x{4e00}-\\x{9fff}]"
_N_OF = lambda c, chars: f"len(regexp_extract_all({c}, '{chars}'))"
_CLOSED = lambda c: f"regexp_replace({c}, '({_HAN})\\s+({_HAN})', '\\1\\2', 'g')"
_MIXED_LINES = f"""(SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS t FROM (SELECT doc_id, i, {_STRIP('a[i]')} AS l FROM (SELECT doc_id, string_split({_MIXED_FIXED}, chr(10)) AS a FROM documents), range(1, len(a) + 1) r(i))
  WHERE length(l) > 0 AND NOT (length(l) > 5 AND ({_N_OF('l', _HAN)} + {_N_OF('l', '[\\p{L}\\p{N}]')}) / length(l) < 0.1) AND NOT (length(l) < 3 AND {_N_OF('l', '[\\p{L}\\p{N}]')} = 0) GROUP BY doc_id)"""
ORACLES["clean_text_mixed"] = f"SELECT doc_id, md5({_STRIP('replace(replace(' + _CLOSED(_CLOSED('t')) + ', ' + text('——') + ', ' + text('—') + '), ' + text('--') + ', ' + text('—') + ')')}) AS digest FROM {_MIXED_LINES}"
_NOISY = f"(length(t) < 10 OR ({_N_OF('t', _HAN)} = 0 AND {_N_OF('t', '-?[0-9]+\\.?[0-9]*')} < 2) OR ({_N_OF('t', _HAN)} / greatest(length({_STRIP('t')}), 1) < 0.03 AND length(t) < 100))"
ORACLES["noise_flag_mixed"] = f"""SELECT doc_id, {_NOISY} AS is_noise, length({_STRIP('t')}) >= 20 AND NOT {_NOISY} AS keep FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN {_LETTERS('text')}
  WHEN 2 THEN '短 2020 ' || doc_id WHEN 3 THEN repeat('x1 ', (doc_id % 50)::INT) || '水' ELSE translate(text, 'z', '水') END AS t FROM documents)"""
ORACLES["extract_numbers"] = "SELECT doc_id, len(n) AS n, coalesce(n[1], 0) AS first, coalesce(list_max(n), 0) AS largest FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '-?[0-9]+\\.?[0-9]*'), lambda x: x::DOUBLE) AS n FROM documents)"
ORACLES["strip_frame"] = "SELECT doc_id, CASE WHEN len(a) > 3 THEN length(array_to_string(a[2 : len(a) - 1], chr(10))) ELSE length(text) END AS n FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents)"
ORACLES["chunk_force"] = f"SELECT doc_id, md5(c) AS digest FROM (SELECT doc_id, {_STRIP('substr(text, i + 1, 500)')} AS c FROM documents, range(0, greatest(length(text), 1), 400) r(i)) WHERE c <> ''"
_TRY = lambda s: f"list_filter(list_transform(string_split(text, {s}), lambda p: {_STRIP('p')}), lambda p: p <> '')"
_SEPS = [f"chr(10) || chr(10)", "chr(10)", *map(text, fixed.SEPARATORS[2:])]
ORACLES["chunk_pieces"] = f"SELECT doc_id, generate_subscripts(ps, 1) - 1 AS pos, unnest(ps) AS piece FROM (SELECT doc_id, CASE {' '.join(f'WHEN len({_TRY(s)}) > 1 THEN {_TRY(s)}' for s in _SEPS)} END AS ps FROM documents)"
_FORCE = lambda c, size, step: f"list_filter(list_transform(range(0, greatest(length({c}), 1), {step}), lambda j: {_STRIP(f'substr({c}, j + 1, {size})')}), lambda x: x <> '')"


def chunk_sql(size: int, overlap: int) -> str:
    """ch(doc_id, chunk_index, content): the greedy fold over a text's pieces as a recursion, each step giving what it closes."""
    force = _FORCE("piece", size, size - overlap)
    return f"""WITH RECURSIVE b AS (SELECT doc_id, coalesce(text, '') AS text, CASE {' '.join(f'WHEN len({_TRY(s)}) > 1 THEN {_TRY(s)}' for s in _SEPS)} END AS ps FROM documents),
l AS (SELECT doc_id, ps FROM b WHERE length(text) > {size} AND {_STRIP('text')} <> '' AND ps IS NOT NULL),
n AS (SELECT doc_id, i, ps[i] AS piece FROM l, range(1, len(ps) + 1) r(i)),
f AS (SELECT doc_id, 1 AS i, []::VARCHAR[] AS closed, piece AS cur FROM n WHERE i = 1
  UNION ALL SELECT doc_id, i + 1,
    CASE WHEN length(cur) + length(piece) + 1 <= {size} THEN [] WHEN length(piece) > {size} THEN list_concat([cur], slices[1 : len(slices) - 1]) ELSE [cur] END,
    CASE WHEN length(cur) + length(piece) + 1 <= {size} THEN cur || chr(10) || piece WHEN length(piece) > {size} THEN slices[len(slices)] ELSE piece END
  FROM (SELECT f.doc_id, f.i, cur, piece, CASE WHEN length(piece) > {size} THEN {force} END AS slices FROM f JOIN n ON n.doc_id = f.doc_id AND n.i = f.i + 1)),
o AS (SELECT doc_id, i, unnest(closed) AS content, generate_subscripts(closed, 1) AS j FROM f WHERE len(closed) > 0
  UNION ALL SELECT doc_id, i, cur, 1000000 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS back FROM f) WHERE back = 1
  UNION ALL SELECT doc_id, 1, text, 1 FROM b WHERE length(text) <= {size} AND {_STRIP('text')} <> ''
  UNION ALL SELECT doc_id, 1, unnest(slices), generate_subscripts(slices, 1) FROM (SELECT doc_id, {_FORCE('text', size, size - overlap)} AS slices FROM b WHERE length(text) > {size} AND {_STRIP('text')} <> '' AND ps IS NULL)),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index, content FROM o)"""


_CHUNK_ID = "'chunk_' || lpad({n}::VARCHAR, greatest(4, length({n}::VARCHAR))::INT, '0') AS chunk_id"
ORACLES["chunk_merge"] = f"{chunk_sql(800, 100)} SELECT doc_id, chunk_index::INT AS chunk_index, {_CHUNK_ID.format(n='chunk_index')}, length(content) AS char_count, md5(content) AS digest FROM ch"
ORACLES["chunk_short"] = f"{chunk_sql(fixed.CHUNK_SIZE, fixed.CHUNK_OVERLAP)} SELECT doc_id, {_CHUNK_ID.format(n='chunk_index')}, length(content) AS char_count FROM ch"
ORACLES["chunk_whole"] = ORACLES["chunk_short"].replace("AS char_count FROM", "AS char_count, md5(content) AS digest FROM")
ORACLES["doc_renumber"] = f"{chunk_sql(fixed.CHUNK_SIZE, fixed.CHUNK_OVERLAP)} SELECT source, doc_id, {_CHUNK_ID.format(n='k')}, char_count FROM (SELECT source, doc_id, length(content) AS char_count, content, row_number() OVER (PARTITION BY source ORDER BY doc_id, chunk_index) - 1 AS k FROM ch JOIN documents USING (doc_id))"
ORACLES["doc_renumber_whole"] = ORACLES["doc_renumber"].replace("char_count FROM (", "char_count, md5(content) AS digest FROM (")
ORACLES["allowed_chars"] = "SELECT doc_id, md5(regexp_replace(text, '[^\\x{4e00}-\\x{9fff}\\x{3000}-\\x{303f}\\x{ff00}-\\x{ffef}\\p{L}\\p{M}\\p{Nd}\\p{Pc}\\s.,%\\-+/()\\[\\]\\x{2100}-\\x{214f}]+', '', 'g')) AS digest FROM documents"
ORACLES["table_context"] = "SELECT page_id, '来自 ' || url || ' 第' || CASE WHEN page_id % 3 > 0 THEN page_id ELSE 0 END || '页' AS context FROM pages"

# --- tables and markup ---------------------------------------------------------------------------------------------
ORACLES["html_list_items"] = f"SELECT page_id, generate_subscripts(a, 1) - 1 AS pos, {_STRIP(chr(39).join(['regexp_replace(unnest(a), ', '<[^>]+>', ', ', '', ', ', 'g', ')']))} AS item FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS a FROM pages)"
_PARTS = "SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, count(*) OVER (PARTITION BY p_brand) AS n, p_name, p_size, p_partkey FROM part"
_HEAD = "'| name | size |' || chr(10) || '| --- | --- |' || chr(10)"
ORACLES["html_table"] = f"SELECT p_brand, {_HEAD} || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY pos) AS markdown FROM ({_PARTS}) GROUP BY p_brand"
ORACLES["md_parse"] = f"SELECT p_brand, 'name¦size(mm)' AS headers, n::INT AS row_count, 2 AS col_count, pos::INT AS pos, p_name || '¦' || p_size AS cells FROM ({_PARTS})"
ORACLES["embed_units"] = f"SELECT p_brand, {_HEAD} || string_agg('| ' || p_name || ' | ' || p_size || 'mm |', chr(10) ORDER BY pos) AS markdown FROM ({_PARTS}) GROUP BY p_brand"
ORACLES["split_table"] = f"SELECT p_brand, (pos // 3)::INT AS pos, '| name | size(mm) |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY pos) AS part FROM ({_PARTS}) t GROUP BY p_brand, t.pos // 3"

# --- extraction ----------------------------------------------------------------------------------------------------
ORACLES["prompt_build"] = f"""SELECT conv_id, '<start_of_turn>system' || chr(10) || {text(fixed.CHAT_SYSTEM)} || '<end_of_turn>' || chr(10) || '<start_of_turn>user' || chr(10) || 'Extract {{"a": 1}} from: ' ||
  string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) || ' .' || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) AS prompt FROM conversations GROUP BY conv_id"""
_EVENT = "'u' || user_id AS subject, event_type AS relation, json_extract_string(props, '$.k') AS object"
ORACLES["json_parse"] = f"SELECT event_id, {_EVENT}, 0.85::DOUBLE AS confidence, 'text' AS data_type FROM events"
ORACLES["json_repair"] = f"SELECT event_id, {_EVENT} FROM events"
ORACLES["json_repair_shapes"] = f"SELECT event_id, {_EVENT}, (event_id % 4)::INT AS shape FROM events"
_TALKS = "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS page FROM conversations"
_TABLE = "'| name | size(mm) |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey, p_name, p_size::VARCHAR)"
_PAGE = "'页眉' || chr(10) || coalesce(text, '') || chr(10) || '记录' || conv_id || '第' || turn || '轮，供水量公报，水文站流域年度用水耗水统计结果登记备查' || chr(10) || '页脚'"
_SCAN = "'页眉' || chr(10) || p_brand || '材料尺寸清单，以毫米计，供各地校核登记使用' || chr(10) || '页脚'"
ORACLES["page_results"] = f"""SELECT 'conv_' || conv_id || '.json' AS source_file, page::INT AS page_num, length(plain) < 10 AS is_empty, length(plain)::INT AS char_count, 0 AS n_tables, 0 AS n_images, md5(plain) AS markdown
  FROM (SELECT conv_id, page, CASE WHEN (conv_id + turn) % 3 = 0 THEN {_PAGE} ELSE '' END AS plain FROM ({_TALKS}))
  UNION ALL SELECT p_brand || '.pdf', 1, false, length({_SCAN})::INT, 1, 1, md5({_SCAN} || chr(10) || chr(10) || {_TABLE}) FROM part GROUP BY p_brand"""
ORACLES["page_tables"] = "SELECT 'tables/' || p_brand || '.pdf' AS path, 'layout' AS method, 'tbl_p1_00' AS table_id, 1 AS page_num, 'name¦size(mm)' AS headers, count(*)::INT AS row_count, 2 AS col_count FROM part GROUP BY p_brand"
ORACLES["page_method"] = f"""SELECT 'talks/conv_' || conv_id || '.json' AS path, page::INT AS page_num, 'page' AS engine, CASE WHEN (conv_id + turn) % 3 = 0 THEN 'ocr' ELSE 'native' END AS method, false AS is_noise FROM ({_TALKS})
  UNION ALL SELECT DISTINCT 'tables/' || p_brand || '.pdf', 1, 'layout', 'layout', false FROM part"""
ORACLES["docs_to_triples"] = f"""SELECT 'conv_' || conv_id || '.json' AS source_file, page::INT AS page_num, NULL AS table_id, 'text' AS data_type, '记录' || conv_id AS subject, '2024年供水量为' AS relation, turn || '亿m³' AS object, 0.85::DOUBLE AS confidence FROM ({_TALKS})
  UNION ALL SELECT p_brand || '.pdf', 1, 'tbl_p1_00', 'tabular', p_name, '尺寸为', p_size || 'mm', 0.85::DOUBLE FROM part"""
ORACLES["limit_chunks"] = "SELECT conv_id, turn, length(text) AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations) WHERE i <= 2"

# --- linking -------------------------------------------------------------------------------------------------------
ORACLES["alias_index"] = f"{_L} SELECT key, standard FROM idx"
ORACLES["link_exact_alias"] = f"""{_R} SELECT seq, coalesce(a.standard, b.standard, subject) AS standardized, coalesce(a.standard, b.standard) IS NOT NULL AS matched,
  CASE WHEN coalesce(a.standard, b.standard) IS NULL THEN 'none' WHEN a.standard = subject THEN 'exact' ELSE 'alias' END AS method,
  CASE WHEN coalesce(a.standard, b.standard) IS NULL THEN 0.0 WHEN a.standard = subject THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence
  FROM raw LEFT JOIN idx a ON a.key = subject LEFT JOIN idx b ON b.key = lower(subject)"""
_CONF = lambda x, c: f"CASE WHEN coalesce({x}1.standard, {x}2.standard) IS NULL THEN 0.0 WHEN {x}1.standard = {c} THEN 1.0 ELSE 0.95 END::DOUBLE"
ORACLES["link_triples"] = f"""{_R} SELECT seq, coalesce(s1.standard, s2.standard, subject) AS subject, coalesce(o1.standard, o2.standard, object) AS object, subject AS original_subject,
  {_CONF('s', 'subject')} AS subject_link_confidence, {_CONF('o', 'object')} AS object_link_confidence
  FROM raw LEFT JOIN idx s1 ON s1.key = subject LEFT JOIN idx s2 ON s2.key = lower(subject) LEFT JOIN idx o1 ON o1.key = object LEFT JOIN idx o2 ON o2.key = lower(object)"""
ORACLES["link_fuzzy"] = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS e FROM v),
a AS (SELECT label AS anchor, arg_min(e, vec_id) AS ae FROM u GROUP BY label),
s AS (SELECT vec_id, anchor, list_inner_product(e, ae) AS score FROM u CROSS JOIN a)
SELECT vec_id, arg_max(anchor, score) AS best_name, round(max(score), 6) AS similarity FROM s GROUP BY vec_id"""

# --- normalisation -------------------------------------------------------------------------------------------------
ORACLES["rel_match"] = f"WITH {IDX}, {RAW}, {REL} SELECT seq, relation_id, rel_confidence, is_annual, rel_method FROM rel"
ORACLES["match_rate"] = f"""WITH {IDX}, {RAW}, {REL}, m AS (SELECT count(*) AS total, count(*) FILTER (rel_method = 'exact') AS exact, count(*) FILTER (starts_with(rel_method, 'keyword')) AS keyword, count(*) FILTER (rel_method = 'heuristic') AS unmatched FROM rel)
SELECT *, round((exact + keyword) / greatest(total, 1) * 100, 1) AS match_rate FROM m"""
ORACLES["entity_type"] = f"{_R} SELECT seq, {type_case('subject', fixed.SUBJECT_TYPES, 'Unknown')} AS type, {type_case('subject', fixed.NODE_LABELS, None)} AS label FROM raw"
ORACLES["year_extract"] = f"WITH {IDX}, {RAW}, {REL} SELECT seq, year FROM yr"
ORACLES["classify_object"] = f"{_R} SELECT seq, {_CLASS('object', 'false')} AS kind, {_NUMERIC('object')} AS numeric FROM raw"
ORACLES["normalise_triples"] = f"{_N} SELECT seq, part, subject, subject_type, relation_id, object, object_type, year, confidence, rel_method FROM norm"
ORACLES["dedupe_triples"] = f"{_N} SELECT seq, part, subject, relation, object, year, confidence FROM tri"
_NEW = ", ".join(map(text, fixed.NEW_ENTITY_TYPES))
ORACLES["norm_stats"] = f"""{_N} SELECT (SELECT count(*) FROM raw) AS total, count(*) FILTER (rel_method = 'exact') AS relations_exact, count(*) FILTER (starts_with(rel_method, 'keyword')) AS relations_keyword,
  count(*) FILTER (rel_method = 'heuristic') AS relations_unmatched, count(*) FILTER (NOT known AND subject_type IN ({_NEW})) AS entities_new, count(*) FILTER (object_type = 'numerical_value') AS objects_numerical,
  count(*) FILTER (object_type = 'entity_reference') AS objects_entity, count(*) FILTER (part > 0) AS split_added, count(*) AS normalised, (SELECT count(*) FROM tri) AS kept, count(*) - (SELECT count(*) FROM tri) AS deduplicated FROM norm"""
ORACLES["norm_report"] = f"""{_N}, d AS (SELECT 'subject_type' AS dimension, subject_type AS value FROM tri UNION ALL SELECT 'relation_id', relation_id FROM tri WHERE relation_id IS NOT NULL
  UNION ALL SELECT 'year', coalesce(year::VARCHAR, 'constant') FROM tri UNION ALL SELECT 'unmatched', relation FROM tri WHERE relation_id IS NULL),
c AS (SELECT dimension, value, count(*) AS n, row_number() OVER (PARTITION BY dimension ORDER BY count(*) DESC, value) AS rank FROM d GROUP BY dimension, value)
SELECT * FROM c WHERE dimension NOT IN ('relation_id', 'unmatched') OR rank <= 20"""

# --- graph ---------------------------------------------------------------------------------------------------------
ORACLES["graph_nodes"] = f"{_G} SELECT id, label, name, value, numeric_value, unit, year, indicator, variable, source_file FROM nodes"
ORACLES["graph_edges"] = f"{_G} SELECT * FROM edges"
ORACLES["upsert_nodes"] = """SELECT 'C' || c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_mktsegment ELSE c_mktsegment END AS value FROM customer
  UNION ALL SELECT 'S' || s_suppkey, s_name, NULL FROM supplier"""
ORACLES["upsert_edges"] = f"{_G}, k AS (SELECT id FROM nodes WHERE label <> 'River') SELECT src, rel, dst, year, CASE WHEN year IS NOT NULL AND src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) THEN 1.0 ELSE confidence END AS confidence FROM edges"
_LABELS = ", ".join(f"({text(x)})" for x in fixed.STAT_LABELS)
ORACLES["graph_stats"] = f"""{_G}, w(label) AS (VALUES {_LABELS}), c AS (SELECT w.label, count(id) AS n FROM w LEFT JOIN nodes ON nodes.label = w.label GROUP BY w.label)
SELECT * FROM c UNION ALL SELECT 'total_nodes', sum(n)::BIGINT FROM c UNION ALL SELECT 'total_edges', count(*) FROM edges"""
ORACLES["graph_stats_all"] = f"{_G} SELECT label, count(*) AS n FROM nodes GROUP BY label UNION ALL SELECT 'total_nodes', count(*) FROM nodes UNION ALL SELECT 'total_edges', count(*) FROM edges"

# --- graph queries -------------------------------------------------------------------------------------------------
ORACLES["neighbors_collect"] = f"""{_G} SELECT r.id, r.name, coalesce(string_agg(e.rel || '>' || t.label || '>' || t.name, '¦' ORDER BY e.rel || '>' || t.label || '>' || t.name), '') AS relations
  FROM nodes r LEFT JOIN edges e ON e.src = r.id LEFT JOIN nodes t ON t.id = e.dst WHERE r.label = 'Reservoir' GROUP BY r.id, r.name"""
ORACLES["linked_constraints"] = f"{_G} SELECT rel, relation_id, confidence, t.name AS t_name, t.value AS t_value FROM edges JOIN nodes t ON t.id = dst WHERE src = 'Reservoir_' || md5('Reservoir:Customer#000000007水库') AND t.label = 'Constraint'"
ORACLES["zone_names"] = f"{_G} SELECT name, id FROM nodes WHERE label = 'WaterResourceZone'"
ORACLES["name_search"] = f"{_G} SELECT id, name FROM nodes WHERE label = 'Reservoir' AND contains(name, '#00000001') ORDER BY name, id LIMIT 20"
ORACLES["pattern_facts"] = f"{_G} SELECT s.name AS entity, rel AS phrase, coalesce(o.value, o.name) AS value, e.year FROM edges e JOIN nodes s ON s.id = src JOIN nodes o ON o.id = dst WHERE contains(s.name, 'NATION_1') AND (contains(rel, '供水') OR contains(rel, '用水')) AND e.year IN (1995, 1996, 1997)"
ORACLES["pattern_shared_river"] = f"""{_G} SELECT r.name AS reservoir, s.name AS station, count(DISTINCT v.id) AS rivers FROM edges a JOIN nodes r ON r.id = a.src JOIN nodes v ON v.id = a.dst JOIN edges b ON b.dst = v.id JOIN nodes s ON s.id = b.src
  WHERE r.label = 'Reservoir' AND v.label = 'River' AND s.label = 'HydrologicalStation' AND contains(a.rel, '所在河流') AND contains(b.rel, '所在河流') GROUP BY r.name, s.name"""
ORACLES["pattern_reachable"] = """SELECT 'S' || s_suppkey AS supplier, 'R' || n_regionkey AS place, 2 AS e1_hops FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT 'S' || s_suppkey, 'W', 3 FROM supplier"""
_KEYWORDS = "k AS (SELECT n_name AS keyword FROM nation UNION SELECT r_name FROM region UNION SELECT c_mktsegment FROM customer UNION SELECT right(c_name, 3) FROM customer UNION SELECT right(s_name, 2) FROM supplier UNION SELECT right(s_name, 1) FROM supplier UNION SELECT right(c_name, 2) || '水' FROM customer)"
ORACLES["substring_search"] = f"{_G}, {_KEYWORDS} SELECT keyword, count(*) AS n, min(name) AS first_name FROM nodes JOIN k ON contains(name, keyword) GROUP BY keyword"
ORACLES["label_scan"] = f"{_G} SELECT id, name FROM nodes WHERE label = 'HydrologicalStation' ORDER BY name, id LIMIT 50"
ORACLES["reservoir_list"] = f"{_G} SELECT r.id, r.name, o.name AS neighbour FROM nodes r LEFT JOIN (SELECT src, n.name FROM edges JOIN nodes n ON n.id = dst WHERE n.label = 'River') o ON o.src = r.id WHERE r.label = 'Reservoir' ORDER BY r.name, r.id, o.name NULLS FIRST LIMIT 200"
_SERIES = lambda where, cols, most: f"{_G} SELECT {cols} FROM edges e JOIN nodes s ON s.id = e.src JOIN nodes d ON d.id = e.dst WHERE e.year IS NOT NULL AND d.label = 'AnnualHydrologyData' AND {where} ORDER BY e.year DESC, s.id, e.rel, d.value LIMIT {most}"
ORACLES["entity_series"] = _SERIES("s.label = 'HydrologicalStation' AND contains(e.rel, '供水')", "s.name AS s_name, e.year, e.rel AS indicator, d.value, d.unit", 100)
ORACLES["zone_series"] = _SERIES("s.label = 'WaterResourceZone' AND e.year = 1997", "s.name AS s_name, e.year, e.rel AS indicator, d.value", 500)
ORACLES["triple_search"] = f"{_G} SELECT s.name AS subject, rel AS predicate, o.name AS object, confidence FROM edges JOIN nodes s ON s.id = src JOIN nodes o ON o.id = dst WHERE contains(s.name, 'NATION_7') OR contains(o.name, 'NATION_7') ORDER BY confidence DESC NULLS FIRST, src, rel, dst LIMIT 50"
ORACLES["trace_document"] = f"{_G} SELECT s.name AS subject, rel AS predicate, o.name AS object, confidence, context FROM edges JOIN nodes s ON s.id = src JOIN nodes o ON o.id = dst WHERE source_doc = 'bulletin_1996.pdf' ORDER BY 1, 2, 3 LIMIT 100"
ORACLES["shortest_path"] = """WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b, 'belongs to' AS rel FROM nation UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'located in' FROM customer UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'located in' FROM supplier UNION ALL SELECT 'R' || r_regionkey, 'W', 'part of' FROM region),
u AS (SELECT a, b, rel FROM e UNION SELECT b, a, rel FROM e),
hub AS (SELECT * FROM u WHERE (a NOT LIKE 'C%' OR a = 'C1') AND (b NOT LIKE 'C%' OR b = 'C1') AND (a NOT LIKE 'S%' OR a = 'S2') AND (b NOT LIKE 'S%' OR b = 'S2')),
p AS (SELECT 'C1' AS head, ['C1'] AS nodes, []::VARCHAR[] AS rels, 0 AS depth UNION ALL SELECT b, list_append(nodes, b), list_append(rels, rel), depth + 1 FROM p JOIN hub ON a = head WHERE depth < 6 AND NOT list_contains(nodes, b)),
f AS (SELECT * FROM p WHERE head = 'S2')
SELECT array_to_string(nodes, '>') AS nodes, array_to_string(rels, '>') AS rels, depth FROM f WHERE depth = (SELECT min(depth) FROM f) ORDER BY nodes, rels LIMIT 5"""
_CIDS = ", ".join(text(x) for ids in fixed.CONSTRAINT_IDS.values() for x in ids)
ORACLES["constraints_union"] = f"""{_G}, r AS (SELECT id FROM nodes WHERE label = 'Reservoir')
SELECT src, rel, relation_id, t.label AS t_label, t.name AS t_name, e.year FROM edges e JOIN r ON r.id = src JOIN nodes t ON t.id = dst
WHERE (t.label = 'Constraint' AND (relation_id IN ({_CIDS}) OR (relation_id IS NULL AND {any_of('rel', fixed.CONSTRAINT_WORDS)}))) OR (t.label = 'AnnualHydrologyData' AND (relation_id IN ({_CIDS}) OR (relation_id IS NULL AND {any_of('rel', fixed.ANNUAL_WORDS)})))"""
_LAST = lambda rid: f"arg_max(t.value, (rel, dst)) FILTER (relation_id = {text(rid)})"
ORACLES["params_pivot"] = f"""{_G} SELECT src, {_LAST('DEAD_STORAGE_LEVEL')} AS dead_storage_level, {_LAST('NORMAL_STORAGE_LEVEL')} AS normal_storage_level, {_LAST('FLOOD_CONTROL_LEVEL')} AS flood_control_level, {_LAST('TOTAL_CAPACITY')} AS total_capacity, {_LAST('FLOOD_CONTROL_CAPACITY')} AS flood_control_capacity
FROM edges JOIN nodes t ON t.id = dst WHERE t.label = 'Constraint' AND relation_id IN ({', '.join(map(text, fixed.PARAMETER_IDS))}) GROUP BY src"""
_RAIN = ", ".join(map(text, fixed.INDICATOR_IDS["降水"]))
ORACLES["series_fallback"] = f"""{_G}, fact AS (SELECT src, e.year, rel, d.value FROM edges e JOIN nodes d ON d.id = dst WHERE e.year IS NOT NULL AND d.label = 'AnnualHydrologyData' AND relation_id IN ({_RAIN})),
own AS (SELECT r.id AS entity, NULL AS station, fact.year, rel, fact.value FROM nodes r JOIN fact ON src = r.id WHERE r.label = 'Reservoir'),
place AS (SELECT src, dst AS via FROM edges JOIN nodes v ON v.id = dst WHERE relation_id = 'LOCATED_ON' AND v.label = 'River'),
far AS (SELECT DISTINCT a.src AS entity, b.src AS station, fact.year, rel, fact.value FROM place a JOIN nodes r ON r.id = a.src AND r.label = 'Reservoir' JOIN place b ON b.via = a.via JOIN nodes s ON s.id = b.src AND s.label = 'HydrologicalStation' JOIN fact ON fact.src = b.src
  WHERE a.src NOT IN (SELECT entity FROM own)),
u AS (SELECT DISTINCT * FROM own UNION ALL SELECT * FROM far)
SELECT entity, station, year, value FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY year, rel, value, station) AS n FROM u) WHERE n <= 10"""
ORACLES["upstream_pairs"] = """SELECT 'S' || a.s_suppkey AS upstream, 'S' || b.s_suppkey AS downstream FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey AND b.s_suppkey = (a.s_suppkey * 7 + 3) % 50"""
ORACLES["batch_relations"] = """SELECT 'S' || a.s_suppkey AS from_id, a.s_name AS from_name, 'S' || b.s_suppkey AS to_id, b.s_name AS to_name, 'upstream' AS relation FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey AND b.s_suppkey = (a.s_suppkey * 7 + 3) % 50"""

# --- formulation ---------------------------------------------------------------------------------------------------
_PHRASES = "['汛限水位不超过', '死水位不低于', '总库容为', '下泄流量不小于', '出力上限', '生态流量', '供水量保证']"
_UNITS = "['m', 'm', '亿m³', 'm³/s', '万kW', '', '亿m³']"
_SIGNS = "['<=', '>=', '==', '>=', '<=', NULL, '>=']"
_PUBLISHED = "['<=', '<=', '==', '<=', '<=', NULL, '>=']"
_CATS = "['water_level', 'water_level', 'storage', 'discharge', 'power_output', 'discharge', 'water_supply']"
_PC = f"""pc AS (SELECT p_brand AS entity, p_partkey AS ord, {_PHRASES}[p_partkey % 7 + 1] AS relation, {_UNITS}[p_partkey % 7 + 1] AS unit, coalesce({_SIGNS}[p_partkey % 7 + 1], 'unknown') AS operator,
  {_CATS}[p_partkey % 7 + 1] AS category, p_name AS name, p_size::DOUBLE AS value FROM part)"""
ORACLES["categorize"] = f"WITH {_PC} SELECT ord, category FROM pc"
ORACLES["operator_parse"] = f"SELECT p_partkey AS ord, {_SIGNS}[p_partkey % 7 + 1] AS meant, {_PUBLISHED}[p_partkey % 7 + 1] AS published FROM part"
ORACLES["value_unit"] = f"WITH {_PC} SELECT ord, value, nullif(unit, '') AS unit FROM pc"
_EXPR = "concat_ws(' ', relation, operator, value::VARCHAR, nullif(unit, ''))"
ORACLES["constraint_records"] = f"WITH {_PC} SELECT entity, 'c_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS id, name, {_EXPR} AS expression, category, relation AS variable, operator, value, unit FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ord) AS n FROM pc)"
_BND = f"""{_PC}, eq AS (SELECT entity, category, max(ord) FILTER (operator = '==') AS k FROM pc GROUP BY entity, category),
bd AS (SELECT entity, category, max(value) FILTER ((operator = '>=' AND (k IS NULL OR ord > k)) OR ord = k) AS lower, min(value) FILTER ((operator = '<=' AND (k IS NULL OR ord > k)) OR ord = k) AS upper FROM pc JOIN eq USING (entity, category) GROUP BY entity, category)"""
ORACLES["bounds"] = f"WITH {_BND} SELECT * FROM bd"
_PAR = "pa AS (SELECT p_brand AS entity, min(p_size)::DOUBLE AS dead, max(p_size)::DOUBLE AS normal, count(*) + 0.5::DOUBLE AS capacity FROM part GROUP BY p_brand)"
ORACLES["parameters"] = f"WITH {_PAR} SELECT entity, dead, normal, capacity, '亿m³' AS unit, NULL::DOUBLE AS flood FROM pa"
_VARS = ", ".join(f"({text(c)}, {text(n)}, {text(s)}, {text(u)})" for c, n, s, u in fixed.VARIABLES)
_DV = f"{_BND}, {_PAR}, vr(category, vname, symbol, vunit) AS (VALUES {_VARS}), dv AS (SELECT entity, vname, symbol, vunit AS unit, CASE WHEN category = 'water_level' THEN coalesce(lower, dead) ELSE lower END AS lower, CASE WHEN category = 'water_level' THEN coalesce(upper, normal) ELSE upper END AS upper FROM bd JOIN vr USING (category) JOIN pa USING (entity))"
ORACLES["decision_vars"] = f"WITH {_DV} SELECT entity, symbol, unit, lower, upper FROM dv"
_OBJ = ", ".join(f"({text(c)}, {text(d)}, {text(t)})" for c, d, t in fixed.OBJECTIVES)
ORACLES["objectives"] = f"WITH {_PC}, ob(category, description, direction) AS (VALUES {_OBJ}) SELECT DISTINCT entity, description, direction FROM pc JOIN ob USING (category)"
_BR = "br AS (SELECT p_brand AS entity, row_number() OVER (ORDER BY p_brand) AS i FROM part GROUP BY p_brand)"
ORACLES["solver_variables"] = f"WITH {_DV}, {_BR} SELECT symbol || '_' || i AS symbol, 'name of ' || entity || '_' || vname AS name, lower, upper, unit FROM dv JOIN br USING (entity)"
_SYM = "CASE " + " ".join(f"WHEN category = {text(c)} THEN {text(s)}" for c, _, s, _ in fixed.VARIABLES) + " END"
ORACLES["solver_constraints"] = f"""WITH {_PC}, {_PAR}, {_BR} SELECT concat_ws(' ', {_SYM} || '_' || i, operator, value::VARCHAR, nullif(unit, '')) AS expression, category AS type, name AS description FROM pc JOIN br USING (entity) WHERE operator <> 'unknown'
UNION ALL SELECT 'Z_' || i || ' >= ' || dead, 'water_level', 'name of ' || entity || ' 死水位约束' FROM pa JOIN br USING (entity)"""
_CMP = lambda b: f"max(shown) FILTER (entity = 'Brand#{b}') AS \"name of Brand#{b}\""
ORACLES["compare_pivot"] = f"""WITH {_PAR}, l AS (SELECT entity, unnest(['死水位', '正常蓄水位', '防洪限制水位', '总库容', '防洪库容']) AS parameter, unnest([dead || 'm', normal || 'm', NULL, capacity || '亿m³', NULL]) AS shown FROM pa)
SELECT parameter, {", ".join(map(_CMP, range(1, 26)))} FROM l GROUP BY parameter"""

_RULES = "ru AS (SELECT p_brand AS entity, p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN '规则' || p_size ELSE p_name END AS content, CASE WHEN p_partkey % 3 = 0 THEN p_size::INT::VARCHAR ELSE '' END AS period FROM part)"
ORACLES["dispatch_rules"] = f"WITH {_RULES} SELECT entity, string_agg(name || '|' || content || '|' || period || '|', '¦' ORDER BY name, content, period) AS dispatch_rules FROM ru GROUP BY entity"
ORACLES["solver_series"] = """WITH c AS (SELECT c_nationkey, c_mktsegment AS indicator, year(o_orderdate) AS y, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT 'N' || n_nationkey AS entity, n_name AS name, indicator, string_agg(y || '|' || n || '|件', '¦' ORDER BY y) AS entries FROM c JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"""
ORACLES["solver_hints"] = f"WITH {_PC}, ob(category, description, direction) AS (VALUES {_OBJ}) SELECT DISTINCT direction || '_' || description AS hint FROM pc JOIN ob USING (category)"
_SHIPPED = "(SELECT p_brand AS entity, year(l_shipdate) AS y, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"
_N_CONS = "(SELECT count(*) FROM pc WHERE operator <> 'unknown') + (SELECT count(*) FROM pa)"
ORACLES["solver_document"] = f"""WITH {_DV}, {_BR}, ob(category, description, direction) AS (VALUES {_OBJ}) SELECT (SELECT count(*) FROM dv)::INT AS n_variables, ({_N_CONS})::INT AS n_constraints, (SELECT count(DISTINCT entity) FROM {_SHIPPED} WHERE y = 1996)::INT AS n_entities,
  (SELECT string_agg(DISTINCT direction || '_' || description, '¦' ORDER BY direction || '_' || description) FROM pc JOIN ob USING (category)) AS hints, (SELECT count(*) FROM br) AS reservoir_count, ({_N_CONS})::INT AS constraint_count, '1996' AS years"""
ORACLES["solver_document_parts"] = f"""WITH {_DV}, {_BR}, lines AS (
  SELECT 'variable' AS part, concat_ws('|', symbol || '_' || i, 'name of ' || entity || '_' || vname, coalesce(lower::VARCHAR, '-'), coalesce(upper::VARCHAR, '-'), coalesce(unit, '-')) AS line FROM dv JOIN br USING (entity)
  UNION ALL SELECT 'constraint', concat_ws('|', concat_ws(' ', {_SYM} || '_' || i, operator, value::VARCHAR, nullif(unit, '')), category, name) FROM pc JOIN br USING (entity) WHERE operator <> 'unknown'
  UNION ALL SELECT 'constraint', 'Z_' || i || ' >= ' || dead || '|water_level|name of ' || entity || ' 死水位约束' FROM pa JOIN br USING (entity)
  UNION ALL SELECT 'series', 'name of ' || entity || '|出货量|' || y || '|' || n || '|件' FROM {_SHIPPED} WHERE y = 1996)
SELECT part, line, count(*) AS n FROM lines GROUP BY part, line"""
ORACLES["formulation_nested"] = f"""WITH {_DV}, {_RULES}, ob(category, description, direction) AS (VALUES {_OBJ}), rk(category, vname, symbol, vunit, rank) AS (VALUES {', '.join(f'({text(c)}, {text(n)}, {text(s)}, {text(u)}, {i})' for i, (c, n, s, u) in enumerate(fixed.VARIABLES))}),
cr AS (SELECT entity, 'c_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') AS id, {_EXPR} AS expression, category FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY ord) AS n FROM pc)),
c AS (SELECT entity, string_agg(id || '|' || expression || '|' || category, '¦' ORDER BY id) AS constraints FROM cr GROUP BY entity),
v AS (SELECT entity, string_agg(concat_ws('|', symbol, lower::VARCHAR, upper::VARCHAR), '¦' ORDER BY rank) AS decision_variables FROM dv JOIN rk USING (symbol) GROUP BY entity),
o AS (SELECT entity, string_agg(description || '|' || direction, '¦' ORDER BY description, direction) AS objective_candidates FROM (SELECT DISTINCT entity, description, direction FROM pc JOIN ob USING (category)) GROUP BY entity),
t AS (SELECT entity, count(*)::INT AS n_series FROM {_SHIPPED} GROUP BY entity), r AS (SELECT entity, count(*)::INT AS n_rules FROM ru GROUP BY entity)
SELECT entity, 'name of ' || entity AS name, constraints, coalesce(decision_variables, '') AS decision_variables, coalesce(objective_candidates, '') AS objective_candidates, capacity, n_series, n_rules
FROM c LEFT JOIN v USING (entity) LEFT JOIN o USING (entity) JOIN pa USING (entity) LEFT JOIN t USING (entity) LEFT JOIN r USING (entity)"""

# --- questions and training ----------------------------------------------------------------------------------------
ORACLES["nlq_answer"] = f"""{_G}, f AS (SELECT s.name AS entity, rel, coalesce(o.value, o.name) AS value, e.year FROM edges e JOIN nodes s ON s.id = src JOIN nodes o ON o.id = dst
  WHERE contains(s.name, 'NATION_7') AND contains(rel, '供水') AND e.year = 1997 ORDER BY e.year DESC, entity, rel, value LIMIT 20),
n AS (SELECT *, row_number() OVER (ORDER BY year DESC, entity, rel, value) AS i FROM f)
SELECT CASE WHEN count(*) = 0 THEN '未找到与「1997年NATION_7供水多少？」相关的数据，请尝试换个问法。' ELSE string_agg('• ' || entity || '(' || year || '年) | ' || rel || ' | ' || value, chr(10) ORDER BY i) FILTER (i <= 8) || CASE WHEN count(*) > 8 THEN chr(10) || '... 共 ' || count(*) || ' 条结果' ELSE '' END END AS answer, count(*) AS n_rows FROM n"""
_ASKED = """w(name) AS (VALUES ('供水'), ('供水量'), ('降水'), ('库容'), ('总库容'), ('位')),
qs AS (SELECT c_custkey, (c_custkey % 8 + 1992)::VARCHAR || '年' || c_name || ['水库', '水文站', '河', ''][c_custkey % 4 + 1] || '的' || ['供水量', '降水量', '总库容', '水位', '别的'][c_custkey % 5 + 1] || '是多少？2001' AS text FROM customer),
en AS (SELECT c_custkey, name, row_number() OVER (PARTITION BY c_custkey ORDER BY length(name) DESC, name) AS r FROM qs JOIN (SELECT DISTINCT name FROM nodes WHERE name <> '') x ON contains(text, name)),
ind AS (SELECT c_custkey, name, row_number() OVER (PARTITION BY c_custkey ORDER BY length(name) DESC, name) AS r FROM qs JOIN w ON contains(text, name)),
sl AS (SELECT qs.c_custkey, en.name AS entity, ind.name AS indicator, c_custkey % 8 + 1992 AS year FROM qs LEFT JOIN (SELECT * FROM en WHERE r = 1) en USING (c_custkey) LEFT JOIN (SELECT * FROM ind WHERE r = 1) ind USING (c_custkey))"""
ORACLES["question_slots"] = f"{_G}, {_ASKED} SELECT c_custkey, entity, indicator, year::VARCHAR || ',2001' AS years FROM sl"
ORACLES["question_facts"] = f"""{_G}, {_ASKED} SELECT c_custkey, entity, rel AS phrase, coalesce(o.value, o.name) AS value, e.year FROM sl JOIN nodes s ON s.name = entity JOIN edges e ON e.src = s.id JOIN nodes o ON o.id = e.dst
  WHERE (sl.indicator IS NULL OR contains(rel, sl.indicator)) AND e.year IN (sl.year, 2001) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY e.year DESC NULLS LAST, rel, coalesce(o.value, o.name)) <= 20"""
ORACLES["conversation_mentions"] = """WITH w AS (SELECT DISTINCT name FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM benchmark) WHERE length(name) >= 6),
m AS (SELECT conv_id, turn, name FROM conversations JOIN w ON contains(text, name)), b AS (SELECT conv_id, turn, name AS mention FROM m QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name) DESC, name) = 1)
SELECT conv_id, turn, mention FROM conversations LEFT JOIN b USING (conv_id, turn)"""
ORACLES["nlq_empty"] = "SELECT '未找到与「2090年NATION_7供水多少？」相关的数据，请尝试换个问法。' AS answer, 0::BIGINT AS n_rows"
ORACLES["training_examples"] = f"""SELECT event_id, '<start_of_turn>system' || chr(10) || {text(fixed.CHAT_SYSTEM)} || '<end_of_turn>' || chr(10) || '<start_of_turn>user' || chr(10) || 'event ' || event_id || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10)
  || '[{{"subject":"u' || user_id || '","relation":"' || event_type || '","object":"' || json_extract_string(props, '$.k') || '"}}]<end_of_turn>' AS example FROM events"""
ORACLES["response_mask"] = """WITH t AS (SELECT item_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS a FROM benchmark),
s AS (SELECT item_id, a, coalesce(list_min(list_filter(range(1, len(a)), lambda i: a[i] = 2 AND a[i + 1] = 3)) + 1, -1) AS resp_start FROM t)
SELECT item_id, resp_start::INT AS resp_start, array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN resp_start < 0 OR i <= resp_start THEN -100 ELSE a[i] END), '¦') AS labels FROM s"""
