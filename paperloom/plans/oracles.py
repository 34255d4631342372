"""The same rows in DuckDB's SQL, from the rules and not from the Spark code."""

from __future__ import annotations


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def lines(x: str) -> str:
    return rf"list_transform(regexp_split_to_array({x}, '\r\n|\n|\r'), lambda l: {strip('l')})"


def upper(x: str) -> str:
    return f"(upper({x}) = {x} AND lower({x}) <> {x})"


def heading(x: str) -> str:
    return f"""coalesce(list_filter({lines(x)}, lambda h: length(h) BETWEEN 3 AND 80 AND ({upper("h")} OR
      ({upper("substr(h, 1, 1)")} AND len(list_filter(regexp_split_to_array(h, '\\s+'), lambda u: u <> '')) <= 8)))[1], '')"""


CHUNKS = f"""
pages AS (SELECT source AS filename, doc_id AS page_num, {words("text")} AS w, {heading("text")} AS heading FROM documents),
starts AS (SELECT filename, page_num, w, heading, unnest(range(0, greatest(0, len(w) - 81) + 1, 320)) AS st FROM pages WHERE len(w) > 0),
chunks AS (SELECT filename, page_num, CAST(st // 320 AS INTEGER) AS chunk_seq, filename || ' - Page ' || page_num AS source, 'text' AS chunk_type,
  CASE WHEN heading <> '' THEN 'Section: ' || heading || chr(10) ELSE '' END || array_to_string(list_slice(w, st + 1, st + 400), ' ') AS text FROM starts),
numbered AS (SELECT row_number() OVER (ORDER BY filename, page_num, chunk_seq) - 1 AS chunk_id, * FROM chunks)"""

WHOLE = """whole AS (SELECT doc_id AS chunk_id, source AS filename, doc_id AS page_num, source || ' - Page ' || doc_id AS source, text FROM documents)"""


def bm25(unit: str) -> str:
    """tok, idf (term, df, idf) and scored (query_id, chunk_id, score) over the units of a table with chunk_id, text."""
    return f"""
tok AS (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM (SELECT chunk_id, {words("lower(text)")} AS t FROM {unit})),
corpus AS (SELECT count(*) AS n, avg(len({words("lower(text)")})) AS avgdl FROM {unit}),
posting AS (SELECT chunk_id, term, any_value(len) AS len, count(*) AS tf FROM tok GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM posting, corpus GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({words("lower(text)")}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))) AS score
  FROM asked JOIN idf USING (term) JOIN posting USING (term), corpus GROUP BY ALL)"""


def top(name: str, source: str, n: int, rule: str) -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) - 1 AS INTEGER) AS rank0
  FROM {source}) WHERE rank0 < {n} AND {rule})"""


VEC = """
vec AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
unit AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM vec)"""
DENSE_BY_ID = """
near AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(q.u, v.u), 9) AS score FROM unit q, unit v WHERE q.vec_id % 20 = 0)"""
DENSE_BY_ITEM = """
near AS (SELECT item_id AS query_id, v.vec_id AS chunk_id, round(list_dot_product(q.u, v.u), 9) AS score FROM benchmark JOIN unit q ON q.vec_id = item_id, unit v)"""


def hybrid(name: str, n: int) -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, chunk_id) - 1 AS INTEGER) AS rank0 FROM (
  SELECT coalesce(d.query_id, x.query_id) AS query_id, coalesce(d.chunk_id, x.chunk_id) AS chunk_id, coalesce(d.score, 0.0) AS distance,
    coalesce(1.0 / CAST(61.0 + d.rank0 AS DOUBLE), 0.0) + coalesce(1.0 / CAST(61.0 + x.rank0 AS DOUBLE), 0.0) AS rrf
  FROM dense d FULL OUTER JOIN lex x ON d.query_id = x.query_id AND d.chunk_id = x.chunk_id)) WHERE rank0 < {n})"""


def fold(hits: str, columns: str, same: str, last: int) -> str:
    """Keep-first folding, one rank a step: hits has query_id, rank0, h (a struct)."""
    return f"""
hs AS (SELECT query_id, list(h ORDER BY rank0) AS hs FROM {hits} GROUP BY query_id),
steps AS (SELECT query_id, hs, 1 AS k, [hs[1]] AS kept FROM hs
  UNION ALL
  SELECT query_id, hs, k + 1, CASE WHEN len(list_filter(kept, lambda p: {same.replace("$h", "hs[k + 1]")})) > 0 THEN kept ELSE list_append(kept, hs[k + 1]) END
  FROM steps WHERE k < len(hs) AND k < {last})
SELECT query_id, r.rank0 AS rank0, r.chunk_id AS chunk_id FROM (SELECT query_id, unnest(kept) AS r FROM steps WHERE k = len(hs))"""


WINDOWS = r"""
hits AS (SELECT l.query_id, l.rank0, c.* FROM lex l JOIN numbered c USING (chunk_id)),
marked AS (SELECT *, regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '^([0-9]+\.[0-9]+\s+[A-Z]|[A-Z\s]{10,}$|[0-9]+\s+[A-Z]|APPENDIX\s+[A-Z0-9]|TABLE\s+[0-9]+|FIGURE\s+[0-9]+)') AS edge FROM numbered),
peers AS (SELECT chunk_id, source, text, count(*) OVER (PARTITION BY source) AS n,
  lag(CASE WHEN NOT edge THEN text END) OVER w AS b, lead(CASE WHEN NOT edge THEN text END) OVER w AS f FROM marked WINDOW w AS (PARTITION BY source ORDER BY chunk_id)),
joined AS (SELECT chunk_id, source, text, n, concat_ws(' ', b, text, f) AS j FROM peers),
cut AS (SELECT *, string_split(CASE WHEN length(j) > 2000 THEN substr(j, 1, 2000) || '...' ELSE j END, '. ') AS ss FROM joined),
keyed AS (SELECT *, list_transform(ss, lambda s: substr(regexp_replace(s, '^\s+|\s+$', '', 'g'), 1, 60)) AS ks FROM cut),
windows AS (SELECT source, text, arg_min(CASE WHEN n > 1 THEN array_to_string(list_filter(ss, lambda s, i: list_position(ks, ks[i]) = i), '. ') ELSE text END, chunk_id) AS win FROM keyed GROUP BY source, text),
shown AS (SELECT h.*, w.win FROM hits h JOIN windows w ON h.source = w.source AND h.text = w.text)"""

SAID = "said AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant'))"

PARTS = r"""
p AS (SELECT *, CAST(p_partkey // 6 AS INTEGER) AS block FROM part),
r AS (SELECT block, p_partkey, p_type, CASE WHEN p_partkey % 4 = 0 THEN ['', NULL, ' ', ''] ELSE [CAST(p_partkey AS VARCHAR),
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE ' ' || p_brand || chr(10) || 'x' END,
  CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE CAST(p_size AS VARCHAR) END] END AS row FROM p),
b AS (SELECT block, list(row ORDER BY p_partkey) AS rows, min(p_type) AS kind, CASE block % 4 WHEN 0 THEN ['Key', 'Name', 'Brand', 'Size']
  WHEN 1 THEN ['Key', '', NULL, 'Size'] WHEN 2 THEN ['Key', ' ', 'Brand', 'Key'] ELSE ['', 'Name', '', ''] END AS header FROM r GROUP BY block),
t AS (SELECT 'file' || (block % 5) AS filename, block AS page_num, block % 2 AS table_idx, header, rows, kind,
  concat_ws(chr(10), 'Some prose about parts.', CASE WHEN block % 3 = 0 THEN '  Table ' || block || ' ' || kind END, CASE WHEN block % 6 = 0 THEN 'Figure ' || block || ' Second caption' END,
    CASE WHEN block % 2 = 0 THEN 'NOTES: first note' END, CASE WHEN block % 2 = 0 THEN 'second note of ' || kind END, 'END OF NOTES', 'More prose.') AS page_text FROM b)"""
#: With the captions of a page, in order; a caption line is a table or figure line.
CAPTIONS = rf"""{PARTS},
cap AS (SELECT *, list_filter({lines("page_text")}, lambda x: regexp_matches(x, '(?i)^(Table|Fig\.|Figure|Table\s+(UCS|UG|UW))[\s\-][\w\-.]+') AND length(x) > 5) AS caps FROM t),
notes AS (SELECT *, CASE WHEN page_num % 2 = 0 THEN 'NOTES: first note second note of ' || kind ELSE '' END AS notes FROM cap)"""
TIDY = "coalesce(regexp_replace(replace(x, chr(10), ' '), '^\\s+|\\s+$', '', 'g'), '')"
#: Blank labels: block % 4 = 1 has two of four (half filled), 2 three of four, 3 one of four.
COLLAPSED = rf"""{PARTS},
votes AS (SELECT *, list_filter(range(1, 5), lambda i: len(list_filter(rows[1:5], lambda q: coalesce({strip("q[i]")} <> '', false))) >= 2) AS voted,
  list_filter(range(1, 5), lambda i: coalesce({strip("header[i]")} <> '', false)) AS labels FROM t),
chosen AS (SELECT *, CASE WHEN len(labels) >= 3 OR len(labels) = 0 THEN [1, 2, 3, 4] WHEN len(voted) > 0 THEN voted[1:len(labels)] ELSE labels END AS cols, len(labels) >= 3 OR len(labels) = 0 AS complete FROM votes),
merged AS (SELECT *, list_transform(cols, lambda i: CASE WHEN complete THEN coalesce({strip("header[i]")}, '') ELSE
    {strip("header[list_sort(list_transform(labels, lambda h: {'d': abs(h - i), 'h': h}))[1].h]")} END) AS head,
  list_transform(rows, lambda q: list_transform(cols, lambda i: {TIDY.replace("(x,", "(q[i],")})) AS body FROM chosen)"""
ROWS = rf"""{CAPTIONS},
plain AS (SELECT *, list_filter(list_transform(header, lambda h: {strip("h")}), lambda h: coalesce(h <> '', false)) AS hs,
  list_transform(rows, lambda q: list_transform(q, lambda c: {TIDY.replace("(x,", "(c,")})) AS body FROM notes),
placed AS (SELECT *, list_distinct(hs) AS names FROM plain),
texts AS (SELECT *, list_transform(body, lambda q: array_to_string(list_filter(list_transform(list_filter(range(1, len(hs) + 1), lambda i: list_position(hs, hs[i]) = i),
  lambda i: {{'h': hs[i], 'v': coalesce(q[list_max(list_filter(range(1, len(hs) + 1), lambda j: hs[j] = hs[i]))], '')}}), lambda z: z.v <> '')
  .list_transform(lambda z: z.h || ': ' || z.v), ' | ')) AS rt,
  coalesce(CASE WHEN len(caps) > table_idx THEN caps[table_idx + 1] ELSE caps[-1] END, '') AS title FROM placed),
i AS (SELECT *, unnest(range(1, len(rows) + 1)) AS k FROM texts),
base AS (SELECT *, filename || ' - Page ' || page_num || ' - Table ' || (table_idx + 1) AS label, 'Table columns: ' || array_to_string(hs, ' | ') || chr(10) AS cols, CASE WHEN title <> '' THEN title || chr(10) ELSE '' END AS prefix FROM i WHERE rt[k] <> '')"""

BOUNDARY = r"'^([0-9]+\.[0-9]+\s+[A-Z]|[A-Z\s]{10,}$|[0-9]+\s+[A-Z]|APPENDIX\s+[A-Z0-9]|TABLE\s+[0-9]+|FIGURE\s+[0-9]+)'"
SIMPLE = "'^(what is |define |meaning of |maximum (temperature|pressure|thickness)|minimum (temperature|pressure|thickness)|list |name )'"
SIGNALS = "it |its |that |those |these |they |the same|above|mentioned|you said|previous|also|what about|and the|more about|elaborate|explain more|tell me more|what else|any other|furthermore|additionally|in that case|so then|can you|could you|please|how about"


def _boundary(x: str) -> str:
    return f"regexp_matches({strip(x)}, {BOUNDARY})"


def _kind(x: str) -> str:
    return f"CASE WHEN regexp_matches({strip(f'lower({x})')}, {SIMPLE}) THEN 'simple_factual' ELSE 'complex' END"


def oracle_sql() -> dict[str, str]:
    lex = bm25("whole")
    answer = "'## Heading' || repeat(chr(10), 4) || text || '  ' || chr(10) || ' ' || chr(10) || chr(10) || '### Next' || chr(10) || '**bold** # not a heading ' || chr(10) || chr(10)"
    clean = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({answer}, '(?m)^#+\s*', '', 'g'), '(?m)[ \t]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
    return {
        "q_chunk_text": f"WITH {CHUNKS} SELECT * FROM chunks",
        "q_chunk_ids": f"WITH {CHUNKS} SELECT chunk_id, filename, page_num, chunk_seq FROM numbered",
        "q_section_heading": f"SELECT doc_id, {heading('text')} AS heading FROM documents",
        "q_embed_truncate": "SELECT doc_id, CAST(length(substr(text, 1, 500000)) AS INTEGER) AS stored_chars, CAST(length(substr(text, 1, 15000)) AS INTEGER) AS embed_chars, md5(substr(text, 1, 15000)) AS embed_md5 FROM documents",
        "q_embed_batches": f"""WITH {CHUNKS}, placed AS (SELECT *, CAST((row_number() OVER (PARTITION BY filename ORDER BY page_num, chunk_seq) - 1) // 16 AS INTEGER) AS batch, substr(text, 1, 15000) AS e FROM chunks),
          sums AS (SELECT filename, batch, count(*) AS n_chunks, sum(len({words("e")})) * CAST(1.3 AS DOUBLE) AS te, bool_or(length(text) > 15000) AS cut FROM placed GROUP BY ALL)
          SELECT filename, batch, n_chunks, round(te, 4) AS token_estimate, CASE WHEN NOT cut AND te / 10000000 * 60 > 0.1 THEN round(te / 10000000 * 60, 6) ELSE 0.0 END::DOUBLE AS pause_seconds FROM sums""",
        "q_bm25_stats": f"""WITH posting AS (SELECT DISTINCT doc_id, unnest({words("lower(text)")}) AS term FROM documents), counts AS MATERIALIZED (SELECT term, count(*) AS df FROM posting GROUP BY term),
          raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM counts, (SELECT count(*) AS n FROM documents))
          SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * mean ELSE r END, 6) AS idf FROM raw, (SELECT avg(r) AS mean FROM raw)""",
        "q_bm25_topk": f"WITH {CHUNKS}, {bm25('numbered')}, {top('lex', 'scored', 10, 'score > 0')} SELECT query_id, rank0, chunk_id, round(score, 6) AS score FROM lex",
        "q_bm25_pruned": f"WITH {CHUNKS}, {bm25('numbered')}, {top('lex', 'scored', 10, 'score > 0')} SELECT query_id, rank0, chunk_id, round(score, 6) AS score FROM lex",
        "q_dense_topk": f"WITH {VEC}, {DENSE_BY_ID}, {top('dense', 'near', 12, 'score >= 0.25')} SELECT query_id, rank0, chunk_id, round(score, 6) AS score FROM dense",
        "q_dense_index": f"WITH {VEC}, {DENSE_BY_ID}, {top('dense', 'near', 12, 'score >= 0.25')} SELECT query_id, rank0, chunk_id, round(score, 6) AS score FROM dense",
        "q_hyde_blend": f"""WITH {VEC}, pairs AS (SELECT a.vec_id AS chunk_id, a.e AS q, b.e AS h, list_transform(list_zip(a.e, b.e), lambda z: 0.7::DOUBLE * z[1] + 0.3::DOUBLE * z[2]) AS m FROM vec a JOIN vec b ON b.vec_id = a.vec_id + 1),
          n AS (SELECT *, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS b FROM pairs)
          SELECT chunk_id, round(b[1], 6) AS first, round(sqrt(list_dot_product(b, b)), 6) AS length, round(list_dot_product(b, q) / (sqrt(list_dot_product(q, q)) + 1e-10), 6) AS to_query, round(list_dot_product(b, h) / (sqrt(list_dot_product(h, h)) + 1e-10), 6) AS to_passage FROM n""",
        "q_hybrid_rrf": f"WITH {WHOLE}, {lex}, {top('lex', 'scored', 24, 'score > 0')}, {VEC}, {DENSE_BY_ITEM}, {top('dense', 'near', 24, 'score >= 0.25')}, {hybrid('fused', 12)} SELECT query_id, rank0, chunk_id, round(distance, 6) AS distance, round(rrf, 9) AS rrf_score FROM fused",
        "q_multi_query_rrf": f"""WITH {WHOLE}, {lex}, {top("lex", "scored", 20, "score > 0")}, {VEC}, {DENSE_BY_ITEM}, {top("dense", "near", 20, "score >= 0.25")}, {hybrid("fused", 20)},
          lists AS (SELECT query_id, chunk_id, rank0, 0 AS list_seq, 3.0::DOUBLE AS weight FROM fused UNION ALL SELECT query_id, chunk_id, rank0, 1, 0.5::DOUBLE FROM dense WHERE rank0 < 8 UNION ALL SELECT query_id, chunk_id, rank0, 2, 0.5::DOUBLE FROM lex WHERE rank0 < 8),
          keyed AS (SELECT l.*, source || substr(text, 1, 50) AS k FROM lists l JOIN whole USING (chunk_id)),
          m AS (SELECT query_id, k, sum(weight / CAST(61 + rank0 AS DOUBLE)) AS s, arg_max(chunk_id, list_seq * 1000 + rank0) AS chunk_id, arg_max(list_seq, list_seq * 1000 + rank0) AS list_seq, min(list_seq * 1000 + rank0) AS f FROM keyed GROUP BY ALL)
          SELECT query_id, rank0, chunk_id, list_seq, round(s, 9) AS rrf_score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, f) - 1 AS INTEGER) AS rank0 FROM m) WHERE rank0 < 15""",
        "q_dedup_text": f"""WITH RECURSIVE {WHOLE}, {lex}, {top("lex", "scored", 20, "score > 0")},
          hits AS (SELECT query_id, l.rank0, {{'rank0': l.rank0, 'chunk_id': l.chunk_id, 's': d.source, 't': {words("lower(substr(d.text, 1, 100))")}}} AS h FROM lex l JOIN documents d ON d.doc_id = l.chunk_id),
          {fold("hits", "", "p.s = ($h).s AND len(list_intersect(p.t, ($h).t)) > 0.7 * least(len(p.t), len(($h).t))", 20)}""",
        "q_dedup_semantic": f"""WITH RECURSIVE {VEC}, {DENSE_BY_ID}, {top("dense", "near", 20, "true")},
          hits AS (SELECT query_id, l.rank0, {{'rank0': l.rank0, 'chunk_id': l.chunk_id, 'e': e}} AS h FROM dense l JOIN vec ON vec_id = chunk_id),
          {fold("hits", "", "list_dot_product(p.e, ($h).e) / (sqrt(list_dot_product(p.e, p.e)) * sqrt(list_dot_product(($h).e, ($h).e)) + 1e-10) > 0.3", 20)}""",
        "q_conflicts": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part),
          h AS (SELECT *, p_brand || '/' || (place // 15) AS query_id, CAST(place % 15 AS INTEGER) AS rank0 FROM p)
          SELECT query_id, 'Wall Thickness_mm' AS conflict_key, CAST(count(*) AS INTEGER) AS n_values, min(rank0) AS first_rank,
            'CONFLICT in Wall Thickness mm: ' || string_agg(CAST(CAST(p_size AS DOUBLE) AS VARCHAR) || ' mm (' || p_name || ' ' || p_partkey || ')', ', ' ORDER BY rank0) AS message
          FROM h GROUP BY query_id HAVING count(DISTINCT p_size) > 1""",
        "q_sentence_window": f"WITH {CHUNKS}, {bm25('numbered')}, {top('lex', 'scored', 10, 'score > 0')}, {WINDOWS} SELECT query_id, rank0, chunk_id, CAST(length(win) AS INTEGER) AS n_chars, md5(win) AS window_md5 FROM shown",
        "q_context": f"""WITH {CHUNKS}, {bm25("numbered")}, {top("lex", "scored", 10, "score > 0")}, {WINDOWS}
          SELECT query_id, false AS has_conflicts, md5('RELEVANT DOCUMENTS:' || chr(10) || repeat('=', 50) || chr(10) || string_agg(chr(10) || 'Source: ' || source || chr(10) || 'Content: ' || win || chr(10), chr(10) ORDER BY rank0)) AS context_md5 FROM shown GROUP BY query_id""",
        "q_sources": f"WITH {CHUNKS}, {bm25('numbered')}, {top('lex', 'scored', 10, 'score > 0')} SELECT DISTINCT query_id, filename || ' — Page ' || page_num AS source_label FROM lex JOIN numbered USING (chunk_id)",
        "q_section_boundary": f"""SELECT conv_id, turn, {_boundary("text")} AS plain, {_boundary("' 3.1 ' || upper(text)")} AS numbered, {_boundary("'Table 3' || upper(text)")} AS mixed, {_boundary("'APPENDIX A ' || upper(text)")} AS appendix FROM conversations""",
        "q_classify_query": f"""SELECT conv_id, turn, {_kind("text")} AS plain, {_kind("' What is the ' || text")} AS asked, {_kind("'the maximum temperature ' || text")} AS inner_words, {_kind("'Minimum Pressure ' || text")} AS extreme FROM conversations""",
        "q_answer_cleanup": f"SELECT doc_id, md5({clean}) AS clean_md5, CAST(length({clean}) AS INTEGER) AS n_chars FROM documents",
        "q_followup": f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role IN ('user', 'assistant'))
          SELECT conv_id, turn, k > 1 AND regexp_matches(lower(text), '{SIGNALS}') AS is_followup FROM s WHERE role = 'user'""",
        "q_chat_summary": f"""WITH {SAID} SELECT conv_id, 'CONVERSATION HISTORY (most recent first):' || chr(10) || string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END, chr(10) ORDER BY back) AS summary FROM said WHERE back <= 6 GROUP BY conv_id""",
        "q_chat_last_n": f"WITH {SAID} SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place, role, text FROM said WHERE back <= 6",
        "q_md_tables": """WITH r AS (SELECT CAST(p_partkey // 6 AS INTEGER) AS block, p_partkey, p_partkey || '|' || p_name || '|' || p_brand AS l FROM part)
          SELECT block, 0 AS table_idx, CAST(count(*) + 1 AS INTEGER) AS n_rows, 'Key|Name|Brand/' || string_agg(l, '/' ORDER BY p_partkey) AS cells FROM r GROUP BY block""",
        "q_collapse_columns": f"WITH {COLLAPSED} SELECT page_num, array_to_string(list_transform(list_prepend(head, body), lambda q: array_to_string(q, '|')), '/') AS cells FROM merged",
        "q_table_quality": rf"""WITH {COLLAPSED}, f AS (SELECT page_num, len(list_filter(header, lambda h: coalesce({strip("h")} <> '', false))) AS h, flatten(rows) AS c, len(list_filter(head, lambda h: h <> '')) AS h2, flatten(body) AS c2 FROM merged),
          g AS (SELECT page_num, h, h2, len(list_filter(c, lambda x: coalesce({strip("x")} <> '', false))) / greatest(len(c), 1) AS f, len(list_filter(c2, lambda x: x <> '')) / greatest(len(c2), 1) AS f2 FROM f)
          SELECT page_num, CASE WHEN h < 2 THEN 0.1 ELSE round(0.7 * f::DOUBLE + 0.3 * least(h / 3, 1.0)::DOUBLE, 3) END::DOUBLE AS raw, CASE WHEN h2 < 2 THEN 0.1 ELSE round(0.7 * f2::DOUBLE + 0.3 * least(h2 / 3, 1.0)::DOUBLE, 3) END::DOUBLE AS collapsed FROM g""",
        "q_table_rows": f"WITH {ROWS} SELECT filename, page_num, CAST(2 * k AS INTEGER) AS seq, label || ', Row ' || k AS source, prefix || cols || 'Row ' || k || ': ' || rt[k] AS text FROM base",
        "q_table_triples": f"""WITH {ROWS} SELECT filename, page_num, CAST(2 * k + 1 AS INTEGER) AS seq, label || ', Rows ' || greatest(k - 2, 1) || '-' || k AS source,
          cols || 'Rows ' || greatest(k - 2, 1) || '-' || k || ': ' || array_to_string(list_filter(rt[k - 1:k + 1], lambda x: x <> ''), ' ; ') AS text FROM base WHERE k % 3 = 0""",
        "q_table_full": f"""WITH {ROWS}, lined AS (SELECT *, list_prepend(list_transform(header, lambda h: coalesce(h, '')), list_transform(rows, lambda q: list_transform(q, lambda c: coalesce(replace(c, chr(10), ' '), '')))) AS g FROM texts),
          wide AS (SELECT *, list_transform(range(1, 5), lambda c: list_max(list_transform(g, lambda q: length(q[c])))) AS ws FROM lined),
          drawn AS (SELECT *, '+' || array_to_string(list_transform(ws, lambda w: repeat('-', w + 2)), '+') || '+' AS rule, list_transform(g, lambda q: '| ' || array_to_string(list_transform(range(1, 5), lambda c: rpad(q[c], ws[c]::INTEGER, ' ')), ' | ') || ' |') AS ls FROM wide)
          SELECT filename, page_num, filename || ' - Page ' || page_num || ' - Table ' || (table_idx + 1) || ' (full)' AS source, md5(CASE WHEN title <> '' THEN title || chr(10) ELSE '' END || 'Complete table (page ' || page_num || ', table ' || (table_idx + 1) || '):' || chr(10)
            || rule || chr(10) || ls[1] || chr(10) || replace(rule, '-', '=') || chr(10) || array_to_string(list_transform(ls[2:], lambda x: x || chr(10) || rule), chr(10)) || CASE WHEN notes <> '' THEN chr(10) || notes ELSE '' END) AS text_md5 FROM drawn""",
        "q_table_title": f"WITH {CAPTIONS} SELECT page_num, coalesce(caps[1], '') AS first, coalesce(caps[2], caps[-1], '') AS second FROM cap",
        "q_table_notes": f"WITH {CAPTIONS} SELECT page_num, notes FROM notes",
        "q_title_carry": f"""WITH {CAPTIONS}, o AS (SELECT *, CASE WHEN len(caps) > table_idx THEN caps[table_idx + 1] ELSE caps[-1] END AS own FROM cap)
          SELECT filename, page_num, table_idx, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY filename ORDER BY page_num, table_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) || ' (continued)', '') AS title FROM o""",
        "q_skip_report": """WITH s AS (SELECT doc_id AS page_num, CASE WHEN doc_id % 11 = 0 THEN 'buffer' WHEN doc_id % 7 = 0 THEN 'image_only' WHEN doc_id % 5 = 0 THEN 'empty' WHEN doc_id % 13 = 0 THEN 'error' END AS kind FROM documents)
          SELECT kind, count(*) AS n, array_to_string(list_sort(list_distinct(list(page_num)))[1:10], ', ') || CASE WHEN count(*) > 10 THEN ' +' || (count(*) - 10) || ' more' ELSE '' END AS pages FROM s WHERE kind IS NOT NULL GROUP BY kind""",
        "q_session_expiry": "SELECT user_id, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen FROM (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id) WHERE (SELECT max(ts) FROM events) - last_seen > INTERVAL 24 HOURS",
        "q_index_verify": "SELECT v AS total_vectors, d AS total_documents, v = d AS index_healthy FROM (SELECT (SELECT count(*) FROM embeddings) AS v, (SELECT count(*) FROM documents) AS d)",
        "q_ingest_counts": "SELECT count(*) AS total, count(embedding) AS successful, count(*) - count(embedding) AS skipped FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
        "q_resume_antijoin": f"WITH {CHUNKS} SELECT filename, page_num, chunk_seq FROM chunks WHERE CAST(substr(filename, 4) AS INTEGER) % 2 <> 0",
        "q_allowed_files": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE regexp_matches(lower(url), '\\.(pdf|zip)$') END AS allowed FROM pages",
        "q_table_accept": f"""WITH {COLLAPSED}, f AS (SELECT filename, page_num, table_idx, len(list_filter(head, lambda h: h <> '')) AS h, flatten(body) AS c,
            list_filter(flatten(rows), lambda x: coalesce({strip("x")} <> '', false)) AS own, len(flatten(rows)) AS n FROM merged),
          g AS (SELECT filename, page_num, table_idx, page_num % 3 <> 0 AS had, CASE WHEN h < 2 THEN 0.1 ELSE round(0.7 * (len(list_filter(c, lambda x: x <> '')) / greatest(len(c), 1))::DOUBLE + 0.3 * least(h / 3, 1.0)::DOUBLE, 3) END::DOUBLE AS q1,
            round(0.7 * (len(own) / greatest(n, 1))::DOUBLE + 0.3::DOUBLE, 3)::DOUBLE AS q2 FROM f)
          SELECT filename, page_num, table_idx, 'first' AS extractor, q1 AS quality FROM g WHERE had AND q1 >= 0.4
          UNION ALL SELECT filename, page_num, table_idx, 'second', q2 FROM g WHERE had AND q1 < 0.4 AND q2 >= 0.4
          UNION ALL SELECT filename, page_num, table_idx, 'second', -1.0 FROM g WHERE NOT had""",
        "q_pages_with_grids": f"""WITH {ROWS}, lined AS (SELECT *, list_prepend(list_transform(header, lambda h: coalesce(h, '')), list_transform(rows, lambda q: list_transform(q, lambda c: coalesce(replace(c, chr(10), ' '), '')))) AS g FROM texts),
          wide AS (SELECT *, list_transform(range(1, 5), lambda c: list_max(list_transform(g, lambda q: length(q[c])))) AS ws FROM lined),
          drawn AS (SELECT *, '+' || array_to_string(list_transform(ws, lambda w: repeat('-', w + 2)), '+') || '+' AS rule, list_transform(g, lambda q: '| ' || array_to_string(list_transform(range(1, 5), lambda c: rpad(q[c], ws[c]::INTEGER, ' ')), ' | ') || ' |') AS ls FROM wide),
          shown AS (SELECT filename, page_num, page_text, page_text || CASE WHEN table_idx = 0 THEN chr(10) || rule || chr(10) || ls[1] || chr(10) || replace(rule, '-', '=') || chr(10) || array_to_string(list_transform(ls[2:], lambda x: x || chr(10) || rule), chr(10)) ELSE '' END AS t FROM drawn)
          SELECT filename, page_num, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5, {heading("page_text")} AS heading FROM shown""",
        "q_embed_list": f"SELECT item_id AS query_id, {_kind('text')} AS complexity, CAST(1 AS INTEGER) AS n_texts, md5(text) AS texts_md5 FROM benchmark",
        "q_rerank_head": f"WITH {WHOLE}, {lex}, {top('lex', 'scored', 15, 'score > 0')} SELECT query_id, rank0, chunk_id, true AS unscored FROM lex WHERE rank0 < 10",
        "q_history_messages": f"WITH {SAID} SELECT conv_id, CAST(count(*) + 1 AS INTEGER) AS n_messages, md5('system=rules' || chr(10) || string_agg(role || '=' || text, chr(10) ORDER BY turn)) AS messages_md5 FROM said WHERE back <= 6 GROUP BY conv_id",
        "q_store_roundtrip": f"WITH {CHUNKS} SELECT chunk_id, filename, page_num, chunk_seq, md5(text) AS text_md5, CAST(coalesce(len(embedding), 0) AS INTEGER) AS dim FROM numbered LEFT JOIN embeddings ON vec_id = chunk_id",
        "q_page_limit": "SELECT source AS filename, doc_id * 2 AS page_num, CAST(length(substr(text, 1, 500000)) AS INTEGER) AS n_chars FROM documents WHERE doc_id * 2 <= 1000",
        "q_resume_truncate": """SELECT vec_id AS chunk_id, CASE WHEN v = b THEN 'resume' ELSE 'truncate' END AS action FROM embeddings, (SELECT (SELECT count(*) FROM embeddings) AS v, (SELECT count(*) FROM benchmark) AS b) WHERE v >= b AND b > 0 AND vec_id < b""",
        "q_add_vectors": f"WITH {VEC} SELECT vec_id AS chunk_id, round(u[1], 6) AS first, round(sqrt(list_dot_product(u, u)), 6) AS length FROM unit WHERE vec_id % 3 <> 0 AND len(u) = 64",
        "q_wordings": f"""WITH a AS (SELECT item_id AS query_id, text, {_kind("text")} AS kind, {strip("substr(text, 1, 40)")} AS cut FROM benchmark),
          e AS (SELECT query_id, kind, CASE WHEN length(cut) > 10 THEN cut ELSE text END AS expanded FROM a),
          h AS (SELECT *, {strip("substr(expanded, 1, 40)")} AS again FROM e),
          v AS (SELECT *, list_filter(list_transform(regexp_split_to_array(again, '\\r\\n|\\n|\\r'), lambda l: {strip("l")}), lambda l: length(l) > 10)[1:2] AS vs FROM h)
          SELECT query_id, expanded, CASE WHEN kind = 'complex' AND length(again) > 20 THEN again ELSE '' END AS hyde, CAST(CASE WHEN kind = 'complex' THEN len(vs) ELSE 0 END AS INTEGER) AS n_variants, CASE WHEN kind = 'complex' THEN array_to_string(vs, '|') ELSE '' END AS variants FROM v""",
        "q_query_vectors": f"""WITH {VEC}, t AS (SELECT text, min(item_id) AS id FROM benchmark GROUP BY text), tv AS (SELECT text, e FROM t JOIN vec ON vec_id = id),
          a AS (SELECT b.item_id AS query_id, b.text AS text, coalesce(n.text, b.text) AS expanded, coalesce(h.text, '') AS hyde FROM benchmark b LEFT JOIN benchmark n ON n.item_id = b.item_id + 1 LEFT JOIN benchmark h ON h.item_id = b.item_id + 2),
          j AS (SELECT query_id, expanded, coalesce(e.e, q.e) AS b, h.e AS h FROM a LEFT JOIN tv q ON q.text = a.text LEFT JOIN tv e ON e.text = a.expanded LEFT JOIN tv h ON h.text = a.hyde),
          m AS (SELECT *, list_transform(list_zip(b, coalesce(h, b)), lambda z: 0.7::DOUBLE * z[1] + 0.3::DOUBLE * z[2]) AS m FROM j)
          SELECT query_id, md5(expanded) AS text_md5, round(CASE WHEN h IS NULL THEN b[1] ELSE m[1] / sqrt(list_dot_product(m, m)) END, 6) AS first, round(CASE WHEN h IS NULL THEN b[64] ELSE m[64] / sqrt(list_dot_product(m, m)) END, 6) AS last FROM m""",
        "q_rerank_scored": f"""WITH {WHOLE}, {lex}, {top("lex", "scored", 15, "score > 0")}, r AS (SELECT query_id, chunk_id, CAST(length(text) AS DOUBLE) AS rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, l.rank0) - 1 AS INTEGER) AS rank0 FROM lex l JOIN whole USING (chunk_id))
          SELECT query_id, rank0, chunk_id, rerank_score FROM r WHERE rank0 < 10""",
        "q_chat_export": f"WITH {SAID} SELECT conv_id, conv_id AS session_id, CAST(count(*) AS INTEGER) AS n_messages, true AS dated, md5(string_agg(role || '=' || text, chr(10) ORDER BY turn)) AS text_md5 FROM said WHERE back <= 20 GROUP BY conv_id",
        "q_page_chunks": f"""WITH {ROWS}, c AS (SELECT filename, page_num, 0 AS kind, table_idx, 0 AS chunk_seq, filename || ' - Page ' || page_num || ' - Table ' || (table_idx + 1) || ' (full)' AS source, 'table-full' AS chunk_type FROM texts WHERE len(hs) > 0
            UNION ALL SELECT filename, page_num, 0, table_idx, 2 * k, label || ', Row ' || k, 'table-row' FROM base WHERE len(hs) > 0
            UNION ALL SELECT filename, page_num, 0, table_idx, 2 * k + 1, label || ', Rows ' || greatest(k - 2, 1) || '-' || k, 'table-row' FROM base WHERE k % 3 = 0 AND len(hs) > 0
            UNION ALL SELECT filename, page_num, 1, 0, 0, filename || ' - Page ' || page_num, 'text' FROM texts)
          SELECT row_number() OVER (ORDER BY filename, page_num, kind, table_idx, chunk_seq) - 1 AS chunk_id, filename, page_num, kind, CAST(table_idx AS INTEGER) AS table_idx, CAST(chunk_seq AS INTEGER) AS chunk_seq, source, chunk_type FROM c""",
        "q_poor_pages": f"""WITH {COLLAPSED}, f AS (SELECT filename, page_num, len(list_filter(head, lambda h: h <> '')) AS h, flatten(body) AS c FROM merged)
          SELECT filename, page_num FROM f WHERE page_num % 3 = 0 OR CASE WHEN h < 2 THEN 0.1 ELSE round(0.7 * (len(list_filter(c, lambda x: x <> '')) / greatest(len(c), 1))::DOUBLE + 0.3 * least(h / 3, 1.0)::DOUBLE, 3) END < 0.4""",
        "q_page_ranges": r"SELECT md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS n_chars FROM documents WHERE regexp_matches(text, '\S')",
        "q_sessions": """SELECT user_id, count(*) AS n_events, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
          CASE WHEN (SELECT max(ts) FROM events) - max(ts) > INTERVAL 24 HOURS THEN 'expired' ELSE 'live' END AS state FROM events GROUP BY user_id""",
        "q_uploads": r"""SELECT regexp_extract(url, '//([^/]*)', 1) AS session_id, trim(regexp_replace(regexp_replace(trim(url || ' ' || page_id || '.pdf'), '[\s/]+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '._') AS filename, md5('again ' || html) AS content_md5 FROM pages""",
        "q_batch_answers": f"""WITH {CHUNKS}, p AS (SELECT *, length(substr(text, 1, 15000)) AS n, row_number() OVER (PARTITION BY filename ORDER BY chunk_id) - 1 AS k FROM numbered),
          b AS (SELECT *, k // 16 AS batch, k % 16 AS place, bool_or(n % 97 = 0) OVER (PARTITION BY filename, k // 16) OR n % 7 = 0 AS failed FROM p)
          SELECT filename, CAST(batch AS INTEGER) AS batch, CAST(place AS INTEGER) AS place, chunk_id, failed, CAST(CASE WHEN failed THEN -1 ELSE n END AS INTEGER) AS n_chars, CAST(CASE WHEN failed THEN -1 ELSE place END AS INTEGER) AS at FROM b""",
        "q_ingest_log": f"""WITH {CHUNKS.replace("source AS filename, doc_id AS page_num", "source || '/' || doc_id AS filename, 1::BIGINT AS page_num")},
          f AS (SELECT *, chunk_id // 700 AS batch, length(substr(text, 1, 15000)) % 7 = 0 AS skipped, max(chunk_id) OVER (PARTITION BY filename) AS f_last, min(chunk_id) OVER (PARTITION BY filename) AS f_first FROM numbered)
          SELECT batch, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, count(*) AS n_chunks, count(*) FILTER (NOT skipped) AS n_vectors, count(*) FILTER (skipped) AS n_skipped, count(*) FILTER (chunk_id = f_last) AS n_files_ended,
            arg_max(filename, chunk_id) AS current_file, max(chunk_id) - arg_max(f_first, chunk_id) + 1 AS chunks_in_current FROM f GROUP BY batch""",
        "q_store_appends": """SELECT item_id AS chunk_id, md5(text) AS text_md5, v AS version FROM benchmark, (SELECT unnest([1, 2])::INTEGER AS v)
          UNION ALL SELECT doc_id + (SELECT max(item_id) + 1 FROM benchmark), md5(text), 2 FROM documents""",
        "q_stream_ingest": f"WITH {CHUNKS} SELECT * FROM chunks",
    }
