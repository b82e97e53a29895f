"""What each query must return, as SQL for DuckDB.

Written from the contract, not from the Spark plans: packing is a recursive
walk over lines, hashed vectors are sparse rows, top-k is a window.
"""

from __future__ import annotations

from chunkwell.operators.results import SYSTEM_PROMPT
from chunkwell.operators.search import NO_HIT_ADVICE

# Own values, so that a wrong one in the package shows.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680,
                           *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SUPPORTED_FORMATS = [
    "." + name for name in
    "pdf docx doc txt rtf odt pptx ppt xlsx xls html htm md csv json xml eml msg".split()
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    return f"trim({expr}, {_quoted(BLANKS)})"


NL = "chr(10)"

# text to elements ---------------------------------------------------------------

def _elements(source: str) -> str:
    """``elements(doc_id, element_index, …)`` of ``source(doc_id, text)``."""
    return f"""
pages_of AS (
  SELECT doc_id, unnest(string_split(text, chr(12))) AS page,
         generate_subscripts(string_split(text, chr(12)), 1) AS page_number
  FROM {source}),
lines_of AS (
  SELECT doc_id, page_number, unnest(string_split(page, {NL})) AS line,
         generate_subscripts(string_split(page, {NL}), 1) AS line_number
  FROM pages_of),
stripped AS (
  SELECT doc_id, page_number, line_number, {_strip('line')} AS text FROM lines_of),
elements AS (
  SELECT doc_id, text, page_number,
         row_number() OVER (PARTITION BY doc_id ORDER BY page_number, line_number) - 1
           AS element_index,
         CASE WHEN regexp_matches(text, '^#{{1,6}}[ \\t]+\\S') THEN 'Title'
              WHEN regexp_matches(text, '^[-*•][ \\t]') THEN 'ListItem'
              WHEN length(text) <= 60 AND regexp_matches(text, '^\\p{{Lu}}')
                   AND NOT regexp_matches(text, '[.!?:;,]$') THEN 'Title'
              ELSE 'NarrativeText' END AS category
  FROM stripped WHERE text <> '')
"""


def _windows(text: str, size: str, overlap: str) -> str:
    """Unnested ``(i, window)`` of a text, in a lateral join."""
    return (
        f"(SELECT g AS pos, substr({text}, g + 1, {size}) AS w FROM unnest(generate_series("
        f"0, greatest(length({text}) - 1 - {overlap}, 0), {size} - {overlap})) AS s(g))"
    )


def _packed(by_title: bool, source: str = "documents") -> str:
    flush = "p.cur + 2 + length(e.text) > 1000"
    if by_title:
        flush = f"({flush} OR e.category = 'Title')"
    return f"""{_elements(source)},
pack AS (
  SELECT doc_id, element_index, length(text) AS cur, 0 AS grp
  FROM elements WHERE element_index = 0
  UNION ALL
  SELECT e.doc_id, e.element_index,
         CASE WHEN {flush} THEN length(e.text) ELSE p.cur + 2 + length(e.text) END,
         p.grp + CASE WHEN {flush} THEN 1 ELSE 0 END
  FROM pack p JOIN elements e
    ON e.doc_id = p.doc_id AND e.element_index = p.element_index + 1),
groups AS (
  SELECT doc_id, grp, string_agg(text, {NL} || {NL} ORDER BY element_index) AS body,
         count(*) AS members, min_by(category, element_index) AS element_type,
         min_by(page_number, element_index) AS page_number
  FROM pack JOIN elements USING (doc_id, element_index) GROUP BY doc_id, grp),
pieces AS (
  SELECT doc_id, grp, 0 AS pos, body AS piece, element_type, page_number
  FROM groups WHERE NOT (members = 1 AND length(body) > 1000)
  UNION ALL
  SELECT doc_id, grp, pos, w, element_type, page_number
  FROM groups, LATERAL {_windows('body', '1000', '200')} AS x
  WHERE members = 1 AND length(body) > 1000),
chunks AS (
  SELECT doc_id,
         row_number() OVER (PARTITION BY doc_id ORDER BY grp, pos) - 1 AS chunk_index,
         {_strip('piece')} AS content, element_type, page_number
  FROM pieces WHERE {_strip('piece')} <> '')
"""


_CHUNK_ROWS = """
SELECT doc_id, chunk_index::BIGINT AS chunk_index, content, element_type,
       page_number::BIGINT AS page_number FROM chunks"""

# hashed vectors -----------------------------------------------------------------


def _hashed(name: str, source: str, key: str, dims: int) -> str:
    """Sparse unit vectors of ``source(key, text)`` as ``name(key, bucket, value)``."""
    return f"""
{name}_tokens AS (
  SELECT {key}, unnest(string_split_regex(
           lower({_strip('text')}), '[^\\p{{L}}\\p{{N}}]+')) AS token
  FROM {source}),
{name}_slots AS (
  SELECT {key}, ('0x' || substr(md5(token), 1, 6))::BIGINT % {dims} AS bucket,
         CASE WHEN substr(md5(token), 7, 1) < '8' THEN 1 ELSE -1 END AS sign
  FROM {name}_tokens WHERE token <> ''),
{name}_sums AS (
  SELECT {key}, bucket, sum(sign)::DOUBLE AS s FROM {name}_slots GROUP BY ALL),
{name} AS (
  SELECT {key}, bucket,
         (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS value
  FROM {name}_sums WHERE s <> 0)
"""


def _ranked_chunks(limit: int, threshold: float) -> str:
    """Chunks, hashed vectors and ``hits`` of the benchmark questions.

    ``ranked`` holds the top ``limit`` before any filter; ids are
    ``doc/<n>.txt#<chunk>``.
    """
    return f"""{_packed(True)},
corpus AS (
  SELECT 'doc/' || doc_id || '.txt' AS document_url,
         'doc/' || doc_id || '.txt#' || chunk_index AS chunk_id,
         doc_id, chunk_index, content, content AS text, page_number FROM chunks),
{_hashed('cv', 'corpus', 'chunk_id', 256)},
{_hashed('qv', 'benchmark', 'item_id', 256)},
cn AS (SELECT chunk_id, sqrt(sum(value * value)) AS norm FROM cv GROUP BY chunk_id),
qn AS (SELECT item_id, sqrt(sum(value * value)) AS norm FROM qv GROUP BY item_id),
dots AS (
  SELECT item_id, chunk_id, sum(qv.value * cv.value) AS dot
  FROM qv JOIN cv USING (bucket) GROUP BY item_id, chunk_id),
scored AS (
  SELECT item_id AS query_id, chunk_id,
         round((1 + coalesce(dot, 0) / (qn.norm * cn.norm)) / 2, 9) AS score
  FROM dots JOIN qn USING (item_id) JOIN cn USING (chunk_id)),
ranked AS (
  SELECT * FROM (
    SELECT query_id, chunk_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM scored) WHERE rank <= {limit}),
hits AS (
  SELECT query_id, rank, score, chunk_id, corpus.doc_id, document_url, chunk_index, content,
         page_number, lang, source
  FROM ranked JOIN corpus USING (chunk_id) JOIN documents d ON d.doc_id = corpus.doc_id
  WHERE score >= {threshold})
"""


_SCORE_TEXT = "printf('%.3f', score)"
_EXCERPT = (
    f"'[Excerpt ' || rank || ', similarity: ' || {_SCORE_TEXT} || ' (from ' || doc_id || "
    f"'.txt, page ' || page_number || ')]' || {NL} || content || {NL}"
)
_CONTEXT = f"string_agg({_EXCERPT}, {NL} ORDER BY rank)"
_SCORES = f"string_agg({_SCORE_TEXT}, ', ' ORDER BY rank)"


def _user_prompt(question: str, context: str) -> str:
    return (
        f"'Question: ' || {question} || {NL} || {NL} || 'Excerpts:' || {NL} || {context} || "
        f"{NL} || {NL} || 'Answer the question from these excerpts.'"
    )


# stored vectors -----------------------------------------------------------------

_COSINE = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SCORE = f"round((1 + {_COSINE}) / 2, 9)"
_LAST = "(SELECT embedding FROM embeddings ORDER BY vec_id DESC LIMIT 1)"


def _single(limit: int, inner: str = "TRUE", outer: str = "TRUE") -> str:
    return f"""
WITH top AS (
  SELECT e.vec_id, e.label, {_SCORE} AS score FROM embeddings e, {_LAST} q
  WHERE {inner} ORDER BY score DESC, vec_id LIMIT {limit})
SELECT vec_id, label::BIGINT AS label, round(score, 6) AS similarity_score
FROM top WHERE {outer}"""


def _batch(
    limit: int,
    *,
    pairs: str = "TRUE",
    group: str = "",
) -> str:
    """``top``: the best rows of every query, optionally per group."""
    part = f"q.vec_id, {group}" if group else "q.vec_id"
    name = f", {group} AS grp" if group else ""
    return f"""
top AS (
  SELECT * FROM (
    SELECT q.vec_id AS query_id, e.vec_id, e.label, {_SCORE} AS score{name},
           row_number() OVER (PARTITION BY {part} ORDER BY {_SCORE} DESC, e.vec_id) AS rank
    FROM embeddings e, embeddings q WHERE {pairs}) WHERE rank <= {limit})
"""


#: The list of every vector when the first sixteen are the centres.
_LISTED = """
unit AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e
  FROM embeddings),
centres AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cell, embedding::DOUBLE[] AS x FROM embeddings WHERE vec_id < 16),
listed AS (
  SELECT vec_id, cell FROM (
    SELECT vec_id, cell, row_number() OVER (
      PARTITION BY vec_id ORDER BY list_inner_product(e, x) - list_inner_product(x, x) / 2 DESC, cell) AS place
    FROM unit, centres) WHERE place = 1)"""

_TOP_COLUMNS = "query_id, vec_id, round(score, 6) AS similarity_score, rank"

# addresses ------------------------------------------------------------------------

_SUFFIX = (
    "lower(regexp_extract(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), "
    "'([^/]*)$', 1), '^\\.+', ''), '^.+(\\.[^.]+)$', 1))"
)
_PATH_NAME = (
    "regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), "
    "'^[a-zA-Z]+://[^/]*', ''), '/+$', ''), '([^/]*)$', 1)"
)

# HTML -----------------------------------------------------------------------------


def _html_text(expr: str) -> str:
    """Inner HTML of a flat element as text: no tags, entities decoded, blanks joined."""
    plain = f"regexp_replace({expr}, '<[^>]*>', '', 'g')"
    # these old entities also count without their semicolon
    for entity, char in (
        ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;", "'"), ("&#39;", "'"),
        ("&nbsp;?", " "), ("&amp;?", "&"),
    ):
        plain = f"regexp_replace({plain}, {_quoted(entity)}, {_quoted(char)}, 'g')"
    return f"trim(regexp_replace({plain}, '[\\s ]+', ' ', 'g'))"


_LABEL_CHUNKS = "'label_' || label"

ORACLES: dict[str, str] = {
    "read_documents": "SELECT 'json' AS format, doc_id, text FROM documents",
    "classify_sources": f"""
SELECT page_id, url, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]') AS is_url,
       {_SUFFIX} AS suffix,
       {_SUFFIX} IN ({', '.join(map(_quoted, SUPPORTED_FORMATS))}) AS is_supported
FROM pages""",
    "infer_source_name": f"""
SELECT page_id, url,
       CASE WHEN {_PATH_NAME} LIKE '%.%' THEN {_PATH_NAME}
            WHEN url ILIKE '%pdf%' THEN 'document.pdf'
            WHEN url ILIKE '%doc%' THEN 'document.docx'
            ELSE 'document.txt' END AS source_name
FROM pages""",
    "store_chunks": """
SELECT vec_id::VARCHAR AS chunk_id, 'vectors' AS collection_name,
       'label/' || label AS document_url, 'vector ' || vec_id AS content,
       len(embedding)::BIGINT AS dims, 'first' AS batch,
       (strlen('vector ' || vec_id) + 4 * len(embedding))::BIGINT AS logical_size,
       count(*) OVER () AS chunks_stored
FROM embeddings""",
    "read_collection": """
SELECT vec_id::VARCHAR AS chunk_id, 'label_3' AS collection_name, 'vector ' || vec_id AS content
FROM embeddings WHERE label = 3""",
    "ingest_incremental": f"""
WITH RECURSIVE files AS (
  SELECT doc_id // 50 AS doc_id, string_agg(text, {NL} ORDER BY doc_id) AS text
  FROM documents GROUP BY doc_id // 50),
{_packed(True, "files")} {_CHUNK_ROWS}""",
    "partition_text": f"""WITH {_elements('documents')}
SELECT doc_id, element_index::BIGINT AS element_index, category, text,
       page_number::BIGINT AS page_number FROM elements""",
    "partition_html": f"""
SELECT page_id, {_html_text("regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS titles,
       len(list_filter(regexp_extract_all(html, '(?s)<li[^>]*>(.*?)</li>', 1),
                       lambda x: {_html_text('x')} <> ''))::BIGINT AS list_items
FROM pages""",
    "html_elements": f"""
WITH b AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '(?s)<head>.*?</head>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?s)<script.*?</script>', '', 'g'),
           '<br>', ' ', 'g') AS body FROM pages),
s AS (
  SELECT page_id, string_split(regexp_replace(body,
           '<(/?)(nav|ul|li|div|article|h1|p|footer|body|html)\\b[^>]*>', chr(1) || '\\1\\2' || chr(2), 'g'), chr(1)) AS pieces
  FROM b),
e AS (
  SELECT page_id, list_transform(pieces, lambda x: {{
           'category': CASE split_part(x, chr(2), 1) WHEN 'h1' THEN 'Title' WHEN 'li' THEN 'ListItem' ELSE 'NarrativeText' END,
           'text': {_html_text("regexp_replace(regexp_replace(regexp_replace(x, '^[^' || chr(2) || ']*' || chr(2), ''), '&copy;', '©', 'g'), '&middot;', '·', 'g')")}}}) AS found
  FROM s)
SELECT page_id, array_to_string(list_transform(list_filter(found, lambda x: x.text <> ''),
         lambda x: x.category || ': ' || x.text), chr(10)) AS elements
FROM e""",
    "html_tables": """
WITH i AS (
  SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<&]*)</a></li>', 1) AS items FROM pages),
c AS (
  SELECT page_id, len(items) AS n, unnest(items) AS item, generate_subscripts(items, 1) AS row FROM i),
cells AS (
  SELECT page_id, 0 AS row, unnest([0, 1, 2]) AS "column", true AS header, unnest([page_id::VARCHAR, page_id::VARCHAR, 'side']) AS text
  FROM i
  UNION ALL
  SELECT page_id, row, unnest([0, 1, 2]), false,
         unnest([trim(regexp_replace(item, '\\s+', ' ', 'g')), length(item)::VARCHAR, n::VARCHAR]) FROM c)
SELECT page_id, 0::BIGINT AS table_no, 1::BIGINT AS element_index, row::BIGINT AS row, "column"::BIGINT AS "column", header, text
FROM cells""",
    "filter_promoted": f"""
WITH {_batch(3, pairs="e.label IN (1, 3) AND e.vec_id % 2 = 0")}
SELECT {_TOP_COLUMNS} FROM top""",
    "chunk_basic": f"WITH RECURSIVE {_packed(False)} {_CHUNK_ROWS}",
    "chunk_by_title": f"WITH RECURSIVE {_packed(True)} {_CHUNK_ROWS}",
    "chunk_windows": f"""
SELECT doc_id, pos // 800 AS chunk_index, w AS content
FROM documents, LATERAL {_windows('text', '1000', '200')} AS x""",
    "chunk_metadata": f"""
WITH pieces AS (
  SELECT doc_id, pos, {_strip('w')} AS content
  FROM documents, LATERAL {_windows('text', '100', '20')} AS x),
kept AS (SELECT * FROM pieces WHERE content <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_index, content,
       'windows' AS chunking_strategy, length(content) AS chunk_size,
       'NarrativeText' AS element_type, 1::BIGINT AS page_number,
       count(*) OVER (PARTITION BY doc_id) AS total_chunks
FROM kept""",
    "chunk_params_by_type": f"""
WITH typed AS (
  SELECT doc_id, text,
         CASE lang WHEN 'en' THEN 'contracts' WHEN 'de' THEN 'reports' ELSE lang END
           AS document_type FROM documents),
sized AS (
  SELECT *, CASE document_type WHEN 'contracts' THEN 800 WHEN 'reports' THEN 600 ELSE 400 END
              AS size,
            CASE document_type WHEN 'contracts' THEN 100 WHEN 'reports' THEN 75 ELSE 50 END
              AS overlap FROM typed)
SELECT doc_id, document_type, pos // (size - overlap) AS chunk_index, w AS content
FROM sized, LATERAL {_windows('text', 'size', 'overlap')} AS x""",
    "merge_metadata": """
SELECT doc_id, 'lang=' || lang || ';n_chars=' || n_chars || ';quality='
       || coalesce(quality::VARCHAR, 'NULL') || ';source=' || upper(source) AS fields
FROM documents LEFT JOIN labels USING (doc_id)""",
    "ingest_summary": f"""
WITH RECURSIVE {_packed(False)},
e AS (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM chunks
      WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]') GROUP BY doc_id)
SELECT d.doc_id::VARCHAR AS doc_uri, coalesce(e.n, 0) AS elements_extracted,
       coalesce(c.n, 0) AS embeddings_generated, coalesce(c.n, 0) AS chunks_stored,
       CASE WHEN coalesce(e.n, 0) = 0 THEN 'no content' ELSE 'stored' END AS status
FROM documents d LEFT JOIN e USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "clean_texts": f"""
SELECT doc_id, left({_strip('text')}, 8000) AS content,
       length(left({_strip('text')}, 8000)) AS n
FROM documents WHERE {_strip('text')} <> ''""",
    "embed_texts": f"""
WITH cleaned AS (
  SELECT doc_id, {_strip('text')} AS t FROM documents WHERE {_strip('text')} <> '')
SELECT doc_id, length(t)::DOUBLE AS v0,
       (length(t) - length(replace(t, 'e', '')))::DOUBLE AS v1,
       (length(t) - length(replace(t, 'n', '')))::DOUBLE AS v2,
       (length(t) - length(replace(t, 'q', '')))::DOUBLE AS v3
FROM cleaned""",
    "embed_hashed": f"""WITH {_hashed('v', 'documents', 'doc_id', 64)}
SELECT doc_id, bucket, round(value, 6) AS value FROM v""",
    "embed_queries": f"""
WITH asked AS (
  SELECT conv_id, turn, {_strip('text')} AS t FROM conversations
  UNION ALL SELECT conv_id, -1 - turn, '' FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE WHEN t = '' THEN 0 ELSE 4 END::BIGINT AS dims,
       CASE WHEN t <> '' THEN (length(t) - length(replace(t, 'e', '')))::DOUBLE END AS v1
FROM asked""",
    "validate_embeddings": """
SELECT doc_id AS chunk_id,
       CASE WHEN label IS NULL THEN 'no embedding' ELSE 'wrong width' END AS problem
FROM documents LEFT JOIN embeddings ON doc_id = vec_id
WHERE label IS NULL OR label % 2 = 1""",
    "vector_search": _single(10),
    "similarity_score": f"""
SELECT e.vec_id, round({_SCORE}, 6) AS similarity_score, round({_COSINE}, 6) AS cosine
FROM embeddings e, {_LAST} q""",
    "threshold_filter": _single(50, outer="score >= 0.68"),
    "filter_post": _single(50, outer="label = 3 AND score >= 0.6"),
    "filter_post_list": _single(50, outer="label IN (1, 3, 8) AND score >= 0.6"),
    "filter_pre_range": _single(50, inner="label >= 3 AND label < 6 AND vec_id % 2 = 0"),
    "filter_pre": _single(50, inner="label = 3", outer="score >= 0.6"),
    "search_batch": f"""WITH {_batch(5)}
SELECT {_TOP_COLUMNS}, label::BIGINT AS label FROM top WHERE score >= 0.65""",
    "search_batch_filtered": f"""WITH {_batch(10)}
SELECT query_id, vec_id, round(score, 6) AS similarity_score,
       row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
FROM top WHERE label = 3""",
    "search_ann_all_buckets": f"WITH {_batch(5)} SELECT {_TOP_COLUMNS} FROM top",
    "search_learned": f"""WITH {_LISTED},
near AS (
  SELECT v.vec_id AS query_id, c.cell,
         row_number() OVER (PARTITION BY v.vec_id ORDER BY list_inner_product(v.e, c.x) DESC, c.cell) AS place
  FROM unit v, centres c),
{_batch(5, pairs="(q.vec_id, (SELECT cell FROM listed l WHERE l.vec_id = e.vec_id)) IN (SELECT (query_id, cell) FROM near WHERE place <= 4)")}
SELECT {_TOP_COLUMNS} FROM top WHERE score >= 0.6""",
    "build_learned_index": f"""WITH {_LISTED}
SELECT vec_id, label::BIGINT AS label, cell::BIGINT AS list_no FROM listed JOIN embeddings USING (vec_id)""",
    "search_learned_recall": """
SELECT true AS recall_reached, count(*) AS queries, count(*) AS rows_indexed FROM embeddings""",
    "index_segments": f"""WITH {_batch(5)}
SELECT {_TOP_COLUMNS}, unnest(['not indexed', 'two segments', 'merged']) AS state FROM top""",
    "search_collections": f"""
WITH {_batch(3, pairs="e.label % 3 IN (0, 2)", group="e.label % 3")}
SELECT {_TOP_COLUMNS}, 'part_' || grp AS collection_name FROM top""",
    "unmatched_queries": f"""
WITH {_batch(5, pairs="q.label < 5 AND e.label >= 5")}
SELECT vec_id AS query_id, {_quoted(NO_HIT_ADVICE)} AS advice FROM embeddings
WHERE label < 5 AND vec_id NOT IN (SELECT query_id FROM top WHERE score >= 0.68)""",
    "validate_requests": f"""
WITH requests AS (
  SELECT conv_id, turn, {_strip('text')} AS t, length(text) % 60 - 4 AS lim,
         (length(text) % 14 - 1) / 10.0 AS threshold
  FROM conversations
  UNION ALL SELECT conv_id, -1 - turn, '', 5, 0.5 FROM conversations WHERE turn % 5 = 4)
SELECT conv_id, turn, lim::BIGINT AS "limit",
       CASE WHEN t = '' THEN 'query text is blank'
            WHEN lim NOT BETWEEN 1 AND 50 THEN 'limit is outside 1 to 50'
            WHEN threshold NOT BETWEEN 0 AND 1
              THEN 'similarity threshold is outside 0 to 1' END AS error
FROM requests""",
    "format_hits": f"""WITH RECURSIVE {_ranked_chunks(3, 0.7)}
SELECT query_id, rank, {_SCORE_TEXT} AS score,
       CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END
         AS excerpt,
       'document_url: ' || document_url || ', chunk_index: ' || chunk_index || ', lang: ' || lang
         || ', source: ' || source AS source
FROM hits""",
    "source_attribution": f"""WITH RECURSIVE {_ranked_chunks(3, 0.7)}
SELECT query_id, rank, 'File: ' || doc_id || '.txt | Page: ' || page_number || ' | Chunk: '
       || chunk_index AS attribution FROM hits""",
    "build_context": f"""WITH RECURSIVE {_ranked_chunks(3, 0.7)}
SELECT query_id, {_CONTEXT} AS context FROM hits GROUP BY query_id""",
    "build_prompts": f"""WITH RECURSIVE {_ranked_chunks(3, 0.7)},
contexts AS (SELECT query_id, {_CONTEXT} AS context FROM hits GROUP BY query_id)
SELECT query_id, {_quoted(SYSTEM_PROMPT)} AS system_prompt,
       {_user_prompt('text', 'context')} AS user_prompt
FROM contexts JOIN benchmark ON item_id = query_id""",
    "apply_model": f"""
SELECT doc_id, length({_user_prompt("'Document ' || doc_id", 'text')}) || ' characters after '
       || length({_quoted(SYSTEM_PROMPT)}) AS answer
FROM documents""",
    "answer_summary": f"""WITH RECURSIVE {_ranked_chunks(3, 0.7)}
SELECT query_id, count(*) AS sources_consulted, 'documents' AS collection_name,
       {_SCORES} AS similarity_scores FROM hits GROUP BY query_id""",
    "list_collections": "SELECT DISTINCT lang || '_docs' AS collection_name FROM documents",
    "catalog": """
SELECT lang || '_docs' AS collection_name, count(*) AS document_count,
       sum(strlen(text) + 8)::BIGINT AS size_bytes, true AS stored, true AS one_file_or_more
FROM documents GROUP BY lang
UNION ALL SELECT 'empty_docs', 0, 0, false, false""",
    "live_collection": f"""
WITH RECURSIVE files AS (
  SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0
  UNION ALL
  SELECT -1 - doc_id // 50, string_agg(text, {NL} ORDER BY doc_id)
  FROM documents WHERE doc_id % 2 = 1 GROUP BY doc_id // 50),
{_packed(True, "files")} {_CHUNK_ROWS}""",
    "collection_stats": """
SELECT lang || '_docs' AS collection_name, count(*) AS document_count,
       sum(strlen(text) + 8)::BIGINT AS size_bytes, round(avg(strlen(text) + 8), 6) AS avg_obj_size
FROM documents GROUP BY lang""",
    "route_collection": """
SELECT doc_id,
       CASE doc_id % 5
         WHEN 0 THEN 'all_documents'
         WHEN 1 THEN coalesce(nullif(lang, 'fr'), 'general') || '_docs'
         WHEN 2 THEN 'user_' || coalesce(nullif(source, 'src1'), 'anonymous') || '_docs'
         WHEN 3 THEN coalesce(nullif(source, 'src2'), 'default') || '_'
                     || coalesce(nullif(lang, 'fr'), 'general') || '_docs'
         ELSE 'default_collection' END AS collection_name
FROM documents""",
    "index_coverage": """
SELECT DISTINCT source || '_' || lang || '_docs' AS collection_name,
       CASE WHEN lang = 'fr' THEN 'NEEDS INDEX' ELSE 'EXISTS' END AS status
FROM documents""",
    "build_index": """
SELECT vec_id, label::BIGINT AS label, 3::BIGINT AS rows, 3::BIGINT AS tables,
       round(embedding[1]::DOUBLE, 6) AS first_component,
       round(embedding[64]::DOUBLE, 6) AS last_component
FROM embeddings""",
    "build_index_rows": """
SELECT vec_id, label::BIGINT AS label, 3::BIGINT AS rows, 3::BIGINT AS tables FROM embeddings""",
    "ingest_documents": f"""WITH RECURSIVE {_packed(True)},
kept AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM chunks),
stored AS (SELECT * FROM kept WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]'))
SELECT s.doc_id, chunk_index::BIGINT AS chunk_index, content, element_type, total_chunks,
       strlen(d.text)::BIGINT AS file_size, s.doc_id || '.txt' AS source_file, lang,
       count(*) OVER () AS chunks_stored
FROM stored s JOIN documents d USING (doc_id)""",
    "ingest_partial": f"""WITH RECURSIVE {_packed(True)},
judged AS (
  SELECT doc_id, chunk_index,
         CASE WHEN length(content) % 5 = 0 THEN 'ValueError: length'
              WHEN length(content) % 7 = 0 THEN 'no embedding' END AS cause
  FROM chunks),
counted AS (
  SELECT doc_id, count(*) AS made, count(*) FILTER (WHERE cause IS NULL) AS stored,
         arg_min(cause, chunk_index) FILTER (WHERE cause IS NOT NULL) AS cause
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(made, 0) AS chunks_made, coalesce(stored, 0) AS chunks_stored,
       coalesce(made - stored, 0) AS chunks_lost,
       CASE WHEN stored < made THEN 'embedding count differs from chunk count'
            WHEN made > 0 THEN 'stored' ELSE 'no content' END AS status,
       c.cause,
       CASE WHEN stored < made THEN 'stored' WHEN made > 0 THEN 'skipped' ELSE 'no content' END AS "then",
       coalesce(made, 0) AS chunks_held
FROM documents d LEFT JOIN counted c USING (doc_id)""",
    "search_documents": f"""WITH RECURSIVE {_ranked_chunks(5, 0.7)}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, chunk_id,
       round(score, 6) AS similarity_score, {_SCORE_TEXT} AS score,
       CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END
         AS excerpt
FROM hits WHERE lang = 'en'""",
    "query_contract": f"""WITH RECURSIVE {_ranked_chunks(3, 0.7)},
found AS (
  SELECT query_id, {_CONTEXT} AS context, count(*) AS n, {_SCORES} AS scores
  FROM hits GROUP BY query_id)
SELECT item_id AS query_id, context, {_user_prompt('text', 'context')} AS user_prompt,
       coalesce(n, 0) AS sources_consulted, scores AS similarity_scores,
       CASE WHEN context IS NULL THEN {_quoted(NO_HIT_ADVICE)} END AS advice
FROM benchmark LEFT JOIN found ON item_id = query_id""",
}
