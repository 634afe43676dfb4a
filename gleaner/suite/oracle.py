"""The same queries as SQL over the same tables."""

from __future__ import annotations

from gleaner.functions.prompts import ECHO_ABSTAIN, ECHO_LEAD, PROMPT_CONTEXT, PROMPT_HEAD, PROMPT_TAIL

ORACLE: dict[str, str] = {}


def _text(value: str) -> str:
    """SQL literal with newlines kept."""
    return "'" + value.replace("'", "''") + "'"


NL = "chr(10)"


def _normalized(text: str) -> str:
    lf = f"replace(replace({text}, chr(13)||{NL}, {NL}), chr(13), {NL})"
    lines = f"list_transform(string_split({lf}, {NL}), lambda l: regexp_replace(l, '\\s+$', ''))"
    joined = f"array_to_string({lines}, {NL})"
    return f"regexp_replace({joined}, '\\n{{4,}}', repeat({NL}, 3), 'g')"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda t: t <> '')"


SENTENCES = r"[^.!?]*[.!?]+[ \t\n\r]*|[^.!?]+"

DOCS = f"""
docs AS (
  SELECT source || '/' || doc_id AS doc_id, {_normalized('text')} AS body,
         sha256(replace(replace(text, chr(13)||{NL}, {NL}), chr(13), {NL})) AS raw_hash
  FROM documents)"""

CHUNKS = DOCS + """,
chunks AS (
  SELECT sha256(doc_id || ':' || s || ':' || substring(body, s + 1, 800))[1:16] AS chunk_id,
         doc_id, s AS char_start, substring(body, s + 1, 800) AS text
  FROM (SELECT doc_id, body, unnest(range(0, CASE WHEN length(body) = 0 THEN 0
          WHEN length(body) <= 800 THEN 1
          ELSE CAST(ceil((length(body) - 800) / 680.0) AS BIGINT) + 1 END)) * 680 AS s FROM docs)
  WHERE regexp_matches(substring(body, s + 1, 800), '\\S'))"""

TERMS = CHUNKS + f""",
tok AS (SELECT chunk_id, doc_id, char_start, text, {_tokens('text')} AS toks FROM chunks),
postings AS (
  SELECT chunk_id, doc_id, char_start, dl, term, count(*) AS tf
  FROM (SELECT chunk_id, doc_id, char_start, len(toks) AS dl, unnest(toks) AS term FROM tok)
  GROUP BY ALL),
stats AS (SELECT count(*) AS n, sum(len(toks)) AS tokens, avg(len(toks)) AS avgdl FROM tok),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
mean_idf AS (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) AS m FROM dfs, stats),
idfs AS (
  SELECT term, df, CASE WHEN ln(n - df + 0.5) - ln(df + 0.5) < 0 THEN 0.25 * m
                        ELSE ln(n - df + 0.5) - ln(df + 0.5) END AS idf
  FROM dfs, stats, mean_idf)"""

BM25 = TERMS + f""",
asked AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS question FROM benchmark),
qtok AS (SELECT query_id, {_tokens('question')} AS toks FROM asked),
qplace AS (SELECT query_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS place FROM qtok),
qterms AS (SELECT query_id, term, count(*) AS qf FROM qplace GROUP BY ALL),
matched AS (
  SELECT query_id, chunk_id, doc_id, char_start,
         list_reduce(list(idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) ORDER BY place), lambda a, b: a + b) AS score
  FROM postings JOIN qplace USING (term) JOIN idfs USING (term), stats GROUP BY ALL),
scored AS (
  SELECT a.query_id, c.chunk_id, c.doc_id, c.char_start, coalesce(m.score, 0) AS score
  FROM asked a CROSS JOIN chunks c
  LEFT JOIN matched m ON m.query_id = a.query_id AND m.chunk_id = c.chunk_id),
lexical AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
           string_split(doc_id, '/'), char_start) AS rank
  FROM scored),
results AS (
  SELECT l.*, c.text, string_split(doc_id, '/')[-1] AS title, doc_id || '.txt' AS path
  FROM lexical l JOIN (SELECT chunk_id, text FROM chunks) c USING (chunk_id))"""

GOLD = """
gold AS (
  SELECT CAST(b.item_id AS VARCHAR) AS query_id, b.text AS question,
         coalesce(list_sort(list(d.source || '/' || d.doc_id) FILTER (d.doc_id IS NOT NULL)),
                  []::VARCHAR[]) AS gold_doc_ids
  FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY ALL)"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"


def _units(pattern: str, source: str) -> str:
    """Rows of consecutive units with their offsets."""
    return f"""
  SELECT doc_id, idx, length(unit) AS n_chars, unit,
         coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY idx
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start
  FROM (SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS idx
        FROM (SELECT doc_id, regexp_extract_all({source}, '{pattern}') AS us FROM docs))"""


# ---------------------------------------------------------------- text functions

ORACLE["normalize_text"] = _with(DOCS, """
SELECT doc_id, length(body)::BIGINT AS n_chars, sha256(body) AS digest FROM docs""")

MD = f"'# ' || source || {NL} || {NL} || replace(text, {NL}, {NL} || {NL})"
MD_DOCS = f"""
docs AS (SELECT source || '/' || doc_id AS doc_id, {_normalized(MD)} AS body,
                sha256({MD}) AS raw_hash, source FROM documents)"""

ORACLE["document_records"] = _with(MD_DOCS, """
SELECT doc_id, source AS title, 'markdown' AS format, raw_hash, source AS source_group FROM docs""")

ORACLE["source_groups"] = """
SELECT source AS source_group, count(*)::BIGINT AS documents, sum(length(text))::BIGINT AS chars
FROM documents GROUP BY source"""

ORACLE["split_sentences"] = _with(DOCS, f"""
SELECT doc_id, char_start::BIGINT AS char_start, n_chars::BIGINT AS n_chars
FROM ({_units(SENTENCES, 'body')})""")

BLOCKS = MD_DOCS + f""",
raw AS ({_units('(?s:.*?' + chr(92) + 'n{2,}|.+)', 'body')}),
flagged AS (
  SELECT *, regexp_matches(unit, '^[ \\t]*#{{1,6}}[ \\t]')
            AND NOT regexp_matches(rtrim(unit, {NL}), '\\n') AS heading FROM raw),
grouped AS (
  SELECT *, coalesce(sum(CASE WHEN heading THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id
             ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM flagged),
blocks AS (
  SELECT doc_id, g, min(char_start) AS char_start, sum(n_chars) AS n_chars,
         string_agg(unit, '' ORDER BY idx) AS unit
  FROM grouped GROUP BY doc_id, g)"""

ORACLE["split_blocks"] = _with(BLOCKS, """
SELECT doc_id, char_start::BIGINT AS char_start, n_chars::BIGINT AS n_chars FROM blocks""")

# ---------------------------------------------------------------- preparation

TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"
URL_TITLE = (
    "coalesce(trim(regexp_replace(regexp_replace(regexp_replace(url_decode(replace("
    f"list_filter(string_split({PATH}, '/'), lambda s: s <> '')[-1], '+', '%2B')), "
    "'\\.(html?|mdx?)$', '', 'i'), '[-_]+', ' ', 'g'), '\\s+', ' ', 'g')), '')"
)

ORACLE["url_titles"] = f"""
SELECT page_id, {URL_TITLE} AS url_title, regexp_replace(url, '/+$', '') AS provider_url
FROM pages"""

ORACLE["resolve_titles"] = f"""
SELECT page_id,
  CASE WHEN NOT starts_with(url, 'http:') AND trim({TITLE}) <> '' THEN trim({TITLE})
       WHEN {URL_TITLE} <> '' THEN {URL_TITLE} ELSE CAST(page_id AS VARCHAR) END AS title,
  CASE WHEN NOT starts_with(url, 'http:') AND trim({TITLE}) <> '' THEN 'dataset_title'
       WHEN {URL_TITLE} <> '' THEN 'source_url_path' ELSE 'original_doc_id' END AS method
FROM pages"""


def _slug(text: str) -> str:
    kept = f"regexp_replace(trim(lower({text})), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')"
    dashed = f"regexp_replace(regexp_replace({kept}, '[\\s_]+', '-', 'g'), '-+', '-', 'g')"
    return f"coalesce(nullif(trim(substring({dashed}, 1, 80), '-'), ''), 'doc')"


ORACLE["slugs"] = f"SELECT page_id, {_slug(TITLE)} AS slug FROM pages"

ORACLE["markdown_headings"] = f"""
SELECT doc_id, source || ' ' || lang AS heading,
       sha256('# ' || lang || {NL} || {NL} || trim(text, ' ' || {NL} || chr(9) || chr(13)) || {NL})
         AS markdown_digest
FROM documents"""

FIRST = """
first_docs AS (
  SELECT doc_id, source, digest FROM (
    SELECT doc_id, source, lang, sha256(text) AS digest,
           row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
  WHERE rn = 1)"""

ORACLE["first_wins_documents"] = _with(FIRST, "SELECT doc_id, source, digest FROM first_docs")

ORACLE["prepared_documents"] = f"""
SELECT digest AS doc_id, title, 'dataset_title' AS title_resolution, digest AS slug,
       'docs/' || digest || '.md' AS prepared_id,
       sha256('# ' || title || {NL} || {NL} || trim(text, ' ' || {NL} || chr(9) || chr(13)) || {NL})
         AS markdown_digest
FROM (SELECT sha256(text) AS digest, source || ' ' || lang AS title, text,
             row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1"""

ORACLE["gold_id_translation"] = _with(GOLD + "," + FIRST + f""",
id_map AS (
  SELECT source || '/' || doc_id AS raw,
         'docs/' || {_slug("source || '/' || doc_id")} || '.md' AS prepared FROM first_docs),
ids AS (
  SELECT query_id, unnest(gold_doc_ids) AS raw, generate_subscripts(gold_doc_ids, 1) AS pos
  FROM gold),
lists AS (
  SELECT query_id, string_agg(coalesce(prepared, raw), '|' ORDER BY pos) AS ids,
         count(*) FILTER (prepared IS NULL) AS unknown
  FROM ids LEFT JOIN id_map USING (raw) GROUP BY query_id)""", """
SELECT query_id AS question_id, coalesce(ids, '') AS gold_doc_ids,
       coalesce(unknown, 0)::BIGINT AS unknown_ids
FROM gold LEFT JOIN lists USING (query_id)""")

# ---------------------------------------------------------------- chunking

ORACLE["chunk_fixed"] = _with(CHUNKS, """
SELECT chunk_id, doc_id, char_start::BIGINT AS char_start,
       (char_start + length(text))::BIGINT AS char_end, sha256(text) AS digest FROM chunks""")


def _packed(name: str, units: str, size: int) -> str:
    """Greedy packing as a walk over numbered units (key, idx, s, e)."""
    return f"""
{name}_walk AS (
  SELECT key, idx, s AS cs, s, e, e - s > {size} AS big, 1 AS no FROM {units} WHERE idx = 1
  UNION ALL
  SELECT u.key, u.idx,
         CASE WHEN u.e - u.s <= {size} AND NOT w.big AND u.e - w.cs <= {size} THEN w.cs ELSE u.s END,
         u.s, u.e, u.e - u.s > {size},
         CASE WHEN u.e - u.s <= {size} AND NOT w.big AND u.e - w.cs <= {size} THEN w.no
              ELSE w.no + 1 END
  FROM {name}_walk w JOIN {units} u ON u.key = w.key AND u.idx = w.idx + 1),
{name} AS (
  SELECT key, no, min(s) AS s, max(e) AS e, bool_or(big) AS big FROM {name}_walk GROUP BY key, no)"""


STRUCTURAL = BLOCKS + """,
bu AS (
  SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) AS idx,
         char_start AS s, char_start + n_chars AS e FROM blocks),""" + _packed("tier1", "bu", 400) + f""",
big1 AS (
  SELECT key || '@' || s AS key, key AS doc_id, s AS base,
         regexp_extract_all(substring(body, (s + 1)::BIGINT, (e - s)::BIGINT), '{SENTENCES}') AS us
  FROM tier1 JOIN docs ON docs.doc_id = tier1.key WHERE big),
su0 AS (
  SELECT key, doc_id, base, unnest(us) AS unit, generate_subscripts(us, 1) AS idx FROM big1),
su AS (
  SELECT key, doc_id, idx, base + sum(length(unit)) OVER w - length(unit) AS s,
         base + sum(length(unit)) OVER w AS e FROM su0
  WINDOW w AS (PARTITION BY key ORDER BY idx)),""" + _packed("tier2", "su", 400) + """,
windows AS (
  SELECT key, s + 340 * i AS s, least(s + 340 * i + 400, e) AS e FROM (
    SELECT key, s, e, unnest(range(0, CAST(ceil((e - s - 400) / 340.0) AS BIGINT) + 1)) AS i
    FROM tier2 WHERE big)),
spans AS (
  SELECT key AS doc_id, s, e FROM tier1 WHERE NOT big
  UNION ALL SELECT string_split(key, '@')[1], s, e FROM tier2 WHERE NOT big
  UNION ALL SELECT string_split(key, '@')[1], s, e FROM windows),
cut AS (
  SELECT doc_id, s::BIGINT AS s, e::BIGINT AS e, substring(body, s::BIGINT + 1, (e - s)::BIGINT) AS text
  FROM spans JOIN docs USING (doc_id))"""

ORACLE["chunk_structural"] = _with(STRUCTURAL, """
SELECT sha256(doc_id || ':' || s || ':' || text)[1:16] AS chunk_id, doc_id, s AS char_start,
       e AS char_end, sha256(text) AS digest
FROM cut WHERE regexp_matches(text, '\\S')""", recursive=True)

ORACLE["chunk_fan_out"] = _with(STRUCTURAL + """,
starts AS (
  SELECT doc_id, body, unnest(range(0, CASE WHEN length(body) = 0 THEN 0 WHEN length(body) <= 400 THEN 1
         ELSE CAST(ceil((length(body) - 400) / 340.0) AS BIGINT) + 1 END)) * 340 AS s FROM docs),
both_cut AS (
  SELECT 'structural' AS index_id, doc_id, s, e, text FROM cut
  UNION ALL
  SELECT 'fixed', doc_id, s, s + length(substring(body, s + 1, 400)), substring(body, s + 1, 400) FROM starts)""", """
SELECT index_id, sha256(doc_id || ':' || s || ':' || text)[1:16] AS chunk_id, doc_id, s AS char_start,
       e AS char_end, sha256(text) AS digest
FROM both_cut WHERE regexp_matches(text, '\\S')""", recursive=True)

# ---------------------------------------------------------------- lexical

ORACLE["chunk_tokens"] = _with(TERMS, """
SELECT chunk_id, len(toks)::BIGINT AS tokens, len(list_distinct(toks))::BIGINT AS distinct_tokens
FROM tok""")

ORACLE["term_statistics"] = _with(TERMS, """
SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM idfs""")

ORACLE["corpus_statistics"] = _with(TERMS, """
SELECT n::BIGINT AS chunks, tokens::BIGINT AS tokens, round(avgdl, 6) AS mean_length,
       (SELECT count(*) FROM dfs)::BIGINT AS vocabulary, round(m, 6) AS mean_idf
FROM stats, mean_idf""")

ORACLE["bm25_top_k"] = _with(BM25, """
SELECT query_id, rank::BIGINT AS rank, chunk_id, doc_id, round(score, 6) AS score
FROM lexical WHERE rank <= 5""")

ORACLE["bm25_explanation"] = _with(BM25, """
SELECT l.query_id, l.chunk_id, l.rank::BIGINT AS rank, len(k.toks)::BIGINT AS document_length,
       q.term, q.qf::BIGINT AS query_frequency, coalesce(p.tf, 0)::BIGINT AS term_frequency,
       coalesce(i.df, 0)::BIGINT AS document_frequency,
       round(coalesce(i.idf, 0), 6) AS inverse_document_frequency,
       round(coalesce(q.qf * i.idf * (p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / avgdl))), 0), 6)
         AS contribution
FROM lexical l JOIN tok k USING (chunk_id) JOIN qterms q ON q.query_id = l.query_id
LEFT JOIN idfs i ON i.term = q.term
LEFT JOIN postings p ON p.chunk_id = l.chunk_id AND p.term = q.term, stats
WHERE l.rank <= 3""")

# ---------------------------------------------------------------- dense

DENSE = """
centroids AS (
  SELECT label AS q, list(x ORDER BY dim) AS vector FROM (
    SELECT label, dim, avg(x::DOUBLE) AS x FROM (
      SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim
      FROM embeddings) GROUP BY label, dim) GROUP BY label),
by_centroid AS (
  SELECT CAST(q AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS chunk_id, vec_id, label,
         vector, embedding::DOUBLE[] AS emb,
         list_cosine_similarity(vector, embedding::DOUBLE[]) AS score
  FROM centroids, embeddings),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id
           ORDER BY floor(score * 1e9 + 0.5) DESC, vec_id DESC) AS rank FROM by_centroid)"""

ORACLE["dense_top_k_by_label"] = _with(DENSE, """
SELECT query_id, rank::BIGINT AS rank, chunk_id, round(score, 6) AS score
FROM ranked WHERE rank <= 10""")

ORACLE["dense_filtered"] = _with(DENSE, """
SELECT query_id, rank::BIGINT AS rank, chunk_id, round(score, 6) AS score FROM (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
         ORDER BY floor(score * 1e9 + 0.5) DESC, vec_id DESC) AS rank
  FROM by_centroid WHERE query_id = CAST(label AS VARCHAR))
WHERE rank <= 5""")

ORACLE["dense_explanation"] = _with(DENSE, """
SELECT query_id, chunk_id, rank::BIGINT AS rank, len(vector)::BIGINT AS dimension,
       round(sqrt(list_dot_product(vector, vector)), 6) AS query_norm,
       round(sqrt(list_dot_product(emb, emb)), 6) AS chunk_norm,
       round(list_dot_product(vector, emb), 6) AS dot_product,
       round(score, 6) AS cosine_similarity, round(vector[3], 6) AS query_preview_3,
       round(emb[3], 6) AS chunk_preview_3
FROM ranked WHERE rank <= 5""")

ORACLE["vector_units"] = """
SELECT vec_id, round(n, 6) AS length, round(e[1] / n, 6) AS first,
       len(list_filter(e, lambda x: abs(x / n - x) > 1e-5)) = 0 AS is_unit
FROM (SELECT vec_id, embedding::DOUBLE[] AS e,
             sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)"""


def _metrics(retrieved: str, gold: str) -> str:
    return f"""
  len(list_intersect({retrieved}, {gold})) > 0 AS hit,
  round(coalesce(1.0 / list_position(list_transform({retrieved},
        lambda d: list_contains({gold}, d)), true), 0), 6) AS reciprocal_rank,
  round(CASE WHEN len({retrieved}) = 0 THEN 0 ELSE len(list_filter({retrieved},
        lambda d: list_contains({gold}, d))) / len({retrieved}) END, 6) AS context_precision,
  round(CASE WHEN len({gold}) = 0 THEN 0
        ELSE len(list_distinct(list_intersect({retrieved}, {gold}))) / len({gold}) END, 6)
        AS context_recall"""


def _means(of: str) -> str:
    return f"""count(*)::BIGINT AS n_questions, round(avg(hit::INT), 6) AS hit_rate,
       round(avg(rr), 6) AS mrr, round(avg(cp), 6) AS mean_context_precision,
       round(avg(cr), 6) AS mean_context_recall FROM {of}"""


def _raw_metrics(retrieved: str, gold: str) -> str:
    return (
        _metrics(retrieved, gold).replace(", 6) AS reciprocal_rank", ", 15) AS rr")
        .replace(", 6) AS context_precision", ", 15) AS cp")
        .replace(", 6)\n        AS context_recall", ", 15) AS cr")
    )


ORACLE["dense_label_eval"] = _with(DENSE + """,
lists AS (SELECT query_id, list(CAST(label AS VARCHAR) ORDER BY rank) AS r FROM ranked
          WHERE rank <= 10 GROUP BY query_id)""",
    f"SELECT query_id, {_metrics('r', '[query_id]')} FROM lists")

# ---------------------------------------------------------------- fusion

FUSED = DENSE + """,
exemplars AS (SELECT label AS q, arg_min(embedding, vec_id)::DOUBLE[] AS vector
              FROM embeddings GROUP BY label),
by_exemplar AS (
  SELECT CAST(q AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS chunk_id, vec_id,
         list_cosine_similarity(vector, embedding::DOUBLE[]) AS score FROM exemplars, embeddings),
lists AS (
  SELECT 0 AS src, 'centroid' AS source, query_id, chunk_id, score, rank FROM ranked WHERE rank <= 20
  UNION ALL
  SELECT 1, 'exemplar', query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id
           ORDER BY floor(score * 1e9 + 0.5) DESC, vec_id DESC) AS rank FROM by_exemplar)
  WHERE rank <= 20),
sums AS (
  SELECT query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(src * 1000 + rank) AS seen
  FROM lists GROUP BY ALL),
fused AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
                 ORDER BY floor(score * 1e9 + 0.5) DESC, seen) AS rank FROM sums)
  WHERE rank <= 10)"""

ORACLE["rank_fusion"] = _with(FUSED, """
SELECT query_id, rank::BIGINT AS rank, chunk_id, round(score, 9) AS score FROM fused""")

ORACLE["rank_fusion_sources"] = _with(FUSED, """
SELECT query_id, chunk_id, source, l.rank::BIGINT AS rank, round(l.score, 6) AS score,
       round(1.0 / (60 + l.rank), 9) AS contribution
FROM lists l JOIN (SELECT query_id, chunk_id FROM fused) USING (query_id, chunk_id)""")

ORACLE["fused_score_components"] = _with(FUSED, """
SELECT query_id, chunk_id, 'rrf_score' AS component, round(score, 6) AS value FROM fused
UNION ALL
SELECT query_id, chunk_id, source || '_score', round(l.score, 6)
FROM lists l JOIN (SELECT query_id, chunk_id FROM fused) USING (query_id, chunk_id)
UNION ALL
SELECT query_id, chunk_id, source || '_rank', l.rank::DOUBLE
FROM lists l JOIN (SELECT query_id, chunk_id FROM fused) USING (query_id, chunk_id)""")

# ---------------------------------------------------------------- dispatch

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _letters(text: str) -> str:
    counts = (f"length({text}) - length(translate({text}, '{c}{c.upper()}', ''))" for c in LETTERS)
    return f"[{', '.join(counts)}]::DOUBLE[]"


ORACLE["retrieval_components"] = _with(BM25 + f""",
counted AS (SELECT chunk_id, doc_id, char_start, {_letters('text')} AS emb FROM chunks),
asked_counts AS (SELECT query_id, {_letters('question')} AS vector FROM asked),
near AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
         ORDER BY floor(score * 1e9 + 0.5) DESC, string_split(doc_id, '/') DESC, char_start DESC) AS rank
  FROM (SELECT query_id, chunk_id, doc_id, char_start,
               CASE WHEN list_sum(vector) = 0 OR list_sum(emb) = 0 THEN 0
                    ELSE list_cosine_similarity(vector, emb) END AS score
        FROM asked_counts, counted)),
ways(way, dense, bm25, depth, semantics) AS (VALUES
  ('bm25', false, true, 5, 'bm25_score'), ('dense', true, false, 5, 'cosine_similarity[-1,1]'),
  ('hybrid', true, true, 5, 'reciprocal_rank_fusion'), ('reranked', true, true, 10, 'length_score')),
hits AS (
  SELECT way, 0 AS src, 'dense' AS source, query_id, chunk_id, score, rank
  FROM near JOIN ways ON rank <= depth AND dense
  UNION ALL
  SELECT way, 1, 'bm25', query_id, chunk_id, score, rank FROM lexical JOIN ways ON rank <= depth AND bm25),
sums AS (
  SELECT way, query_id, chunk_id, sum(1.0 / (60 + rank)) AS score, min(src * 1000 + rank) AS seen
  FROM hits WHERE way IN ('hybrid', 'reranked') GROUP BY ALL),
fused AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY way, query_id
                 ORDER BY floor(score * 1e9 + 0.5) DESC, seen) AS rank FROM sums)
  JOIN ways USING (way) WHERE rank <= depth),
again AS (
  SELECT way, query_id, chunk_id, score, rank AS pre_rank, -abs(length(text) - 400)::DOUBLE AS post,
         row_number() OVER (PARTITION BY query_id ORDER BY -abs(length(text) - 400) DESC, rank) AS rank
  FROM fused JOIN (SELECT chunk_id, text FROM chunks) USING (chunk_id) WHERE way = 'reranked'),
final AS (
  SELECT way, query_id, chunk_id, rank FROM hits WHERE way IN ('bm25', 'dense')
  UNION ALL SELECT way, query_id, chunk_id, rank FROM fused WHERE way = 'hybrid'
  UNION ALL SELECT way, query_id, chunk_id, rank FROM again WHERE rank <= 5),
parts AS (
  SELECT way, query_id, chunk_id, source || '_score' AS component, score AS value FROM hits
  UNION ALL SELECT way, query_id, chunk_id, source || '_rank', rank FROM hits
  UNION ALL SELECT way, query_id, chunk_id, 'rrf_score', score FROM fused
  UNION ALL SELECT way, query_id, chunk_id, 'reranker_score', post FROM again
  UNION ALL SELECT way, query_id, chunk_id, 'pre_rerank_score', score FROM again
  UNION ALL SELECT way, query_id, chunk_id, 'pre_rerank_rank', pre_rank FROM again)""", """
SELECT f.query_id || ':' || f.way AS query_id, f.rank::BIGINT AS rank, chunk_id,
       semantics AS score_semantics, component, round(value, 6) AS value
FROM final f JOIN ways USING (way) JOIN parts p USING (way, query_id, chunk_id)""")

# ---------------------------------------------------------------- reranking

AUDIT = BM25 + """,
audit AS (
  SELECT *, -abs(length(text) - 400)::DOUBLE AS post_score, row_number() OVER (
           PARTITION BY query_id ORDER BY -abs(length(text) - 400) DESC, rank) AS post_rank
  FROM results WHERE rank <= 20)"""

ORACLE["rerank_audit"] = _with(AUDIT, """
SELECT query_id, chunk_id, rank::BIGINT AS pre_rank, post_rank::BIGINT AS post_rank,
       round(score, 6) AS pre_score, round(post_score, 6) AS post_score FROM audit""")

ORACLE["rerank_movements"] = _with(AUDIT, """
SELECT query_id, chunk_id, rank::BIGINT AS pre_rank,
       CASE WHEN post_rank <= 5 THEN post_rank::BIGINT END AS final_rank,
       CASE WHEN post_rank <= 5 THEN (rank - post_rank)::BIGINT END AS rank_delta,
       CASE WHEN post_rank > 5 THEN 'dropped' WHEN rank > post_rank THEN 'moved_up'
            WHEN rank < post_rank THEN 'moved_down' ELSE 'stayed' END AS outcome
FROM audit""")

PREVIEW = f"trim(replace(substring(text, 1, 120), {NL}, ' '))"

ORACLE["reranked_traces"] = _with(AUDIT, f"""
SELECT query_id, post_rank::BIGINT AS rank, chunk_id, doc_id, title, path,
       round(post_score, 6) AS score, {PREVIEW} AS text_preview, rank::BIGINT AS pre_rerank_rank,
       round(score, 6) AS pre_rerank_score
FROM audit WHERE post_rank <= 5""")

# ---------------------------------------------------------------- context

BLOCK = (
    f"'[Source: ' || chunk_id || ']' || {NL} || 'Title: ' || title || {NL} || 'Path: ' || path"
    f" || {NL} || {NL} || text"
)


def _packing(ctes: str, k: int, budget: str, extra: str = "") -> str:
    """Greedy packing rank by rank; ``budget`` may differ per row of ``budgets``."""
    return ctes + f""",
blocks AS (
  SELECT query_id, rank, chunk_id, doc_id, title, path, text, {BLOCK} AS block,
         floor(length({BLOCK}) * 0.25)::BIGINT AS tokens
  FROM results WHERE rank <= {k}),
budgets AS (SELECT query_id, question, {budget} AS budget FROM asked {extra}),
walk AS (
  SELECT query_id, question, budget, 0::BIGINT AS rank,
         budget - 100 - floor(length(question) * 0.25)::BIGINT AS remaining, 0::BIGINT AS used,
         []::VARCHAR[] AS selected, []::VARCHAR[] AS omitted
  FROM budgets
  UNION ALL
  SELECT w.query_id, w.question, w.budget, b.rank,
         CASE WHEN remaining >= tokens THEN remaining - tokens ELSE remaining END,
         CASE WHEN remaining >= tokens THEN used + tokens ELSE used END,
         CASE WHEN remaining >= tokens THEN list_append(selected, chunk_id) ELSE selected END,
         CASE WHEN remaining >= tokens THEN omitted ELSE list_append(omitted, chunk_id) END
  FROM walk w JOIN blocks b ON b.query_id = w.query_id AND b.rank = w.rank + 1),
packed AS (SELECT * FROM walk WHERE rank = {k})"""


PACKED = _packing(BM25, 5, "520::BIGINT")
CHOSEN = PACKED + f""",
chosen AS (
  SELECT p.query_id, p.question, p.selected,
         coalesce(list(b.chunk_id ORDER BY b.rank) FILTER (b.chunk_id IS NOT NULL), []) AS ids,
         coalesce(string_agg(b.block, {NL} || {NL} ORDER BY b.rank), '') AS context,
         coalesce(string_agg('  [Source: ' || b.chunk_id || ']  ' || b.title || '  (' || b.path || ')',
                  {NL} ORDER BY b.rank), '') AS listing,
         coalesce(list(b.text ORDER BY b.rank) FILTER (b.chunk_id IS NOT NULL), []) AS texts
  FROM packed p LEFT JOIN blocks b
    ON b.query_id = p.query_id AND list_contains(p.selected, b.chunk_id)
  GROUP BY ALL),
prompted AS (
  SELECT *, {_text(PROMPT_HEAD)} || question || {_text(PROMPT_CONTEXT)} || context
            || {_text(PROMPT_TAIL)} AS prompt FROM chosen)"""

ORACLE["pack_context"] = _with(PACKED, """
SELECT query_id, array_to_string(selected, '|') AS selected, array_to_string(omitted, '|') AS omitted,
       used::BIGINT AS estimated_tokens FROM packed""", recursive=True)

ORACLE["assemble_prompts"] = _with(CHOSEN, """
SELECT query_id, length(prompt)::BIGINT AS n_chars, sha256(prompt) AS digest FROM prompted""",
    recursive=True)

ORACLE["echo_answers"] = _with(CHOSEN, f"""
SELECT query_id, CASE WHEN len(ids) = 0 THEN {_text(ECHO_ABSTAIN)}
       ELSE {_text(ECHO_LEAD)} || array_to_string(list_transform(ids,
            lambda i: '[Source: ' || i || ']'), ' ') END AS answer,
       array_to_string(ids, '|') AS citations
FROM chosen""", recursive=True)

ORACLE["citation_variants"] = _with(CHUNKS, """
SELECT doc_id, CASE WHEN a = b THEN a || '|z' ELSE b || '|' || a || '|z' END AS citations
FROM (SELECT doc_id, min(chunk_id) AS a, max(chunk_id) AS b FROM chunks GROUP BY doc_id)""")

ORACLE["source_tables"] = _with(CHOSEN, f"""
SELECT query_id, CASE WHEN len(ids) = 0 THEN 'Sources: (none)'
       ELSE 'Sources:' || {NL} || listing END AS sources FROM chosen""", recursive=True)

ORACLE["context_evidence"] = _with(PACKED, """
SELECT b.query_id, b.rank::BIGINT AS rank, b.chunk_id, 'bm25_score' AS score_semantics,
       list_contains(p.selected, b.chunk_id) AS selected_for_context
FROM blocks b JOIN packed p USING (query_id)""", recursive=True)

ORACLE["smallest_budgets"] = _with(
    _packing(BM25, 5, "b", ", (SELECT unnest(range(1, 4001)) AS b)") + """,
docs_kept AS (
  SELECT p.query_id, p.budget FROM packed p
  JOIN blocks b ON b.query_id = p.query_id AND list_contains(p.selected, b.chunk_id)
  JOIN blocks t ON t.query_id = p.query_id AND t.rank = 1 AND t.doc_id = b.doc_id
  WHERE len(p.selected) > 0 AND len(p.omitted) > 0)""", """
SELECT query_id, min(budget)::BIGINT AS budget FROM docs_kept GROUP BY query_id""", recursive=True)

ORACLE["judge_messages"] = _with(CHOSEN, f"""
SELECT query_id, sha256('Question: ' || question || {NL} || {NL} || 'Retrieved context:' || {NL}
  || array_to_string(list_transform(texts, lambda t, i: '[' || i || '] ' || t), {NL} || {NL})
  || {NL} || {NL} || 'Generated answer: An answer.' || {NL}
  || CASE WHEN len(selected) > 0 THEN {NL} || 'Citations: ' || array_to_string(selected, ', ') || {NL}
          ELSE '' END
  || {NL} || 'Reference answer: A reference.' || {NL}
  || {NL} || 'Expected facts:' || {NL} || '- ' || query_id || {NL} || '- fact' || {NL}) AS digest
FROM chosen""", recursive=True)

ORACLE["judge_replies"] = """
SELECT doc_id, quality::DOUBLE AS faithfulness, 1.0::DOUBLE AS answer_relevance,
       (1 - toxic)::DOUBLE AS citation_support, NULL::DOUBLE AS answer_correctness,
       'doc ' || doc_id AS notes FROM labels"""

ORACLE["answer_labels"] = """
SELECT doc_id, CASE WHEN quality < 0.5 THEN 'unsupported_answer'
       WHEN 1 - toxic < 0.5 THEN 'citation_mismatch' ELSE 'no_failure' END AS label FROM labels"""

ORACLE["answer_quality_report"] = """
SELECT count(*)::BIGINT AS n_questions, 'fake' AS judge, round(avg(quality), 6) AS mean_faithfulness,
       1.0::DOUBLE AS mean_answer_relevance, round(avg(1 - toxic), 6) AS mean_citation_support,
       round(avg(quality) FILTER (toxic = 0), 6) AS mean_answer_correctness FROM labels"""

ORACLE["answer_quality_text"] = f"""
SELECT printf('Answer quality report  (n=%d, judge=fake)', count(*)) || {NL} || repeat('─', 36)
  || {NL} || 'Faithfulness      :  ' || printf('%.3f', avg(quality))
  || {NL} || 'Answer Relevance  :  1.000'
  || {NL} || 'Citation Support  :  ' || printf('%.3f', avg(1 - toxic))
  || {NL} || 'Answer Correctness:  ' || printf('%.3f', avg(quality) FILTER (toxic = 0)) AS report
FROM labels"""

ORACLE["answer_evaluation"] = _with(_packing(BM25, 1, "360::BIGINT"), """
SELECT query_id, array_to_string(selected, '|') AS citations,
       CASE WHEN len(selected) = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS faithfulness,
       CASE WHEN len(selected) = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS answer_relevance,
       1.0::DOUBLE AS citation_support
FROM packed""", recursive=True)

# ---------------------------------------------------------------- evaluation

ORACLE["gold_documents"] = _with(GOLD, """
SELECT query_id, array_to_string(gold_doc_ids, '|') AS gold_doc_ids FROM gold""")


def _retrieved(source: str, rank: str, k: int) -> str:
    return (
        f"SELECT query_id, list(doc_id ORDER BY {rank}) AS r FROM {source} "
        f"WHERE {rank} <= {k} GROUP BY query_id"
    )


SCORED = BM25 + "," + GOLD + f""",
got AS ({_retrieved('results', 'rank', 5)}),
metrics AS (
  SELECT query_id, gold_doc_ids AS g, r, {_raw_metrics('r', 'gold_doc_ids')}
  FROM gold JOIN got USING (query_id))"""

ORACLE["question_metrics"] = _with(SCORED, """
SELECT query_id, hit, round(rr, 6) AS reciprocal_rank, round(cp, 6) AS context_precision,
       round(cr, 6) AS context_recall FROM metrics""")

ORACLE["retrieval_report"] = _with(SCORED, f"SELECT {_means('metrics')}")

ORACLE["retrieval_report_text"] = _with(SCORED, f"""
SELECT printf('Evaluation report  (n=%d, top_k=5, retriever=bm25)', count(*)) || {NL}
  || repeat('─', 36) || {NL} || 'Hit Rate @ 5     :  ' || printf('%.3f', avg(hit::INT)) || {NL}
  || 'MRR               :  ' || printf('%.3f', avg(rr)) || {NL}
  || 'Context Precision :  ' || printf('%.3f', avg(cp)) || {NL}
  || 'Context Recall    :  ' || printf('%.3f', avg(cr)) AS report
FROM metrics""")

RERANKED = AUDIT + "," + GOLD + f""",
got AS ({_retrieved('audit', 'post_rank', 5)}),
metrics AS (SELECT query_id, {_raw_metrics('r', 'gold_doc_ids')}
            FROM gold JOIN got USING (query_id))"""

ORACLE["reranked_report"] = _with(RERANKED, f"SELECT {_means('metrics')}")

ORACLE["catalog_checks"] = _with(SCORED, """
SELECT query_id AS question_id, array_to_string(g, '|') AS expected_document_ids,
       array_to_string(r, '|') AS retrieved_document_ids, hit FROM metrics""")

ORACLE["configuration_comparison"] = _with(AUDIT + "," + GOLD + f""",
got AS (
  SELECT 'left' AS side, * FROM ({_retrieved('results', 'rank', 3)})
  UNION ALL SELECT 'right', * FROM ({_retrieved('audit', 'post_rank', 5)})),
metrics AS (SELECT side, {_raw_metrics('r', 'gold_doc_ids')}
            FROM gold JOIN got USING (query_id))""",
    f"SELECT side, {_means('metrics')} GROUP BY side")

LABEL = """CASE WHEN len({g}) = 0 AND expected_label = 'unanswerable_query' THEN 'unanswerable_query'
       WHEN len({g}) = 0 THEN 'no_failure' WHEN NOT {h} THEN 'missing_evidence'
       WHEN {rr} < 1.0 / 3 - 1e-12 THEN 'low_rank_evidence'
       WHEN {cp} < 0.5 THEN 'distractor_evidence' ELSE 'no_failure' END"""

CASES = BM25 + "," + GOLD + f""",
b AS (SELECT query_id, gold_doc_ids AS g, {_raw_metrics('r', 'gold_doc_ids')}
      FROM gold JOIN ({_retrieved('results', 'rank', 1)}) USING (query_id)),
i AS (SELECT query_id, gold_doc_ids AS g, {_raw_metrics('r', 'gold_doc_ids')}
      FROM gold JOIN ({_retrieved('results', 'rank', 6)}) USING (query_id)),
expected AS (SELECT *, CASE WHEN len(g) = 0 THEN 'unanswerable_query' ELSE 'missing_evidence' END
             AS expected_label FROM b),
labelled AS (
  SELECT e.query_id AS case_id, expected_label,
         {LABEL.format(g='e.g', h='e.hit', rr='e.rr', cp='e.cp')} AS baseline_label,
         {LABEL.format(g='i.g', h='i.hit', rr='i.rr', cp='i.cp')} AS intervention_label,
         e.hit::INT::DOUBLE AS bh, e.cp AS bp, e.cr AS br, e.rr AS bm,
         i.hit::INT::DOUBLE AS ih, i.cp AS ip, i.cr AS ir, i.rr AS im
  FROM expected e JOIN i USING (query_id)),
changed AS (
  SELECT *, baseline_label <> 'no_failure' AND intervention_label = 'no_failure' AS fixed,
         baseline_label <> 'no_failure' AND intervention_label <> 'no_failure'
           AND baseline_label <> intervention_label AS moved FROM labelled),
per_case AS (
  SELECT *, CASE WHEN fixed THEN 'FIXED' WHEN moved THEN 'MOVED'
            WHEN baseline_label = expected_label THEN 'CONFIRMED' ELSE 'UNCHANGED' END AS outcome
  FROM changed)"""

ORACLE["diagnosis"] = _with(CASES, """
SELECT case_id, expected_label, baseline_label, intervention_label, fixed, moved, outcome,
       round(bp, 6) AS baseline_context_precision, round(im, 6) AS intervention_reciprocal_rank
FROM per_case""")

ORACLE["diagnosis_report"] = _with(CASES, """
SELECT count(*)::BIGINT AS n_cases, (count(*) FILTER (fixed))::BIGINT AS n_fixed,
       (count(*) FILTER (moved))::BIGINT AS n_moved,
       (count(*) FILTER (baseline_label = expected_label))::BIGINT AS n_confirmed
FROM per_case""")

ORACLE["diagnosis_lines"] = _with(CASES, """
SELECT case_id, 0::BIGINT AS line_no, 'Case ' || case_id || '  expected=' || expected_label AS line
FROM per_case UNION ALL
SELECT case_id, 1, '  baseline   : ' || rpad(baseline_label, 24, ' ') || printf(
  '  hit=%.3f  prec=%.3f  recall=%.3f  mrr=%.3f', bh, bp, br, bm) FROM per_case UNION ALL
SELECT case_id, 2, '  interv.    : ' || rpad(intervention_label, 24, ' ') || printf(
  '  hit=%.3f  prec=%.3f  recall=%.3f  mrr=%.3f', ih, ip, ir, im) FROM per_case UNION ALL
SELECT case_id, 3, '  ' || outcome FROM per_case UNION ALL
SELECT case_id, 4, '' FROM per_case""")

ORACLE["answer_diagnosis"] = _with(GOLD, """
SELECT query_id AS case_id, 'unsupported_answer' AS expected_label,
       'unsupported_answer' AS baseline_label, 'no_failure' AS intervention_label,
       true AS fixed, false AS moved, 'FIXED' AS outcome,
       0.25::DOUBLE AS baseline_faithfulness, 1.0::DOUBLE AS intervention_faithfulness
FROM gold WHERE len(gold_doc_ids) = 0""")

GROUPS = """
walk AS (
  SELECT query_id, chunk_id, rank, score, score AS anchor, 0 AS grp FROM items WHERE rank = 1
  UNION ALL
  SELECT n.query_id, n.chunk_id, n.rank, n.score,
         CASE WHEN abs(n.score - w.anchor) > {t} THEN n.score ELSE w.anchor END,
         CASE WHEN abs(n.score - w.anchor) > {t} THEN w.grp + 1 ELSE w.grp END
  FROM walk w JOIN items n ON n.query_id = w.query_id AND n.rank = w.rank + 1)"""

ORACLE["tie_groups"] = _with(DENSE + """,
items AS (SELECT query_id, chunk_id, rank, score FROM ranked WHERE rank <= 20),"""
    + GROUPS.format(t="0.01"), """
SELECT query_id, chunk_id, rank::BIGINT AS rank, grp::BIGINT AS tie_group FROM walk""",
    recursive=True)

ORACLE["ranking_parity"] = _with(DENSE + """,
top AS (SELECT query_id, chunk_id, rank, score, round(score, 4) AS kept FROM ranked
        WHERE rank <= 10),
items AS (SELECT query_id || '/l' AS query_id, chunk_id, rank, score FROM top
          UNION ALL SELECT query_id || '/r', chunk_id, rank, kept FROM top),"""
    + GROUPS.format(t="5e-5"), """
SELECT t.query_id, t.chunk_id, t.rank::BIGINT AS left_rank, t.rank::BIGINT AS right_rank,
       round(t.score, 6) AS left_score, round(t.kept, 6) AS right_score,
       l.grp = r.grp AND abs(t.score - t.kept) <= 5e-5 AS equivalent
FROM top t JOIN walk l ON l.query_id = t.query_id || '/l' AND l.chunk_id = t.chunk_id
JOIN walk r ON r.query_id = t.query_id || '/r' AND r.chunk_id = t.chunk_id""", recursive=True)

# ---------------------------------------------------------------- sources, collections, files

ORACLE["eval_samples"] = _with(GOLD, """
SELECT query_id AS question_id, sha256(question) AS question_digest,
       array_to_string(gold_doc_ids, '|') AS gold_doc_ids, NULL::VARCHAR AS reference_answer
FROM gold WHERE len(gold_doc_ids) > 0""")

ORACLE["failure_cases"] = _with(GOLD, """
SELECT query_id AS case_id, array_to_string(gold_doc_ids, '|') AS gold_doc_ids,
       'no_failure' AS expected_label, 'bm25' AS baseline_retriever, 1::BIGINT AS baseline_top_k,
       'dense' AS intervention_retriever, 5::BIGINT AS intervention_top_k FROM gold""")

ORACLE["catalog_questions"] = """
SELECT CAST(item_id AS VARCHAR) AS question_id, text AS question, item_id < 8 AS featured
FROM benchmark"""

ORACLE["role_counts"] = """
SELECT role AS category, count(*)::BIGINT AS count FROM conversations GROUP BY role"""

ORACLE["point_payloads"] = _with(CHUNKS, """
SELECT chunk_id, doc_id, string_split(doc_id, '/')[-1] AS title, doc_id AS path,
       string_split(doc_id, '/')[1] AS source_group, 'fp' AS source_fingerprint FROM chunks""")

ORACLE["collection_check"] = _with(CHUNKS, """
SELECT count(*)::BIGINT AS points,
       (count(*) FILTER (string_split(doc_id, '/')[1] = 'src0'))::BIGINT AS mismatches,
       (count(*) FILTER (string_split(doc_id, '/')[1] = 'src0')) = 0 AS verified FROM chunks""")

ORACLE["file_status"] = """
WITH present AS (
  SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'x' ELSE '' END || d.doc_id AS path,
         quality = 1 AS same FROM documents d JOIN labels USING (doc_id))
SELECT coalesce(CAST(d.doc_id AS VARCHAR), p.path) AS path,
       CASE WHEN d.doc_id IS NULL THEN 'unexpected_files' WHEN p.path IS NULL THEN 'missing_files'
            WHEN NOT same THEN 'digest_mismatch' ELSE 'matches' END AS status
FROM documents d FULL OUTER JOIN present p ON p.path = CAST(d.doc_id AS VARCHAR)"""

ORACLE["retrieve_trace_lines"] = _with(BM25 + f""",
parts AS (
  SELECT query_id, list_concat(['Retrieve trace', repeat('─', 44),
         '  query     : ''' || question || '''', '  retriever : bm25', '  top_k     : 3',
         '  latency   : ', repeat('─', 44)], flatten(list([
           printf('Rank %d  score=%.4f  chunk_id=', rank, score) || chunk_id,
           '  doc_id  : ' || doc_id, '  title   : ' || title, '  path    : ' || path,
           '  preview : ' || {PREVIEW}, ''] ORDER BY rank))) AS lines
  FROM results JOIN asked USING (query_id) WHERE rank <= 3 GROUP BY query_id, question)""", """
SELECT query_id, (generate_subscripts(lines, 1) - 1)::BIGINT AS line_no, unnest(lines) AS line
FROM parts""")

# Bytes of a float32 from its value: sign, exponent and mantissa, low byte first.
ORACLE["collection_fingerprint"] = _with("""
parts AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
guess AS (SELECT vec_id, i, x, CASE WHEN x = 0 THEN 0 ELSE floor(log2(abs(x)))::BIGINT END AS g FROM parts),
expo AS (SELECT vec_id, i, x, CASE WHEN x = 0 THEN 0 WHEN abs(x) >= 2.0 ** (g + 1) THEN g + 1 WHEN abs(x) < 2.0 ** g THEN g - 1 ELSE g END AS e
         FROM guess),
bits AS (SELECT vec_id, i, CASE WHEN x = 0 THEN 0 ELSE (CASE WHEN x < 0 THEN 2147483648 ELSE 0 END) + (e + 127) * 8388608
                + (abs(x) * 2.0 ** (23 - e))::BIGINT - 8388608 END::BIGINT AS b FROM expo),
hexed AS (SELECT vec_id, string_agg(printf('%02x%02x%02x%02x', b & 255, (b >> 8) & 255, (b >> 16) & 255, (b >> 24) & 255), '' ORDER BY i) AS h
          FROM bits GROUP BY vec_id),
keyed AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS no,
                 sha256(length(CAST(vec_id AS VARCHAR)) || ':' || vec_id || ':' || coalesce(h, CASE WHEN embedding IS NULL THEN '-' ELSE '' END)) AS digest
          FROM embeddings LEFT JOIN hexed USING (vec_id)),
tree AS (
  SELECT no, digest, count(*) OVER () AS n FROM keyed
  UNION ALL SELECT no // 1024, sha256(string_agg(digest, '' ORDER BY no)), (n + 1023) // 1024 FROM tree WHERE n > 1 GROUP BY no // 1024, n)
""", """
SELECT (SELECT count(*) FROM embeddings)::BIGINT AS vectors,
       sha256('cosine:' || (SELECT count(*) FROM embeddings) || ':' || (SELECT coalesce(max(len(embedding)), 0) FROM embeddings) || ':'
              || coalesce((SELECT digest FROM tree WHERE n = 1), '')) AS fingerprint""", recursive=True)

ORACLE["bundle_violations"] = """
WITH asked AS (
  SELECT CAST(doc_id - CASE WHEN doc_id % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS id, 'q' || quality || 't' || toxic AS category,
         doc_id % 13 = 0 AS empty, doc_id FROM labels),
gold AS (
  SELECT CAST(doc_id AS VARCHAR) AS d FROM asked UNION ALL
  SELECT 'absent-' || (doc_id % 17) FROM asked WHERE doc_id % 5 = 0),
wanted(category, n) AS (VALUES ('q0t0', 4), ('q0t1', 4), ('q1t0', 4), ('q2t0', 4)),
counts AS (SELECT category, count(*) AS n FROM asked GROUP BY ALL)
SELECT 'question_id' AS kind, id AS key, CAST(count(*) AS VARCHAR) AS found, '1' AS expected
FROM asked GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'incomplete', id, CAST(count(*) AS VARCHAR), '0' FROM asked WHERE empty GROUP BY id
UNION ALL SELECT 'gold_doc_ids', d, CAST(count(*) AS VARCHAR), '0' FROM gold
  WHERE d NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) GROUP BY d
UNION ALL SELECT 'category', category, CAST(coalesce(c.n, 0) AS VARCHAR), CAST(coalesce(w.n, 0) AS VARCHAR)
  FROM counts c FULL JOIN wanted w USING (category) WHERE coalesce(c.n, 0) <> coalesce(w.n, 0)
UNION ALL SELECT 'question_count', 'all', CAST(count(*) AS VARCHAR), '16' FROM asked HAVING count(*) <> 16
UNION ALL SELECT 'identity', 'question_count', CAST(count(*) AS VARCHAR), CAST(count(*) + 1 AS VARCHAR) FROM asked
UNION ALL SELECT 'identity', 'distance_metric', 'cosine', 'dot'"""

ORACLE["catalog_lookup"] = """
SELECT CAST(doc_id AS VARCHAR) AS question_id, sha256(text) AS digest, source FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)"""
