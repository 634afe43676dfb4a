"""DuckDB counterparts of the registered queries that SQL can express.

Not here: secret scan (model scores), token files, language ID, SentencePiece and the pipeline; tests
hold those against brute force.
"""

from __future__ import annotations

from gleaner.llm.licenses import RULES, SENTENCES
from gleaner.llm.urls import DOMAIN_RULES, PATTERN_RULES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NOT_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_NOT_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_NOT_ALNUM}') AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS gram
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN sizes ON len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM pos JOIN win USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
         WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(v, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT v, b FROM reach JOIN link ON r = a),
grouped AS (SELECT v, min(r) AS c FROM reach GROUP BY v),
counted AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v AS vec_id, coalesce(n, 0) AS n_links, c AS component_id, v = c AS kept
FROM grouped LEFT JOIN counted ON a = v
"""

MINHASH = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
         WHERE 100 * common.n >= 85 * (x.n + y.n - common.n)),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT v, b FROM reach JOIN link ON r = a),
grouped AS (SELECT v, min(r) AS c FROM reach GROUP BY v)
SELECT v AS doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, v = c AS kept
FROM grouped LEFT JOIN size ON doc_id = v
"""


def _licenses() -> str:
    normal = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    known = ", ".join(f"({_quoted(k)}, {normal.format(_quoted(v))})" for k, v in SENTENCES.items())
    steps, last, names = [], "ids", []
    for k, (name, run) in enumerate(sorted(RULES, key=lambda r: (-len(r[1]), r[0]))):
        wanted = _quoted("," + ",,".join(run) + ",")
        before = ", ".join(["doc_id", "sentence_ids", *names])
        names.append(f"hit{k}")
        steps.append(f"step{k} AS (SELECT {before}, CASE WHEN contains(rest, {wanted}) THEN {_quoted(name)} END AS hit{k}, "
                     f"replace(rest, {wanted}, ',#,') AS rest FROM {last})")
        last = f"step{k}"
    return rf"""
WITH known(id, sentence) AS (SELECT * FROM (VALUES {known})),
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS no, unnest(l) AS line FROM (
    SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \t\n\x0B\f\r]+', '\1' || chr(10), 'g'), chr(10)) AS l
    FROM documents)),
seq AS (SELECT doc_id, string_agg(id, ',' ORDER BY no) AS sentence_ids, string_agg(',' || id || ',', '' ORDER BY no) AS rest
        FROM lines JOIN known ON {normal.format("line")} = sentence GROUP BY doc_id),
ids AS (SELECT doc_id, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rest, '') AS rest
        FROM documents LEFT JOIN seq USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, sentence_ids, array_to_string(list_sort(list_distinct(
    list_filter([{", ".join(names)}], lambda x: x IS NOT NULL))), ',') AS licenses
FROM {last}
"""


LINES = r"""
WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS no, unnest(s) AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, no, line, list_filter(string_split_regex(line, '[ \t\r\f\x0B]+'), lambda x: x <> '') AS toks FROM l),
m AS (SELECT doc_id, no, line, toks, list_transform(toks, lambda x:
          CASE WHEN regexp_matches(x, '[0-9]|@|://|^[A-Za-z0-9+/_=-]{24,}$') THEN '<*>' ELSE x END) AS mask FROM t),
w AS (SELECT *, array_to_string(mask, ' ') AS tpl, len(list_filter(mask, lambda x: regexp_matches(x, '\p{L}'))) AS words FROM m),
k AS (SELECT *, CASE WHEN len(toks) < 6 THEN 'short'
          WHEN NOT contains(tpl, '<*>') OR (words >= 3 AND 3 * words > length(tpl) - length(replace(tpl, '<*>', ''))) THEN 'masked'
          ELSE 'plain' END AS kind FROM w),
held AS (SELECT DISTINCT tpl, mask, len(mask) - 1 AS r, unnest([0, 1, 2]) AS seg FROM k WHERE kind = 'masked'),
leaf AS (SELECT tpl, mask, (r, mask[1], seg, mask[2 + r * seg // 3:1 + r * (seg + 1) // 3]) AS leaf FROM held),
full_leaf AS (SELECT *, count(*) OVER (PARTITION BY leaf) AS variants FROM leaf QUALIFY variants >= 3),
place AS (SELECT leaf, generate_subscripts(mask, 1) AS p, unnest(mask) AS token FROM full_leaf),
counted AS (SELECT leaf, p, token, count(*) AS c FROM place GROUP BY ALL),
slot AS (SELECT leaf, p, CASE WHEN 2 * max(c) >= sum(c) THEN max((c, token))[2] ELSE '<*>' END AS token FROM counted GROUP BY leaf, p),
made AS (SELECT leaf, list(token ORDER BY p) AS slots FROM slot GROUP BY leaf),
sound AS (SELECT leaf, slots, array_to_string(slots, ' ') AS wide, len(list_filter(slots, lambda x: x <> '<*>')) AS literals,
                 len(list_filter(slots, lambda x: regexp_matches(x, '\p{L}'))) AS words FROM made),
fits AS (SELECT leaf, tpl, literals, wide, count(*) OVER (PARTITION BY leaf) AS variants FROM full_leaf JOIN sound USING (leaf)
         WHERE 100 * literals >= 60 * len(slots) AND words >= 3 AND 3 * words > length(wide) - length(replace(wide, '<*>', ''))
           AND len(list_filter(list_zip(mask, slots), lambda x: x[2] <> '<*>' AND x[1] <> x[2])) = 0 QUALIFY variants >= 3),
chosen AS (SELECT tpl, min((literals, wide))[2] AS wide FROM fits GROUP BY tpl),
spread AS (SELECT wide FROM k JOIN chosen USING (tpl) WHERE kind = 'masked' GROUP BY wide HAVING count(DISTINCT doc_id) >= 3),
wider AS (SELECT tpl, wide FROM chosen SEMI JOIN spread USING (wide)),
g AS (SELECT doc_id, no, line, kind, CASE WHEN kind = 'masked' THEN coalesce(wide, k.tpl) ELSE array_to_string(toks, ' ') END AS name
      FROM k LEFT JOIN wider ON kind = 'masked' AND wider.tpl = k.tpl),
often AS (SELECT kind, name, min((doc_id, no)) AS home FROM g WHERE kind <> 'short' OR regexp_matches(name, '\p{L}')
          GROUP BY kind, name HAVING count(DISTINCT doc_id) >= CASE WHEN kind = 'short' THEN 1000 ELSE 2 END),
judged AS (SELECT g.*, home IS NOT NULL AND (doc_id, no) <> home AS gone FROM g LEFT JOIN often USING (kind, name)),
kept AS (SELECT doc_id, count(*) AS n, count_if(gone) AS n_dropped,
                coalesce(string_agg(CASE WHEN NOT coalesce(gone, false) THEN line END, chr(10) ORDER BY no), '') AS kept_text
         FROM judged GROUP BY doc_id)
SELECT doc_id, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE n END AS BIGINT) AS n_lines,
       CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(kept_text) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""


def _urls() -> str:
    rules = ", ".join(f"({_quoted(h + p)}, {_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in DOMAIN_RULES)
    method = " OR ".join(f"regexp_matches(host || path, {_quoted(p)})" for _, p, _ in PATTERN_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH u AS (SELECT page_id, {lower.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
rules(rule, verdict, h, p) AS (SELECT * FROM (VALUES {rules})),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
         FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN {method} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::UBIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(a, b) >> 1, 3988292384::UBIGINT * (xor(a, b) & 1))"
    return f"xor(list_reduce({steps}, lambda a, b: {step}, 4294967295::UBIGINT), 4294967295::UBIGINT)"


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || {f}, '-')" for f in fields) + ")"


MANIFEST = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, source, {_leaf("text")} AS leaf, {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS bad,
           {_leaf("replace(text, chr(10), '')")} AS changed FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  count(*) OVER (PARTITION BY source) AS n FROM leaves),
tree AS (
    SELECT 0 AS k, source, i, n, leaf AS h FROM ranked
    UNION ALL SELECT k + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY k, source, i // 3, n),
tops AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
crown AS (
    SELECT 0 AS k, i, n, subroot AS h FROM tops
    UNION ALL SELECT k + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY k, i // 3, n),
below AS (
    SELECT a.k, a.source, a.i, string_agg(CASE WHEN b.i < a.i THEN b.h END, '' ORDER BY b.i) AS l,
           string_agg(CASE WHEN b.i > a.i THEN b.h END, '' ORDER BY b.i) AS r
    FROM tree a JOIN tree b ON a.k = b.k AND a.source IS NOT DISTINCT FROM b.source AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
above AS (
    SELECT a.k, a.i, string_agg(CASE WHEN b.i < a.i THEN b.h END, '' ORDER BY b.i) AS l,
           string_agg(CASE WHEN b.i > a.i THEN b.h END, '' ORDER BY b.i) AS r
    FROM crown a JOIN crown b ON a.k = b.k AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY ALL),
height AS (SELECT source, max(k) AS k FROM tree GROUP BY source),
steps AS (
    SELECT r.source, r.i, b.k, coalesce(l, '') AS l, coalesce(b.r, '') AS r
    FROM ranked r JOIN below b ON r.source IS NOT DISTINCT FROM b.source AND b.i = r.i // CAST(3 ** b.k AS BIGINT)
    UNION ALL
    SELECT r.source, r.i, height.k + a.k, coalesce(a.l, ''), coalesce(a.r, '')
    FROM ranked r JOIN tops ON r.source IS NOT DISTINCT FROM tops.source JOIN height ON r.source IS NOT DISTINCT FROM height.source
    JOIN above a ON a.i = tops.i // CAST(3 ** a.k AS BIGINT)),
proofs AS (SELECT source, i, string_agg(l || r, '' ORDER BY k) AS proof FROM steps GROUP BY source, i),
fold AS (
    SELECT source, i, 0 AS k, CASE WHEN bad THEN changed ELSE leaf END AS h FROM ranked
    UNION ALL SELECT f.source, f.i, f.k + 1, sha256(s.l || f.h || s.r)
    FROM fold f JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.i = s.i AND f.k = s.k),
folded AS (SELECT source, i, arg_max(h, k) AS h FROM fold GROUP BY source, i),
root AS (SELECT h AS root FROM crown WHERE n = 1)
SELECT r.doc_id, r.leaf, tops.subroot, root.root, sha256(coalesce(proof, '')) AS proof_sha256, folded.h AS folded_root, folded.h = root.root AS verified
FROM ranked r JOIN tops ON r.source IS NOT DISTINCT FROM tops.source CROSS JOIN root
JOIN folded ON r.source IS NOT DISTINCT FROM folded.source AND r.i = folded.i
LEFT JOIN proofs ON r.source IS NOT DISTINCT FROM proofs.source AND r.i = proofs.i
"""

CONVERSATIONS = f"""
WITH turns AS (
    SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'d': digest, 'n': chars}} ORDER BY turn NULLS FIRST, digest) AS t FROM turns GROUP BY conv_id),
h AS (SELECT *, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS BIGINT) AS h FROM own),
seq AS (SELECT c.conv_id, list_concat(coalesce(b.t[1:c.h], []), c.t[c.h + 1:]) AS t FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
pre AS (SELECT conv_id, d, len(t) = d AS ends, t[d].n AS chars, array_to_string(list_transform(t[1:d], lambda x: x.d), '') AS k
        FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM seq)),
node AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(coalesce(chars, 0)) AS chars,
                coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends FROM pre GROUP BY d, k),
kids AS (SELECT d - 1 AS d, k[:32 * (d - 1)] AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (d, k)),
total AS (SELECT a.d, a.k, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
          FROM full_node a JOIN full_node b ON b.d >= a.d AND starts_with(b.k, a.k) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN total USING (d, k) LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.k[:32 * (f.d - 1)]
"""


ORACLE = {
    "op1_decontamination": DECONTAMINATION,
    "op3_embedding_near_dedup": EMBEDDINGS,
    "op4_minhash_near_dedup": MINHASH,
    "op6_license_scan": _licenses(),
    "op8_line_dedup": LINES,
    "op9_url_filter": _urls(),
    "op12_merkle_manifest": MANIFEST,
    "op13_conversation_trie": CONVERSATIONS,
}
