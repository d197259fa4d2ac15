"""The operators' queries in plain SQL, written independently of them."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = f"regexp_extract_all({LOWER}, " + r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
WORDS = f"regexp_extract_all({LOWER}, " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
PIECES = f"regexp_extract_all({LOWER}, " + r"'[^\x20\x09-\x0D]+')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {PIECES} AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {WORDS} AS w FROM benchmark) WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM items),
doc_windows AS (
    SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs JOIN sizes ON len(w) >= n)),
found AS (SELECT doc_id, item_id, n, i FROM doc_windows JOIN item_windows USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

EMBEDDING_DUPLICATES = """
WITH RECURSIVE good AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
lowest AS (SELECT a AS vec_id, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN counted USING (vec_id) LEFT JOIN lowest USING (vec_id)
"""

# Windows of 1,024 tokens, 256 of them history; a token for four characters begun, and four for the marks of a turn.
CHAT_WINDOWS = r"""
WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, (length(text) + 3) // 4 + 4 AS tokens FROM said),
placed AS (
    SELECT *, row_number() OVER o - 1 AS pos, coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        first_value(role) OVER o = 'system' AS opened, first_value(tokens) OVER o AS opening
    FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
laid AS (
    SELECT *, pos = 0 AND opened AS is_system, greatest(1024 - 256 - CASE WHEN opened THEN opening ELSE 0 END, 256) AS room,
        before - CASE WHEN opened AND pos > 0 THEN opening ELSE 0 END AS first_token FROM placed),
binned AS (SELECT *, first_token // room AS bin FROM laid),
windowed AS (SELECT *, CASE WHEN is_system THEN -1 ELSE 2 * bin + CASE WHEN (first_token + tokens - 1) // room <> bin THEN 1 ELSE 0 END END AS win FROM binned),
openings AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY win < 0, win) = 1 AS opens
    FROM (SELECT conv_id, win, bin, min(first_token) AS opens_at FROM windowed GROUP BY ALL)),
shown AS (
    SELECT conv_id, role, text FROM windowed WHERE NOT is_system
    UNION ALL SELECT w.conv_id, w.role, w.text FROM windowed w JOIN openings o ON o.conv_id = w.conv_id WHERE w.is_system AND (o.win >= 0 OR o.opens)
    UNION ALL SELECT w.conv_id, w.role, w.text FROM windowed w JOIN openings o ON o.conv_id = w.conv_id AND o.win >= 0 AND (o.bin = w.bin OR o.bin = w.bin + 1)
        AND w.first_token < o.opens_at AND o.opens_at - w.first_token <= 256 WHERE NOT w.is_system),
written AS (
    SELECT conv_id, sum(length('<turn new >') + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
        + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + length('</turn>') + 1)::BIGINT AS formatted_chars FROM shown GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM placed JOIN written USING (conv_id) GROUP BY conv_id
"""

# The articles of the given pages hold headings and paragraphs alone, so their tags tell the blocks.
HTML_TEXT = r"""
WITH inside AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)(?:\s[^>]*)?>') AS pieces FROM pages),
cut AS (SELECT page_id, url, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS place FROM inside),
plain AS (SELECT *, regexp_replace(regexp_replace(piece, '<br[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM cut),
marks AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(t, '&#x27;', ''''), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g') AS m FROM plain),
decoded AS (SELECT *, trim(regexp_replace(regexp_replace(m, '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS d FROM marks),
joined AS (SELECT page_id, url, coalesce(string_agg(d, chr(10) ORDER BY place) FILTER (d <> ''), '') AS text FROM decoded GROUP BY page_id, url)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""

LEXICAL_SEARCH = f"""
WITH docs AS (SELECT doc_id, {TERMS} AS terms FROM documents),
sized AS (SELECT doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark)),
counted AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term, n_docs),
impacts AS (
    SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))) AS impact
    FROM counted JOIN weighed USING (term), totals),
scored AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL HAVING sum(impact) > 0),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

HARD_NEGATIVES = """
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
near AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM near JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

SQL = {
    "op2_near_duplicates": NEAR_DUPLICATES,
    "op4_decontamination": DECONTAMINATION,
    "op7_embedding_duplicates": EMBEDDING_DUPLICATES,
    "op9_chat_windows": CHAT_WINDOWS,
    "op11_html_text": HTML_TEXT,
    "op12_lexical_search": LEXICAL_SEARCH,
    "op13_hard_negatives": HARD_NEGATIVES,
}
