"""The registered queries in plain SQL, written independently of the operators."""

from __future__ import annotations


SEED = 7
VOCAB = 1000

WORDS = r"regexp_extract_all({0}, '\S+')"
SYSTEM = "'<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10)"
ANSWER = "'<|im_start|>assistant' || chr(10)"
END = "'<|im_end|>' || chr(10)"


def words(column: str) -> str:
    return WORDS.format(column)


def number(key: str, digits: int = 8) -> str:
    return f"('0x' || substr({key}, 1, {digits}))::bigint"


def key(*columns: str, seed: int = SEED) -> str:
    return "md5('" + str(seed) + "' || " + " || ".join(f"':' || {c}" for c in columns) + ")"


def ids(column: str, size: int = VOCAB, first: int = 2) -> str:
    return f"list_transform({words(column)}, lambda w: {number('md5(w)')} % {size} + {first})"


def digest(array: str) -> str:
    return f"md5(coalesce(array_to_string({array}, ','), ''))"


def fill(value: int, n: str) -> str:
    return f"list_transform(range({n}), lambda z: {value}::bigint)"


def said(role: str, content: str) -> str:
    return f"'<|im_start|>' || {role} || chr(10) || {content} || {END}"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::double[], {b}::double[])"


CAPTIONS = f"""
captions AS (
  SELECT doc_id, list_append({ids('text')}, 1::bigint) AS ids
  FROM documents WHERE text IS NOT NULL AND text <> '' AND len({words('text')}) + 1 > 1 AND len({words('text')}) + 1 < 128),
placed AS (
  SELECT doc_id, ids, (row_number() OVER (ORDER BY {key('doc_id')}) - 1) AS place FROM captions),
batched AS (
  SELECT doc_id, ids, place // 32 AS batch_id, place % 32 AS pos,
         max(len(ids)) OVER (PARTITION BY place // 32) AS batch_len FROM placed)"""

IMAGE_PROMPTS = ("What does this picture show?", "Say in one sentence what can be seen here.", "Name the main things in the image.")
PROMPT_LIST = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in IMAGE_PROMPTS) + "]"
CAPTION_SAMPLES = f"""
asked AS (
  SELECT doc_id, text, {PROMPT_LIST}[{number(key('doc_id'))} % {len(IMAGE_PROMPTS)} + 1] AS prompt
  FROM documents WHERE text <> '' AND len({words('text')}) > 1 AND len({words('text')}) < 128),
rendered AS (
  SELECT doc_id, text, prompt, {SYSTEM} || {said("'user'", 'prompt')} || {ANSWER} AS prompt_text,
         {SYSTEM} || {said("'user'", 'prompt')} || {said("'assistant'", 'text')} AS full_text FROM asked)"""

TURNS = """
turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place
  FROM conversations WHERE role <> 'system')"""

FIRST = f"""{TURNS},
checked AS (
  SELECT conv_id, count(*) AS n,
         bool_and(role = CASE WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END AND length(text) > 0) AS ok,
         string_agg({said('role', 'text')}, '' ORDER BY place) AS body,
         min(CASE WHEN place = 0 THEN text END) AS question
  FROM turns WHERE place < 6 GROUP BY conv_id),
valid AS (
  SELECT conv_id, n // 2 AS n_pairs, {SYSTEM} || body AS full_text,
         {SYSTEM} || {said("'user'", 'question')} || {ANSWER} AS prompt_text
  FROM checked WHERE ok AND n % 2 = 0)"""

DIALOGUES = f"""{FIRST},
numbered AS (
  SELECT conv_id, {ids('full_text')} AS ids, len({words('prompt_text')}) AS prompt_len,
         row_number() OVER (ORDER BY conv_id) - 1 AS place FROM valid),
batched AS (
  SELECT conv_id, ids, prompt_len, place // 16 AS batch_id, place % 16 AS pos,
         max(len(ids)) OVER (PARTITION BY place // 16) AS batch_len FROM numbered)"""

PADDED = f"list_concat(ids, {fill(0, 'batch_len - len(ids)')})"
MASK = f"list_concat({fill(1, 'len(ids)')}, {fill(0, 'batch_len - len(ids)')})"
STRICT_LABELS = f"list_concat({fill(-100, 'prompt_len')}, ids[prompt_len + 1:], {fill(-100, 'batch_len - len(ids)')})"


def labels(labels_expr: str) -> str:
    return f"""WITH {DIALOGUES}
SELECT conv_id, batch_id, pos, prompt_len, {digest(PADDED)} AS input_ids, {digest(MASK)} AS attention_mask,
       {digest(labels_expr)} AS labels FROM batched"""


def extended(front_ids: str, n: int) -> str:
    return f"""WITH {DIALOGUES}
SELECT conv_id, batch_len + {n} AS n_positions, {digest(f'list_concat({front_ids}, {PADDED})')} AS input_ids,
       {digest(f"list_concat({fill(1, str(n))}, {MASK})")} AS attention_mask,
       {digest(f"list_concat({fill(-100, str(n))}, {STRICT_LABELS})")} AS labels FROM batched"""


def samples(where: str, on_dangling: str) -> str:
    if on_dangling == "skip":
        return f"""WITH {FIRST}
SELECT conv_id, n_pairs, md5(full_text) AS text_md5 FROM valid {where}"""
    # a last message without answer is left out
    return f"""WITH {TURNS},
few AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM turns WHERE place < 6),
kept AS (
  SELECT conv_id, min(n) // 2 AS n_pairs,
         coalesce(bool_and(role = CASE WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END AND length(text) > 0)
                  FILTER (place < n - n % 2), true) AS ok,
         coalesce(string_agg({said('role', 'text')}, '' ORDER BY place) FILTER (place < n - n % 2), '') AS body
  FROM few GROUP BY conv_id)
SELECT conv_id, n_pairs, md5({SYSTEM} || body) AS text_md5 FROM kept WHERE ok"""


RANKED_DOCS = "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents"

CLASSES = """
each AS (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
mean AS (SELECT label, i, avg(x) AS m FROM each GROUP BY label, i),
classes AS (SELECT label, list(m ORDER BY i) AS c FROM mean GROUP BY label),
units AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM classes),
scored AS (
  SELECT e.vec_id, e.label, u.label AS class, list_dot_product(e.embedding::double[], u.c) AS z
  FROM embeddings e, units u),
best AS (
  SELECT vec_id, label::bigint AS label, class::bigint AS predicted, z FROM scored
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, class) = 1)"""


def towers(size: int, scale: str) -> str:
    return f"""
img AS (SELECT vec_id // 2 AS k, embedding::double[] AS v FROM embeddings WHERE vec_id % 2 = 0),
txt AS (SELECT vec_id // 2 AS k, embedding::double[] AS v FROM embeddings WHERE vec_id % 2 = 1),
both_sides AS (SELECT img.k, img.v AS iv, txt.v AS tv FROM img JOIN txt ON img.k = txt.k),
z AS (SELECT a.k // {size} AS b, a.k AS i, c.k AS j, list_dot_product(a.iv, c.tv) * {scale} AS z
      FROM both_sides a JOIN both_sides c ON a.k // {size} = c.k // {size}),
rws AS (SELECT b, i, ln(sum(exp(z))) AS lse, max(CASE WHEN i = j THEN z END) AS own,
        arg_max(j, (z, -j)) AS best FROM z GROUP BY b, i),
cls AS (SELECT b, j, ln(sum(exp(z))) AS lse FROM z GROUP BY b, j)"""


def contrastive(size: int) -> str:
    return f"""WITH {towers(size, 'least(exp(0.07), 100)')}
SELECT r.b AS batch_id, count(*) AS n_pairs, round(avg(r.lse - own), 6) AS image_loss, round(avg(c.lse - own), 6) AS text_loss,
       round((avg(r.lse - own) + avg(c.lse - own)) / 2, 6) AS loss
FROM rws r JOIN cls c ON r.b = c.b AND r.i = c.j GROUP BY r.b"""


LEVELS = "list_transform(embedding, lambda x: greatest(0, least(255, floor((x::double + 0.5) * 255)))::bigint)"


def hexes(array: str) -> str:
    return f"array_to_string(list_transform({array}, lambda p: lower(printf('%02x', p))), '')"


def run_log(bucket: int) -> str:
    return f"""WITH lines AS (
  SELECT event_id AS step, CASE WHEN event_type = 'view' THEN 'val' ELSE 'train' END AS split, round(value, 6) AS loss FROM events)
SELECT split, step // {bucket} AS bucket, count(*) AS n_lines, round(avg(loss), 6) AS mean_loss, max(step) AS last_step,
       arg_max(loss, step) AS last_loss FROM lines GROUP BY split, step // {bucket}"""


USED = "(SELECT md5(lower(trim(d.text))) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
ENCODED = f"""WITH tokens AS (SELECT doc_id, unnest({words('text')}) AS word, generate_subscripts({words('text')}, 1) AS place FROM documents),
counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
vocab AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS token_id FROM counts ORDER BY n DESC, word LIMIT {VOCAB}),
found AS (SELECT doc_id, place, coalesce(token_id, {VOCAB}) AS id FROM tokens LEFT JOIN vocab USING (word))
SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (id = {VOCAB}) AS n_unknown, md5(string_agg(id::varchar, ',' ORDER BY place)) AS ids
FROM found GROUP BY doc_id"""
RESAMPLE_DRAWS = 12
HISTORY = f"""WITH {TURNS},
said AS (SELECT conv_id, turn, role, place, place // 4 AS chunk, {said('role', 'text')} AS piece FROM turns)"""

SQL: dict[str, str] = {
    "metadata_scan": "SELECT page_id, url AS image_url, coalesce(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '') AS caption FROM pages",
    "shard_listing": "SELECT source, row_number() OVER (ORDER BY source) - 1 AS shard_idx FROM (SELECT DISTINCT source FROM documents)",
    "labelled_scan": "SELECT vec_id, label::bigint AS label, n_name AS class_name FROM embeddings LEFT JOIN nation ON label = n_nationkey",
    "run_log_scan": """SELECT event_id AS step, CASE WHEN event_type = 'view' THEN 'val' ELSE 'train' END AS split, round(value, 6) AS loss
FROM events WHERE event_type <> 'error'""",
    "run_log_roundtrip": "SELECT event_id AS step, 'train' AS split, round(value, 6) AS loss FROM events",
    "json_member": "SELECT event_id, (props ->> 'k')::bigint AS k FROM events",
    "tar_roundtrip": f"""SELECT doc_id, place // 300 AS shard_idx, md5(text) AS jpg_md5, md5(text) AS caption_md5
FROM documents JOIN ({RANKED_DOCS}) USING (doc_id)""",
    "dialogue_json_scan": f"""WITH {TURNS}
SELECT conv_id AS image_id, count(*) AS n_messages, md5(string_agg(text, '|' ORDER BY place)) AS values_md5 FROM turns GROUP BY conv_id""",
    "dialogue_array_scan": f"""WITH {TURNS}
SELECT conv_id AS image_id, count(*) AS n_messages, md5(string_agg(text, '|' ORDER BY place)) AS values_md5 FROM turns GROUP BY conv_id""",
    "tar_listing": f"""SELECT place // 300 AS shard_idx, place // 300 AS number, (1024 + sum(512 + (strlen(text) + 511) // 512 * 512))::bigint AS bytes
FROM documents JOIN ({RANKED_DOCS}) USING (doc_id) GROUP BY place // 300""",
    "split_sources": f"SELECT doc_id, CASE WHEN {number(key('source'))} % 1000000 < 200000 THEN 'val' ELSE 'train' END AS split FROM documents",
    "tar_stream": f"""SELECT doc_id, {digest(words('text'))} AS tokens FROM documents
WHERE len({words('text')}) + 1 > 1 AND len({words('text')}) + 1 < 128""",
    "batch_sink": f"""SELECT doc_id, CASE WHEN {number(key('source'))} % 1000000 < 200000 THEN 'val' ELSE 'train' END AS split,
       (place // 16) % 4 AS rank, place // 16 AS batch_id, place % 16 AS pos FROM documents JOIN ({RANKED_DOCS}) USING (doc_id)""",
    "caption_filter": f"WITH {CAPTIONS} SELECT doc_id, len(ids) AS n_tokens, {digest('ids')} AS ids FROM captions",
    "vocab_topk": f"""SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS token_id FROM
(SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT {VOCAB}""",
    "encode_tokens": ENCODED,
    "encode_tokens_join": ENCODED,
    "encode_with_tokeniser": f"""SELECT doc_id, len(string_split(text, ' ')) AS n_tokens,
       {digest("list_transform(string_split(text, ' '), lambda w: length(w))")} AS ids FROM documents""",
    "prompt_pick": f"SELECT doc_id, {PROMPT_LIST}[{number(key('doc_id'))} % {len(IMAGE_PROMPTS)} + 1] AS prompt FROM documents",
    "caption_samples": f"""WITH {CAPTION_SAMPLES}
SELECT doc_id, prompt, len({words('prompt_text')}) AS n_prompt, len({words('full_text')}) AS n_full, len({words('text')}) AS n_caption,
       {digest(words('full_text'))} AS full_digest FROM rendered""",
    "quality_filter": """SELECT doc_id, source, n_chars, quality::bigint AS quality FROM documents JOIN labels USING (doc_id)
WHERE quality = 1 AND toxic = 0""",
    "required_members": "SELECT doc_id, lang, quality::bigint AS quality FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND quality IS NOT NULL",
    "pair_by_key": "SELECT doc_id, lang, toxic::bigint AS toxic FROM documents JOIN labels USING (doc_id)",
    "disjoint_corpus": f"SELECT doc_id FROM documents WHERE md5(lower(trim(text))) NOT IN {USED}",
    "map_columns": "SELECT doc_id, upper(lang) AS lang, n_chars * 2 AS n_chars FROM documents",
    "where_fn": "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars > 500 AND lang = 'en'",
    "where_unaccented": "SELECT doc_id, lang FROM documents WHERE strip_accents(text) = text",
    "chained": f"""WITH {CAPTIONS}, c AS (
  SELECT doc_id, upper(source) AS source, row_number() OVER (ORDER BY doc_id) - 1 AS place
  FROM captions JOIN documents USING (doc_id) WHERE lang = 'en')
SELECT doc_id, source, CASE WHEN {number(key('source'))} % 1000000 < 200000 THEN 'val' ELSE 'train' END AS split,
       place // 16 AS batch_id, place % 16 AS pos FROM c""",
    "embed_table": "SELECT doc_id, length(text)::double AS n_chars, (length(text) - length(replace(text, 'e', '')))::double AS n_e FROM documents",
    "exact_rank": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents",
    "seeded_shuffle": f"SELECT doc_id, row_number() OVER (ORDER BY {key('doc_id')}) - 1 AS pos FROM documents",
    "shuffled_rows": "SELECT doc_id, lang FROM documents",
    "buffer_shuffle": f"""SELECT doc_id, place, row_number() OVER (ORDER BY place // 100, {key('doc_id')}) - 1 AS pos FROM ({RANKED_DOCS})""",
    "shard_shuffle": f"SELECT doc_id, source, row_number() OVER (ORDER BY {key('source')}, doc_id) - 1 AS pos FROM documents",
    "batches": f"SELECT doc_id, place // 48 AS batch_id, place % 48 AS pos FROM ({RANKED_DOCS})",
    "batches_drop_last": f"""SELECT doc_id, place // 48 AS batch_id, place % 48 AS pos FROM ({RANKED_DOCS})
WHERE place // 48 < (SELECT count(*) // 48 FROM documents)""",
    "batch_order": f"""WITH b AS (SELECT doc_id, place // 32 AS batch_id, place % 32 AS pos FROM ({RANKED_DOCS})),
o AS (SELECT batch_id, row_number() OVER (ORDER BY {key("'1'", 'batch_id')}) - 1 AS batch_pos FROM (SELECT DISTINCT batch_id FROM b))
SELECT doc_id, batch_id, pos, batch_pos FROM b JOIN o USING (batch_id)""",
    "epochs": f"SELECT doc_id, epoch, {key('epoch', 'doc_id')} AS epoch_key FROM documents, range(2) r(epoch)",
    "positional_split": f"""WITH r AS ({RANKED_DOCS}),
s AS (SELECT doc_id, row_number() OVER (ORDER BY {key('doc_id')}) - 1 AS o FROM r WHERE place >= 100)
SELECT doc_id, CASE WHEN place < 100 THEN 'val' WHEN o < ((SELECT count(*) FROM documents) - 100) // 10 THEN 'test' ELSE 'train' END AS split
FROM r LEFT JOIN s USING (doc_id)""",
    "head_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 64",
    "tail_rows": "SELECT doc_id, lang FROM documents ORDER BY doc_id OFFSET 64",
    "shard_split": f"SELECT doc_id, source, CASE WHEN {number(key('source'))} % 1000000 < 200000 THEN 'val' ELSE 'train' END AS split FROM documents",
    "rank_assign": """WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS shard_idx FROM (SELECT DISTINCT source FROM documents))
SELECT doc_id, source, shard_idx, shard_idx % 8 AS rank, (shard_idx // 8) % 4 AS worker FROM documents JOIN s USING (source)""",
    "resample": f"""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS shard_idx FROM (SELECT DISTINCT source FROM documents)),
d AS (SELECT draw, {number(key('draw'))} % (SELECT count(*) FROM s) AS shard_idx FROM range({RESAMPLE_DRAWS}) r(draw))
SELECT doc_id, source, draw FROM documents JOIN s USING (source) JOIN d USING (shard_idx)""",
    "pad_and_mask": f"""WITH {CAPTIONS}
SELECT doc_id, batch_id, pos, batch_len, len(ids) AS seq_len, {digest(PADDED)} AS input_ids, {digest(MASK)} AS attention_mask FROM batched""",
    "batch_summary": f"""WITH {CAPTIONS}
SELECT batch_id, count(*) AS n_rows, max(len(ids)) AS max_len, sum(len(ids))::bigint AS real_tokens,
       sum(batch_len - len(ids))::bigint AS pad_tokens FROM batched GROUP BY batch_id""",
    "dataset_report": f"""SELECT source, count(*) AS n_samples, sum(n)::bigint AS total_len, min(n) AS min_len, max(n) AS max_len
FROM (SELECT source, len({words('text')}) AS n FROM documents) GROUP BY source""",
    "step_budget": "SELECT source, count(*) AS n_rows, count(*) // 8 AS n_batches, (count(*) // 16) * 2 AS n_steps FROM documents GROUP BY source",
    "require_images": "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels)",
    "chat_render": f"""
SELECT conv_id, md5(string_agg({said('role', 'text')}, '' ORDER BY turn) || {ANSWER}) AS chat_md5 FROM conversations GROUP BY conv_id""",
    "turn_pairs": f"""WITH {TURNS}
SELECT q.conv_id, q.place // 2 AS pair, q.role AS question_role, a.role AS answer_role, md5(q.text) AS question, md5(a.text) AS answer
FROM turns q LEFT JOIN turns a ON a.conv_id = q.conv_id AND a.place = q.place + 1 WHERE q.place % 2 = 0""",
    "dialogue_samples": samples("WHERE conv_id IN (SELECT doc_id FROM labels)", "skip"),
    "dialogue_samples_truncated": samples("", "truncate"),
    "nested_samples": f"""WITH {FIRST}
SELECT conv_id AS image_id, 0::bigint AS conv_no, n_pairs, md5(full_text) AS text_md5 FROM valid WHERE conv_id IN (SELECT doc_id FROM labels)""",
    "history_prompts": f"""{HISTORY}
SELECT a.conv_id, a.turn, a.chunk AS prior_chunks, a.place AS n_messages,
       md5(CASE WHEN a.chunk = 0 THEN {SYSTEM} ELSE '' END || coalesce(string_agg(b.piece, '' ORDER BY b.place), '') || {ANSWER}) AS prompt_tail
FROM said a LEFT JOIN said b ON a.conv_id = b.conv_id AND a.chunk = b.chunk AND b.place < a.place
WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn, a.chunk, a.place""",
    "whole_prompts": f"""{HISTORY},
lasts AS (SELECT conv_id, max(place) AS place FROM said WHERE role = 'assistant' GROUP BY conv_id)
SELECT a.conv_id, a.turn, a.place AS n_messages, md5({SYSTEM} || coalesce(string_agg(b.piece, '' ORDER BY b.place), '') || {ANSWER}) AS prompt
FROM said a JOIN lasts l ON a.conv_id = l.conv_id AND a.place = l.place LEFT JOIN said b ON a.conv_id = b.conv_id AND b.place < a.place
GROUP BY a.conv_id, a.turn, a.place""",
    "transcript_chunks": f"""{HISTORY}
SELECT conv_id, chunk, md5(CASE WHEN chunk = 0 THEN {SYSTEM} ELSE '' END || string_agg(piece, '' ORDER BY place)) AS text
FROM said GROUP BY conv_id, chunk""",
    "labels_pretrain": labels(f"list_concat({fill(-100, 'prompt_len')}, ids[prompt_len + 1:], {fill(0, 'batch_len - len(ids)')})"),
    "labels_finetune": labels(f"list_concat(ids, {fill(-100, 'batch_len - len(ids)')})"),
    "labels_strict": labels(STRICT_LABELS),
    "label_stats": f"""WITH {DIALOGUES}
SELECT batch_id, count(*) AS n_rows, sum(len(ids))::bigint AS real_tokens, sum(batch_len - len(ids))::bigint AS pad_tokens,
       sum(prompt_len)::bigint AS prompt_tokens, sum(len(ids) - prompt_len)::bigint AS supervised_tokens FROM batched GROUP BY batch_id""",
    "prefix_extend": extended(f"list_concat([{VOCAB + 3}::bigint], {fill(VOCAB + 2, '196')}, [{VOCAB + 4}::bigint])", 198),
    "prefix_extend_linear": extended(fill(VOCAB + 2, "196"), 196),
    "captioning_batches": f"""WITH {CAPTION_SAMPLES},
numbered AS (SELECT doc_id, {ids('full_text')} AS ids, len({words('prompt_text')}) AS prompt_len,
             row_number() OVER (ORDER BY {key('doc_id')}) - 1 AS place FROM rendered),
batched AS (SELECT *, place // 32 AS batch_id, place % 32 AS pos, max(len(ids)) OVER (PARTITION BY place // 32) AS batch_len FROM numbered)
SELECT doc_id, batch_id, pos, {digest(PADDED)} AS input_ids,
       {digest(f"list_concat({fill(-100, 'prompt_len')}, ids[prompt_len + 1:], {fill(0, 'batch_len - len(ids)')})")} AS labels FROM batched""",
    "finetune_split": f"""WITH {FIRST},
kept AS (SELECT conv_id, len({words('full_text')}) AS n_tokens, row_number() OVER (ORDER BY conv_id) - 1 AS place
         FROM valid WHERE conv_id IN (SELECT doc_id FROM labels)),
s AS (SELECT conv_id, row_number() OVER (ORDER BY {key('conv_id')}) - 1 AS o FROM kept WHERE place >= 10)
SELECT conv_id, CASE WHEN place < 10 THEN 'val' WHEN o < ((SELECT count(*) FROM kept) - 10) // 10 THEN 'test' ELSE 'train' END AS split,
       n_tokens, {key("'0'", 'conv_id')} AS shuffle_key FROM kept LEFT JOIN s USING (conv_id)""",
    "clean_response": r"""WITH r AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN ' ' || chr(10) || '<|im_start|>' ELSE chr(10) END || text ||
         CASE WHEN turn % 3 = 0 THEN chr(10) ELSE '<|im_end|>' || chr(10) || ' ' END AS body FROM conversations),
t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(body, '^\s+', ''), '\s+$', '') AS body FROM r),
u AS (SELECT conv_id, turn, CASE WHEN body LIKE '<|im\_start|>%' ESCAPE '\' THEN substr(body, 13) ELSE body END AS body FROM t)
SELECT conv_id, turn, md5(CASE WHEN suffix(body, '<|im_end|>') THEN left(body, length(body) - 10) ELSE body END) AS answer_md5 FROM u""",
    "truncate_generation": f"""WITH r AS (SELECT doc_id, list_transform({words('text')}, lambda w: length(w) % 12) AS ids FROM documents),
s AS (SELECT doc_id, ids, least(4, len(ids)) AS p, list_position(ids[5:], 0) AS hit FROM r)
SELECT doc_id, CASE WHEN hit > 0 THEN p + hit - 1 ELSE len(ids) END AS n_kept, CASE WHEN hit > 0 THEN p + hit - 1 END AS finish_index,
       {digest('ids[1:CASE WHEN hit > 0 THEN p + hit - 1 ELSE len(ids) END]')} AS answer_ids FROM s""",
    "generate_table": """WITH RECURSIVE g AS (
  SELECT doc_id, [doc_id % 50, n_chars % 50] AS ids, 0 AS step, NULL::bigint AS fin FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN (ids[-1] * 7 + 3) % 50 = 24 THEN ids ELSE list_append(ids, (ids[-1] * 7 + 3) % 50) END, step + 1,
         CASE WHEN (ids[-1] * 7 + 3) % 50 = 24 THEN len(ids) END FROM g WHERE step < 12 AND fin IS NULL)
SELECT doc_id, len(ids) AS n_ids, fin AS finish_index, md5(array_to_string(ids, ',')) AS output_ids FROM g
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1""",
    "select_token": f"""WITH e AS (SELECT vec_id, embedding::double[] AS v FROM embeddings),
x AS (SELECT vec_id, v, list_transform(v, lambda y: exp((y - list_max(v)) / 0.1)) AS w, {number(key('vec_id'))} / 4294967296.0 AS u FROM e),
c AS (SELECT vec_id, v, u, unnest(w) / list_sum(w) AS p, generate_subscripts(w, 1) AS i FROM x),
s AS (SELECT vec_id, v, u, sum(p) OVER (PARTITION BY vec_id ORDER BY i) AS upto FROM c)
SELECT vec_id, min(list_position(v, list_max(v)))::bigint - 1 AS greedy, least(count(*) FILTER (upto <= u), 63)::bigint AS drawn FROM s GROUP BY vec_id""",
    "l2_normalize": f"""WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::double * (vec_id % 5 + 2)) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt({dot('v', 'v')}) AS norm FROM s)
SELECT vec_id, round(norm, 6) AS norm, round({dot('v', 'v')} / norm, 6) AS own_dot, round(v[1] / norm, 6) AS first, round(v[64] / norm, 6) AS last FROM n""",
    "softmax_probs": """WITH x AS (SELECT vec_id, list_transform(embedding, lambda y: exp(y::double / 0.5)) AS w FROM embeddings),
p AS (SELECT vec_id, list_transform(w, lambda y: y / list_sum(w)) AS p FROM x)
SELECT vec_id, round(list_max(p), 6) AS top, round(p[1], 6) AS first, round(-list_sum(list_transform(p, lambda y: y * ln(y))), 6) AS entropy FROM p""",
    "scaled_dot": """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x, i: x::double * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)) * exp(0.07), 6) AS score,
       round(least(exp(label), 100), 6) AS clamped FROM embeddings""",
    "argmax_by": """WITH each AS (SELECT label::bigint AS label, round(unnest(embedding)::double, 1) AS x, generate_subscripts(embedding, 1)::bigint - 1 AS place FROM embeddings)
SELECT label, place AS best FROM each QUALIFY row_number() OVER (PARTITION BY label ORDER BY x DESC, place) = 1""",
    "project": "SELECT vec_id, " + ", ".join(
        f"round(list_sum(list_transform(embedding, lambda x, j: x::double * ((({i} * 7 + (j - 1) * 3) % 11) - 5) / 10.0)) + {i} / 10.0, 6) AS y{i}"
        for i in range(4)
    ) + " FROM embeddings",
    "pool_tokens": """WITH e AS (SELECT vec_id, embedding::double[] AS v, vec_id % 8 AS t FROM embeddings)
SELECT vec_id, round(list_sum(v[1:8]), 6) AS first, round(list_sum(v[t * 8 + 1:t * 8 + 8]), 6) AS last, round(list_sum(v[9:64]), 6) AS rest FROM e""",
    "gather_ranks": "SELECT vec_id, vec_id // 64 AS batch_id, vec_id % 64 AS pos FROM embeddings",
    "concat_ranks": "SELECT vec_id, label::bigint AS label, CASE WHEN label < 5 THEN 0 ELSE 1 END::bigint AS rank FROM embeddings",
    "batch_pairs": f"""WITH {towers(64, '10')}
SELECT r.b AS batch_id, r.i % 64 AS pos, round(own, 6) AS own, round(r.lse, 6) AS image_lse, round(c.lse, 6) AS text_lse, best % 64 AS best
FROM rws r JOIN cls c ON r.b = c.b AND r.i = c.j""",
    "contrastive_global": contrastive(64),
    "contrastive_local": contrastive(16),
    "class_prompts": "SELECT n_nationkey::bigint AS label, 'a photo of a ' || lower(n_name) AS prompt FROM nation",
    "zero_shot": f"WITH {CLASSES} SELECT vec_id, label, predicted, round(z, 6) AS score FROM best",
    "zero_shot_blocks": f"WITH {CLASSES} SELECT vec_id, label, predicted, round(z, 6) AS score FROM best",
    "zero_shot_accuracy": f"""WITH {CLASSES}
SELECT count(*) FILTER (predicted = label) AS correct, count(*) AS total, round(avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM best""",
    "image_normalize": f"""WITH p AS (SELECT vec_id, {LEVELS} AS d FROM embeddings)
SELECT vec_id, 192::bigint AS n_values, round((d[1] / 255.0 - 0.485) / 0.229, 4)::double AS v0, round((d[64] / 255.0 - 0.485) / 0.229, 4)::double AS v63,
       round((d[1] / 255.0 - 0.456) / 0.224, 4)::double AS v64, round((d[64] / 255.0 - 0.406) / 0.225, 4)::double AS v191 FROM p""",
    "image_resize": f"""WITH p AS (SELECT vec_id, {LEVELS} AS d FROM embeddings),
q AS (SELECT vec_id, list_transform(range(48), lambda i: d[((i // 3) // 4 * 2 + 1) * 8 + ((i // 3) % 4) * 2 + 2]) AS s FROM p)
SELECT vec_id, 4::bigint AS width, 3::bigint AS channels, {hexes('s')} AS data FROM q""",
    "image_resize_bilinear": f"""WITH p AS (SELECT vec_id, {LEVELS} AS d FROM embeddings),
q AS (SELECT vec_id, list_transform(range(48), lambda i: (
    d[(i // 12) * 16 + (i // 3 % 4) * 2 + 1] + d[(i // 12) * 16 + (i // 3 % 4) * 2 + 2] +
    d[(i // 12) * 16 + 8 + (i // 3 % 4) * 2 + 1] + d[(i // 12) * 16 + 8 + (i // 3 % 4) * 2 + 2] + 2) // 4) AS s FROM p)
SELECT vec_id, 4::bigint AS width, {hexes('s')} AS data FROM q""",
    "image_folder": f"""WITH p AS (SELECT vec_id, {LEVELS} AS d FROM embeddings)
SELECT vec_id::varchar AS image_id, 8::bigint AS width, {hexes('d')} AS data FROM p""",
    "image_patches": f"""WITH p AS (SELECT vec_id, {LEVELS} AS d FROM embeddings),
q AS (SELECT vec_id, patch, list_transform(range(16), lambda i: d[(patch // 2 * 4 + i // 4) * 8 + patch % 2 * 4 + i % 4 + 1] / 255.0) AS v FROM p, range(4) r(patch))
SELECT vec_id, patch, 48::bigint AS n_values, round(list_sum(v) * 3, 4) AS total, round(v[6], 4) AS v5 FROM q""",
    "image_decode": f"""WITH p AS (SELECT vec_id, {LEVELS} AS d FROM embeddings)
SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN 0 ELSE 1 END::bigint AS decoded,
       CASE WHEN vec_id % 7 <> 3 THEN {hexes('list_transform(range(192), lambda i: d[i // 3 + 1])')} END AS data FROM p""",
    "attach_images": f"""WITH {FIRST}, p AS (SELECT vec_id, {LEVELS} AS d FROM embeddings)
SELECT conv_id, n_pairs, {hexes('d')} AS data FROM valid JOIN p ON conv_id = vec_id""",
    "val_loss": """SELECT user_id, count(*) AS n_batches, round(avg(value), 6) AS mean_loss FROM
(SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10) GROUP BY user_id""",
    "accum_loss": "SELECT event_id // 8 AS step, count(*) AS n_micro, round(sum(value / 8), 6) AS loss FROM events GROUP BY event_id // 8",
    "rank_mean": """SELECT step, count(*) AS n_ranks, round(avg(s), 6) AS loss FROM
(SELECT event_id // 16 AS step, user_id % 4 AS rank, sum(value) AS s FROM events GROUP BY 1, 2) GROUP BY step""",
    "every_k": "SELECT event_id, value FROM events WHERE event_id % 100 = 0 OR event_id = (SELECT max(event_id) FROM events)",
    "take_per_group": "SELECT event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 25",
    "masked_mean": f"""WITH {CAPTION_SAMPLES},
numbered AS (SELECT {ids('full_text')} AS ids, len({words('prompt_text')}) AS p, row_number() OVER (ORDER BY {key('doc_id')}) - 1 AS place FROM rendered)
SELECT place // 32 AS batch_id, sum(len(ids) - p)::bigint AS n_tokens,
       round(sum(list_sum(list_transform(ids[p + 1:], lambda x: (x % 13) / 13.0))) / sum(len(ids) - p), 6) AS loss FROM numbered GROUP BY place // 32""",
    "stream_prepare": f"""SELECT doc_id, {digest(words('text'))} AS tokens FROM documents
WHERE len({words('text')}) + 1 > 1 AND len({words('text')}) + 1 < 128""",
    "stream_disjoint": f"SELECT doc_id FROM documents WHERE md5(lower(trim(text))) NOT IN {USED}",
    "stream_batches": f"""SELECT doc_id, place // 48 AS batch_id, place % 48 AS pos FROM ({RANKED_DOCS})
WHERE place // 48 < (SELECT count(*) // 48 FROM documents)""",
    "run_log_metrics": run_log(1000),
    "stream_run_log": run_log(1000),
}
