"""The queries' results as DuckDB SQL over the same tables, written from their meaning and not from their plans."""

#: Words that ASCII white space parts; a text in lower case with its white space folded.
WORDS = r"regexp_extract_all({}, '[^ \t\n\x0B\f\r]+')"
N_WORDS = f"CAST(len({WORDS.format('text')}) AS BIGINT)"
#: White space as Unicode has it, for a class of characters; words by it.
BLANK = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNICODE_WORDS = f"regexp_extract_all(text, '[^{BLANK}]+')"
FOLD = r"trim(regexp_replace(lower({}), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
#: Events as frames.
FRAMES = "f AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame FROM events)"
#: Norms and products of vectors in double precision.
VECTORS = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"

ORACLE_SQL: dict[str, str] = {
    "attested_sources": """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS share FROM c)
SELECT lang, source, n, round(share, 6) AS share, CAST(row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS INT) AS rank
FROM s WHERE lang NOT LIKE 'und%' AND n >= 5 AND share >= 0.15""",
    "lang_histogram_by_source": "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL",
    "lang_totals": """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(max(n) / sum(n), 6) AS top_share, count(*) AS sources FROM c GROUP BY lang""",
    "doc_funnel_reasons": f"""
SELECT lang, CASE WHEN toxic = 1 THEN 'toxic' WHEN trim(text) = '' THEN 'empty_text' WHEN n_chars < 40 THEN 'short' WHEN {N_WORDS} < 5 THEN 'few_words'
  WHEN {N_WORDS} > 1500 THEN 'long' WHEN quality = 0 THEN 'low_quality' ELSE 'kept' END AS reason, count(*) AS n
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""",
    "doc_funnel_summary": f"""
WITH r AS (SELECT source, CASE WHEN n_chars < 200 THEN 'short' WHEN {N_WORDS} > ceil(n_chars / 4) THEN 'wordy' ELSE 'kept' END AS reason FROM documents)
SELECT source, count(*) FILTER (reason = 'kept') AS kept, count(*) FILTER (reason = 'short') AS short, count(*) FILTER (reason = 'wordy') AS wordy FROM r GROUP BY source""",
    "reject_anti_join": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1)",
    "enough_text_by_lang": rf"""
SELECT lang, count(*) FILTER (length(text) >= 40 AND (len({UNICODE_WORDS}) >= 5 OR len(regexp_extract_all(text, '[\x{{0E00}}-\x{{0FFF}}\x{{1000}}-\x{{109F}}\x{{1780}}-\x{{17FF}}\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]')) >= 0.5 * length(text))) AS enough, count(*) AS n
FROM documents GROUP BY lang""",
    "ngram_repetition": f"""
WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS INT) AS most_repeated FROM documents LEFT JOIN c USING (doc_id)""",
    "accept_text": rf"""
WITH w AS (SELECT doc_id, text, {UNICODE_WORDS} AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
c AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, len(w) >= 20 AND coalesce(n, 0) <= 3 AND NOT contains(text, '**')
  AND NOT regexp_matches(text, '[\x{{FFFD}}\x{{2018}}\x{{201A}}\x{{201E}}\x{{20AC}}\x{{0400}}-\x{{04FF}}\x{{0600}}-\x{{06FF}}\x{{0900}}-\x{{0D7F}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{20000}}-\x{{2A6DF}}\x{{2A700}}-\x{{2EBEF}}]') AS accepted,
  length(text) BETWEEN 600 AND 1300 AS fits, len(regexp_extract_all(text, '\n')) BETWEEN 5 AND 15 AS lines_fit
FROM w LEFT JOIN c USING (doc_id)""",
    "publish_invariants": "SELECT count(*) AS n, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_text, count(*) - count(DISTINCT doc_id) AS repeated_key FROM documents",
    "benchmark_semi_overlap": rf"""
WITH b AS (SELECT DISTINCT {FOLD.format("t")} AS line FROM (SELECT unnest(string_split(text, chr(10))) AS t FROM benchmark)),
d AS (SELECT doc_id, {FOLD.format("t")} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents))
SELECT doc_id, count(*) AS n FROM d WHERE line <> '' AND line IN (SELECT line FROM b) GROUP BY doc_id""",
    "lookup_left_default": """
WITH l AS (SELECT doc_id, max_by(quality, toxic) AS quality FROM labels GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(quality, -1) AS INT) AS quality, coalesce(nullif(source, ''), nullif(lang, ''), 'unk') AS voice FROM documents LEFT JOIN l USING (doc_id)""",
    "lookup_missing_counts": """
SELECT source, count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) AS n
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY source""",
    "set_difference": "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels",
    "set_intersection": "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1",
    "union_all_tables": """
SELECT origin, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM (
  SELECT 'documents' AS origin, length(text) AS size FROM documents UNION ALL SELECT 'benchmark', length(text) FROM benchmark
  UNION ALL SELECT 'conversations', length(text) FROM conversations) GROUP BY origin""",
    "hard_negatives": "SELECT event_id, user_id, event_type FROM events WHERE value >= 40 AND value < 60",
    "clean_markers": rf"""
WITH c AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]{{0,20}}>', ' ', 'g'), '\[[^\]]{{0,20}}\]', ' ', 'g'), '[{BLANK}]+', ' ', 'g')) AS c FROM pages)
SELECT page_id, CAST(length(c) AS BIGINT) AS n_chars, md5(c) AS md5, regexp_matches(c, '\p{{L}}') AS scoreable FROM c""",
    "script_flags": r"""
WITH k AS (SELECT doc_id, text, [
  {'n': -len(regexp_extract_all(text, '[\x{0600}-\x{06FF}\x{0750}-\x{077F}]')), 'at': 1 + length(regexp_extract(text, '(?s)^[^\x{0600}-\x{06FF}\x{0750}-\x{077F}]*')), 'k': 'arabic'},
  {'n': -len(regexp_extract_all(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}]')), 'at': 2147483647, 'k': 'chinese'},
  {'n': -len(regexp_extract_all(text, '[\x{0400}-\x{04FF}]')), 'at': 1 + length(regexp_extract(text, '(?s)^[^\x{0400}-\x{04FF}]*')), 'k': 'cyrillic'},
  {'n': -len(regexp_extract_all(text, '[\x{0900}-\x{097F}]')), 'at': 1 + length(regexp_extract(text, '(?s)^[^\x{0900}-\x{097F}]*')), 'k': 'devanagari'},
  {'n': -len(regexp_extract_all(text, '[\x{0021}-\x{007E}\x{00A1}-\x{00AC}\x{00AE}-\x{024F}]')), 'at': 1 + length(regexp_extract(text, '(?s)^[^\x{0021}-\x{007E}\x{00A1}-\x{00AC}\x{00AE}-\x{024F}]*')), 'k': 'latin'},
  {'n': -len(regexp_extract_all(text, '[\x{0B80}-\x{0BFF}]')), 'at': 1 + length(regexp_extract(text, '(?s)^[^\x{0B80}-\x{0BFF}]*')), 'k': 'tamil'}] AS c FROM documents)
SELECT doc_id, regexp_matches(text, '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBEF}]') AS han, regexp_matches(text, '[\x{0400}-\x{04FF}]') AS cyrillic,
  regexp_matches(text, '[\x{0600}-\x{06FF}]') AS arabic, regexp_matches(text, '[\x{0900}-\x{0D7F}]') AS indic,
  CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'japanese' WHEN regexp_matches(text, '[\x{1100}-\x{11FF}\x{AC00}-\x{D7AF}]') THEN 'korean'
    WHEN list_min(c).n < 0 THEN list_min(c).k ELSE 'other' END AS kind
FROM k""",
    "tidy_text": rf"""
WITH t AS (SELECT conv_id, turn, regexp_replace(text, '(\p{{Nd}})[{BLANK}]*-[{BLANK}]*(\p{{Nd}})', '\1-\2', 'g') AS c FROM conversations),
f AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(c, '[{BLANK}]+([,.;:!?。，、！？；：])', '\1', 'g'), '[{BLANK}]+', ' ', 'g')) AS c FROM t),
m AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(c, '!+', '!', 'g'), '\?+', '?', 'g'), ',+', ',', 'g'), '。+', '。', 'g') AS c FROM f),
d AS (SELECT conv_id, turn, regexp_replace(regexp_replace(c, '(^|[^.])\.\.($|[^.])', '\1.\2', 'g'), '(^|[^.])\.\.($|[^.])', '\1.\2', 'g') AS c FROM m)
SELECT conv_id, turn, md5(c) AS md5, CAST(length(c) AS BIGINT) AS n_chars FROM d""",
    "url_parse": r"""
SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '') AS scheme, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '') AS host,
  nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '') AS path, nullif(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '') AS query,
  nullif(regexp_extract(url, '#(.*)$', 1), '') AS fragment, nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') AS section
FROM pages""",
    "path_columns": """
SELECT doc_id, source || '_neucodec/' || lang || '/' || doc_id || '.v1.json' AS token_path, source AS folder, 'audio/' || lang || '/' || doc_id || '.v1.mp3' AS audio, lang AS language,
  substr(sha1(source || '/' || lang || '/' || doc_id || '.v1.mp3'), 1, 16) AS file_key, doc_id || '.v1.mp3' AS name
FROM documents""",
    "json_props": """
WITH k AS (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)
SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM k GROUP BY event_type""",
    "tag_f1": """
WITH t AS (SELECT conv_id, turn, CASE length(text) % 3 WHEN 0 THEN 'cough' WHEN 1 THEN 'sigh' ELSE 'laughter' END AS r, CASE length(text) % 4 WHEN 0 THEN 'cough' WHEN 1 THEN 'sigh' ELSE 'laughter' END AS h
  FROM conversations WHERE role = 'user'),
s AS (SELECT tag, count(*) FILTER (r = tag AND h = tag) AS tp, count(*) FILTER (h = tag AND r <> tag) AS fp, count(*) FILTER (r = tag AND h <> tag) AS fn FROM t, (SELECT unnest(['cough', 'laughter', 'sigh']) AS tag) GROUP BY tag),
m AS (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS q FROM s)
SELECT tag, tp, fp, fn, round_even(p, 4) AS precision, round_even(q, 4) AS recall, round_even(2 * p * q / greatest(1e-9, p + q), 4) AS f1 FROM m""",
    "chat_render": """
WITH c AS (SELECT conv_id, count(*) AS n_turns, string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS d FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, md5(d) AS md5, CAST(length(d) AS BIGINT) AS n_chars FROM c""",
    "speak_documents": """
SELECT doc_id, md5('<|im_start|>' || source || ': ' || text || '<|speech_start|>' || array_to_string(list_transform(range(0, least(7, n_chars % 8) + 1), lambda i: '<|s_' || ((i * 31 + doc_id) % 65536) || '|>'), '') || '<|im_end|>') AS md5
FROM documents""",
    "pack_documents": f"""
WITH RECURSIVE d AS (SELECT source, doc_id // 10000 AS shard, doc_id, {N_WORDS} AS n, row_number() OVER (PARTITION BY source, doc_id // 10000 ORDER BY doc_id) AS r FROM documents),
p AS (
  SELECT source, shard, doc_id, n, r, CAST(0 AS BIGINT) AS block, CAST(0 AS BIGINT) AS "offset" FROM d WHERE r = 1
  UNION ALL
  SELECT d.source, d.shard, d.doc_id, d.n, d.r, CASE WHEN p."offset" + p.n + d.n > 2048 AND p."offset" + p.n > 0 THEN p.block + 1 ELSE p.block END,
    CASE WHEN p."offset" + p.n + d.n > 2048 AND p."offset" + p.n > 0 THEN 0 ELSE p."offset" + p.n END
  FROM p JOIN d ON d.source = p.source AND d.shard = p.shard AND d.r = p.r + 1)
SELECT source, doc_id, n, block, "offset" FROM p""",
    "block_layout": f"""
WITH RECURSIVE d AS (SELECT source, doc_id // 10000 AS shard, doc_id, {N_WORDS} AS n, row_number() OVER (PARTITION BY source, doc_id // 10000 ORDER BY doc_id) AS r FROM documents),
p AS (
  SELECT source, shard, n, r, CAST(0 AS BIGINT) AS block, n AS filled FROM d WHERE r = 1
  UNION ALL
  SELECT d.source, d.shard, d.n, d.r, CASE WHEN p.filled + d.n > 2048 AND p.filled > 0 THEN p.block + 1 ELSE p.block END, CASE WHEN p.filled + d.n > 2048 AND p.filled > 0 THEN d.n ELSE p.filled + d.n END
  FROM p JOIN d ON d.source = p.source AND d.shard = p.shard AND d.r = p.r + 1)
SELECT source, shard, block, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens, max(n) AS max_length, CAST(sum(n) AS BIGINT) AS "end", CAST(sum(n) AS BIGINT) AS n_positions, max(n) > 2048 AS oversized
FROM p GROUP BY source, shard, block""",
    "mixture_index": """
WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
k AS (SELECT DISTINCT source, n, CAST(greatest(1, round_even(n * 0.3::DOUBLE, 0)) AS BIGINT) AS c FROM d),
w AS (SELECT source, CAST(trunc(j * (CAST(n AS DOUBLE) / c)) AS BIGINT) AS i FROM (SELECT *, unnest(range(0, c)) AS j FROM k))
SELECT source, doc_id, CAST(0 AS BIGINT) AS copy FROM d JOIN w USING (source, i)""",
    "mixture_repeats": """
WITH b AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i, count(*) OVER () AS n FROM benchmark),
k AS (SELECT n, unnest(range(0, CAST(greatest(1, round_even(n * 2.6::DOUBLE, 0)) AS BIGINT))) AS j FROM (SELECT DISTINCT n FROM b))
SELECT item_id, j // b.n AS copy FROM b JOIN k ON k.j % b.n = b.i""",
    "mixture_totals": """
WITH p AS (SELECT lang, source, count(*) AS blocks, CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END AS weight FROM documents GROUP BY lang, source),
s AS (SELECT lang, count(*) AS packs, CAST(sum(blocks) AS BIGINT) AS blocks, CAST(sum(floor(blocks * 10240 * 0.97::DOUBLE)) AS BIGINT) AS tokens, sum(blocks * weight) AS weighted FROM p GROUP BY lang),
g AS (SELECT *, sum(weighted) OVER () AS grand FROM s)
SELECT lang, packs, blocks, tokens, round(weighted, 6) AS weighted, round(weighted / grand, 6) AS share, CAST(floor(grand / 64) AS BIGINT) AS steps,
  CAST(greatest(1, round_even(floor(grand / 64) * 0.1::DOUBLE, 0)) AS BIGINT) AS decay FROM g""",
    "vocab_append": """
WITH o AS (SELECT token, row_number() OVER (ORDER BY token DESC) - 1 AS pos FROM (SELECT DISTINCT source AS token FROM documents WHERE lang = 'en')),
n AS (SELECT lang AS token FROM documents UNION SELECT source FROM documents),
f AS (SELECT token, row_number() OVER (ORDER BY token) - 1 + (SELECT coalesce(max(pos) + 1, 0) FROM o) AS pos FROM n WHERE token IS NOT NULL AND token NOT IN (SELECT token FROM o))
SELECT token, CAST(pos AS BIGINT) AS pos FROM o UNION ALL SELECT token, CAST(pos AS BIGINT) FROM f""",
    "tag_vocabulary": """
SELECT token, CAST(row_number() OVER (ORDER BY token) - 1 AS BIGINT) AS pos
FROM (SELECT '<|' || event_type || '|>' AS token FROM events UNION SELECT '<|' || lang || '|>' FROM documents)""",
    "stratified_sample": """
WITH h AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('7:' || doc_id), doc_id) AS r FROM documents)
SELECT source, doc_id, CAST(r AS INT) AS rank FROM h WHERE r <= 10""",
    "budget_round_robin": """
WITH RECURSIVE b AS (SELECT 1000000 AS budget),
d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS depth FROM documents),
o AS (SELECT *, row_number() OVER (ORDER BY depth, source) AS r FROM d),
f AS (
  SELECT r, source, doc_id, depth, n_chars <= budget AS taken, CASE WHEN n_chars <= budget THEN CAST(n_chars AS HUGEINT) ELSE 0 END AS total, n_chars <= budget AS took, false AS ended
  FROM o, b WHERE r = 1
  UNION ALL
  SELECT r, source, doc_id, depth, fits, CASE WHEN fits THEN total + n_chars ELSE total END, CASE WHEN same THEN took OR fits ELSE fits END, now_ended
  FROM (
    SELECT *, NOT now_ended AND total + n_chars <= budget AS fits FROM (
      SELECT o.r, o.source, o.doc_id, o.depth, o.n_chars, f.total, f.took, b.budget, o.depth = f.depth AS same, f.ended OR (o.depth <> f.depth AND NOT f.took) AS now_ended
      FROM f JOIN o ON o.r = f.r + 1, b)))
SELECT source, doc_id, CAST(depth AS BIGINT) AS depth, taken FROM f""",
    "snake_assignment": """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey DESC, c_custkey) - 1 AS i FROM customer)
SELECT c_custkey, CAST(CASE WHEN (i // 7) % 2 = 0 THEN i % 7 ELSE 6 - i % 7 END AS INT) AS worker FROM r""",
    "chunk_assignment": """
WITH r AS (SELECT s_suppkey, ntile(7) OVER (ORDER BY s_suppkey) - 1 AS chunk FROM supplier)
SELECT CAST(chunk AS INT) AS chunk, count(*) AS n, min(s_suppkey) AS first FROM r GROUP BY chunk""",
    "wave_assignment": """
WITH r AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS i, greatest(1, CAST(ceil(count(*) OVER () / 4) AS BIGINT)) AS step FROM nation)
SELECT n_name, CAST(i // step AS INT) AS wave FROM r""",
    "cap_per_file": """
SELECT source, lang, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 3""",
    "bin_labels": """
WITH p AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events),
e AS (SELECT list_transform(range(0, 8), lambda i: lo + (hi - lo) * i / 7) AS edges FROM p)
SELECT event_id, ['very noisy', 'quite noisy', 'slightly noisy', 'moderate ambient sound', 'slightly clear', 'quite clear', 'very clear'][greatest(0, least(6, len(list_filter(edges, lambda x: x < value)) - 1)) + 1] AS label
FROM events, e""",
    "bin_labels_by_group": """
WITH p AS (SELECT event_type, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events GROUP BY event_type),
e AS (SELECT event_type, list_transform(range(0, 8), lambda i: lo + (hi - lo) * i / 7) AS edges FROM p)
SELECT event_id, event_type, ['very low pitch', 'quite low pitch', 'slightly low pitch', 'moderate pitch', 'slightly high pitch', 'quite high pitch', 'very high pitch'][greatest(0, least(6, len(list_filter(edges, lambda x: x < value)) - 1)) + 1] AS label
FROM events JOIN e USING (event_type)""",
    "calibrated_scores": """
WITH v AS (SELECT user_id, value / 100 AS v FROM events)
SELECT user_id, count(*) AS num_hops, round(avg(v), 6) AS ovrl_raw, round(avg((-0.06766283::DOUBLE * v + 1.11546468::DOUBLE) * v + 0.04602535::DOUBLE), 6) AS ovrl,
  round(avg((-0.08397278::DOUBLE * v + 1.22083953::DOUBLE) * v + 0.0052439::DOUBLE), 6) AS sig, round(avg((-0.13166888::DOUBLE * v + 1.60915514::DOUBLE) * v - 0.39604546::DOUBLE), 6) AS bak
FROM v GROUP BY user_id""",
    "nested_mean_scores": """
WITH u AS (SELECT event_type, user_id, avg(value) AS s FROM events GROUP BY ALL), t AS (SELECT event_type, avg(s) AS s FROM u GROUP BY event_type)
SELECT event_type, round(s, 6) AS score FROM t UNION ALL SELECT 'all', round(avg(s), 6) FROM t""",
    "audit_summary": """
WITH d AS (SELECT doc_id, source, text, lang, CASE WHEN lang IN ('fr', 'es') THEN 'romance' ELSE lang END AS macro, (n_chars % 100) / 100 AS prob, (n_chars % 7) / 10 AS margin FROM documents),
s AS (SELECT source, count(*) AS n, avg(prob) AS mp, count(*) FILTER (prob >= 0.5) AS confident, count(*) FILTER (NOT prob >= 0.5) AS unsure, count(*) FILTER (margin < 0.1) AS close FROM d GROUP BY source),
l AS (SELECT source, lang, count(*) AS k, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM d WHERE prob >= 0.5 GROUP BY source, lang),
m AS (SELECT source, macro, count(*) AS k, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, macro) AS r FROM d WHERE prob >= 0.5 GROUP BY source, macro),
t AS (SELECT source, string_agg(lang || ':' || k, ' ' ORDER BY r) AS top FROM l WHERE r <= 8 GROUP BY source),
x AS (SELECT d.source, substr(text, 1, 120) AS s, row_number() OVER (PARTITION BY d.source ORDER BY doc_id) AS r FROM d JOIN m ON m.source = d.source AND m.r = 1 AND d.macro <> m.macro WHERE prob >= 0.5),
y AS (SELECT source, string_agg(s, '|' ORDER BY r) AS ex FROM x WHERE r <= 3 GROUP BY source)
SELECT s.source, n, round(mp, 6) AS mean_prob, confident, unsure, close, coalesce(l.lang, 'und') AS dominant, round(coalesce(l.k, 0) / n, 6) AS dominant_share, coalesce(m.macro, 'und') AS dominant_macro,
  round(coalesce(m.k, 0) / n, 6) AS macro_share, coalesce(top, '') AS top_labels, md5(coalesce(ex, '')) AS examples_md5
FROM s LEFT JOIN l ON l.source = s.source AND l.r = 1 LEFT JOIN m ON m.source = s.source AND m.r = 1 LEFT JOIN t ON t.source = s.source LEFT JOIN y ON y.source = s.source""",
    "group_advantage": """
SELECT event_id, round(coalesce((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-8), 0.0), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)""",
    "threshold_sweep": """
SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN event_type = 'click' THEN CAST(value >= t AS DOUBLE) END), 6) AS recall, round(avg(CASE WHEN event_type <> 'click' THEN CAST(value >= t AS DOUBLE) END), 6) AS false_positive_rate
FROM events, (SELECT unnest([10, 50, 100, 200, 400]) AS t) GROUP BY t""",
    "value_percentiles": """
SELECT unnest([10, 25, 50, 75, 90, 95, 99]) AS percentile, round(unnest(quantile_cont(value, [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99])), 6) AS value FROM events""",
    "leaderboard": """
WITH r AS (SELECT o_custkey, sum(o_totalprice) AS train, min(o_orderstatus) AS status, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS dev FROM orders GROUP BY o_custkey),
m AS (SELECT o_custkey, CASE WHEN status = 'F' THEN CASE WHEN (SELECT count(*) FROM r WHERE status = 'F' AND dev IS NULL) = 0 THEN dev ELSE train END END AS metric FROM r)
SELECT o_custkey, round(metric, 2) AS metric, CASE WHEN metric IS NOT NULL THEN CAST(row_number() OVER (ORDER BY metric ASC NULLS LAST, o_custkey) AS INT) END AS place FROM m""",
    "pivot_best": """
WITH m AS (SELECT n_name, c_mktsegment, round(avg(c_acctbal), 4) AS score FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
e AS (SELECT *, min(score) OVER (PARTITION BY c_mktsegment) AS lo, max(score) OVER (PARTITION BY c_mktsegment) AS hi, row_number() OVER (PARTITION BY c_mktsegment ORDER BY score, n_name) AS r FROM m)
SELECT n_name, c_mktsegment, score, r = 1 AS best, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END, 6) AS scaled FROM e""",
    "dataset_card": """
SELECT lang, count(*) AS rows, round(sum(CAST(n_chars AS DOUBLE)) / 60, 6) AS minutes, string_agg(DISTINCT source, ',' ORDER BY source) AS subsets FROM documents GROUP BY lang""",
    "speaker_sizes": """
WITH k AS (SELECT lang, source, count(*) AS k FROM documents GROUP BY ALL)
SELECT lang, count(*) AS members, string_agg(k, ',' ORDER BY k DESC) AS sizes, min(k) AS least, quantile_cont(CAST(k AS DOUBLE), 0.5) AS median, max(k) AS most, list_sort(list(k), 'DESC')[count(*) // 2 + 1] AS upper_middle
FROM k GROUP BY lang""",
    "speaker_pairs": f"""
WITH {VECTORS}
SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3""",
    "centroid_assign": f"""
WITH {VECTORS},
u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(u) AS x, unnest(range(0, len(u))) AS i FROM u) GROUP BY label, i) GROUP BY label),
s AS (SELECT vec_id, c.label AS centroid, list_cosine_similarity(u, c) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(u, c) DESC, c.label) AS r FROM u, c)
SELECT vec_id, centroid, round(similarity, 6) AS similarity FROM s WHERE r = 1""",
    "silhouette": f"""
WITH {VECTORS},
u AS (SELECT vec_id, label, CAST(label % 2 AS INT) AS place, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v),
d AS (SELECT a.place, a.vec_id, a.label AS own, b.label AS other, avg(1 - list_dot_product(a.u, b.u)) AS d FROM u a JOIN u b ON a.place = b.place AND a.vec_id <> b.vec_id GROUP BY ALL),
s AS (SELECT place, vec_id, min(d) FILTER (own = other) AS a, min(d) FILTER (own <> other) AS b FROM d GROUP BY ALL)
SELECT place, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s GROUP BY place""",
    "event_sessions": f"""
WITH {FRAMES},
g AS (SELECT *, max(value) OVER (PARTITION BY user_id) AS raw, count(*) OVER (PARTITION BY user_id) AS n FROM f),
h AS (SELECT user_id, frame, list_sort([
    coalesce(lag(value, 2) OVER w, CASE WHEN frame = 0 THEN coalesce(lead(value, 1) OVER w, value) ELSE lag(value, 1) OVER w END), coalesce(lag(value, 1) OVER w, value), value, coalesce(lead(value, 1) OVER w, value),
    coalesce(lead(value, 2) OVER w, CASE WHEN frame = n - 1 THEN coalesce(lag(value, 1) OVER w, value) ELSE lead(value, 1) OVER w END)])[3] AS s
  FROM g WHERE raw >= 60 WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
o AS (SELECT user_id, frame, s, frame - row_number() OVER (PARTITION BY user_id ORDER BY frame) AS run FROM h WHERE s >= 40),
r AS (SELECT user_id, min(frame) AS a, max(frame) + 1 AS b, max(s) AS p FROM o GROUP BY user_id, run),
j AS (SELECT *, CASE WHEN a - lag(b) OVER (PARTITION BY user_id ORDER BY a) < 2 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY a) AS session FROM j)
SELECT user_id, min(a) AS onset, max(b) AS "offset", round(max(p), 6) AS peak FROM k GROUP BY user_id, session HAVING max(b) - min(a) >= 3 AND max(p) >= 60""",
    "interval_overlap": f"""
WITH {FRAMES},
s AS (SELECT user_id, event_id, CAST(frame AS DOUBLE) AS a, frame + value / 100 AS b FROM f WHERE event_type = 'click'),
o AS (SELECT user_id, frame + 0.25::DOUBLE AS a, frame + 0.75::DOUBLE AS b FROM f WHERE event_type <> 'click')
SELECT s.user_id, s.event_id, round(coalesce(sum(CASE WHEN o.a IS NULL THEN 0 ELSE greatest(0, least(s.b, o.b) - greatest(s.a, o.a)) END), 0), 6) AS overlap FROM s LEFT JOIN o ON o.user_id = s.user_id AND o.a < s.b AND o.b > s.a GROUP BY ALL""",
    "asof_forward": f"""
WITH {FRAMES}
SELECT c.user_id, c.event_id, p.event_id AS purchase FROM (SELECT * FROM f WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM f WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.frame <= p.frame""",
    "cyclic_pairing": """
WITH d AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
p AS (SELECT a.source, a.doc_id, b.lang AS partner, row_number() OVER (PARTITION BY a.source, a.doc_id ORDER BY (b.i - a.i + a.n) % a.n) AS r FROM d a JOIN d b ON a.source = b.source AND a.lang <> b.lang)
SELECT d.source, d.doc_id, coalesce(p.partner, d.lang) AS partner FROM d LEFT JOIN p ON p.source = d.source AND p.doc_id = d.doc_id AND p.r = 1""",
    "retries_missing": """
SELECT lang, CAST(retry AS INT) AS retry, count(*) AS n FROM documents, (SELECT unnest(range(0, 3)) AS retry) WHERE n_chars % 3 <> retry GROUP BY ALL""",
    "stream_tumbling": "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS most FROM events GROUP BY ALL",
    "stream_sliding": """
SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS most FROM events, (SELECT unnest(range(0, 4)) AS k) GROUP BY ALL""",
    "stream_session": """
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n, round(sum(value), 6) AS total, round(max(value), 6) AS most FROM s GROUP BY user_id, k""",
    "frame_layout": """
WITH d AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS segment, (n_chars % 2000) // 320 AS n FROM documents)
SELECT source, CAST(sum(n) AS BIGINT) AS frames, max(segment) AS segments, max(n) - 1 AS longest FROM d WHERE n > 0 GROUP BY source""",
    "generated_tokens": "SELECT doc_id, doc_id || ',' || n_chars AS tokens FROM documents",
    "codec_layers": """
WITH d AS (SELECT doc_id, doc_id % 4096 AS o, [doc_id % 4096, (doc_id + 1) % 4096] AS t, [(doc_id * 3 + i) % 4096 for i in range(0, 4)] AS h FROM documents)
SELECT doc_id, array_to_string([128266 + o, 132362 + t[1], 136458 + h[1], 140554 + h[2], 144650 + t[2], 148746 + h[3], 152842 + h[4]], ',') AS ids,
  CAST(o AS VARCHAR) AS one, array_to_string(t, ',') AS two, array_to_string(h, ',') AS three FROM d""",
    "window_counts": """
SELECT doc_id, CAST(greatest(1, CAST(trunc(floor(n_chars * 160 / 16000) - 9.01::DOUBLE) AS INT) + 1) AS INT) AS hops, n_chars * 160 // 320 * 320 AS trimmed, n_chars * 160 // 320 AS positions,
  n_chars * 160 BETWEEN 4800 AND 480000 AS fits FROM documents""",
    "run_summaries": f"""
WITH {FRAMES},
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frame DESC) AS r FROM f),
m AS (SELECT user_id, max_by(value, frame) AS fl, avg(CASE WHEN r <= 10 THEN value END) AS lm, min(value) AS ml, count(*) AS sl, max_by(value, frame) FILTER (event_type = 'click') AS cf, min(value) FILTER (event_type = 'click') AS cm, count(*) FILTER (event_type = 'click') AS cp FROM r GROUP BY user_id)
SELECT user_id, round(fl, 6) AS final_loss, round(lm, 6) AS last_mean_loss, round(ml, 6) AS min_loss, sl AS steps_logged, round(cf, 6) AS click_final, round(cm, 6) AS click_min, cp AS click_points, round(cf, 6) AS dev_mean, round(cm, 6) AS dev_min_mean FROM m""",
    "heat_map": """
WITH m AS (SELECT source, lang, avg(n_chars) AS a FROM documents GROUP BY ALL)
SELECT source, round(max(a) FILTER (lang = 'de'), 4) AS de, round(max(a) FILTER (lang = 'en'), 4) AS en, round(max(a) FILTER (lang = 'es'), 4) AS es, round(max(a) FILTER (lang = 'fr'), 4) AS fr, round(avg(a), 4) AS mean FROM m GROUP BY source""",
    "rank_table": """
WITH m AS (SELECT c_nationkey, avg(c_acctbal) AS a FROM customer GROUP BY c_nationkey), r AS (SELECT *, CAST(row_number() OVER (ORDER BY a, c_nationkey) AS INT) AS place FROM m)
SELECT place, '| ' || place || ' | ' || c_nationkey || ' |' AS line FROM r""",
    "trusted_labels": """
SELECT lang, count(*) FILTER (lang = 'en' AND (n_chars % 100) / 100 >= 0.90 AND (n_chars % 11) / 10 >= 0.50) AS trusted, count(*) AS n FROM documents GROUP BY lang""",
    "event_gate": """
SELECT event_type, count(*) FILTER (value >= 30 AND value / 50 >= 0.8) AS kept, count(*) FILTER (value / 100 >= 0.55 AND value / 50 >= 0.1) AS verified, count(*) AS n FROM events GROUP BY event_type""",
    "tag_families": rf"""
WITH c AS (SELECT conv_id, turn, text, CASE length(text) % 3 WHEN 0 THEN 'burping' WHEN 1 THEN 'sigh' ELSE 'cough' END AS f FROM conversations WHERE role = 'user'),
t AS (SELECT conv_id, turn, f, substr(text, 1, 20) || ' ' || CASE WHEN f = 'burping' THEN '' ELSE '<|sfx:' || f || '|>' END || substr(text, 21) AS t FROM c)
SELECT conv_id, turn, md5(trim(regexp_replace(t, '[{BLANK}]+', ' ', 'g'))) AS md5, CASE WHEN f = 'burping' THEN '' ELSE f END AS families, f = 'burping' AS no_tag_left FROM t""",
    "prompt_texts": rf"""
WITH b AS (SELECT conv_id, turn, text AS t, trim(regexp_replace(upper(substr(text, 1, 1)) || substr(text, 2), '[{BLANK}]+', ' ', 'g')) AS p FROM conversations),
c AS (SELECT conv_id, turn, t, replace(replace(replace(replace(replace(replace(p, '...', ', '), '…', ', '), ':', ','), ' - ', ', '), ';', ', '), '—', '-') AS p FROM b),
d AS (SELECT conv_id, turn, t, rtrim(replace(replace(replace(replace(replace(replace(p, '–', '-'), ' ,', ','), '“', '"'), '”', '"'), '‘', ''''), '’', '''')) AS p FROM c)
SELECT conv_id, turn, md5(CASE WHEN length(t) = 0 THEN 'You need to add some text for me to talk.' WHEN regexp_matches(p, '[.!?,、，。？！-]$') THEN p ELSE p || '.' END) AS md5 FROM d""",
    "mixed_words": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\x{{1100}}-\x{{11FF}}\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}\x{{20000}}-\x{{2A6DF}}]|[^{BLANK}\x{{1100}}-\x{{11FF}}\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}\x{{20000}}-\x{{2A6DF}}]+') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS md5 FROM w""",
    "speech_marks": rf"""
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\[[^\]]*\]', '', 'g'), '\([^)]*\)', '', 'g'), '（[^）]*）', '', 'g'), '[\p{{P}}\p{{S}}]', '', 'g'), '[{BLANK}]+', ' ', 'g'))) AS md5 FROM documents""",
    "complete_groups": """
WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, sum(n_chars) OVER (PARTITION BY source) AS w FROM documents),
g AS (SELECT source FROM d WHERE r <= 5 GROUP BY source HAVING count(*) = 5 ORDER BY min(w), source LIMIT 7)
SELECT source, doc_id FROM d WHERE r <= 5 AND source IN (SELECT source FROM g)""",
    "renumbered_clusters": """
WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) - 1 AS i FROM c)
SELECT doc_id, lang, 'spk' || lpad(CAST(i AS VARCHAR), 2, '0') AS spk FROM documents JOIN k USING (lang, source)""",
    "row_index": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents",
    "first_per_source": "SELECT source, min_by(lang, doc_id) AS lang FROM documents GROUP BY source",
    "model_margins": """
WITH p AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS p FROM embeddings),
x AS (SELECT vec_id, unnest(p) AS x, unnest(list_transform(range(0, len(p)), lambda i: 'm' || lpad(CAST(i AS VARCHAR), 2, '0'))) AS l FROM p),
s AS (SELECT vec_id, l, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, l DESC) AS r FROM x)
SELECT a.vec_id, a.l AS label, round(a.s - b.s, 6) AS margin, round(CASE WHEN a.l = 'm00' THEN a.s ELSE least(a.s, 0.49) END, 6) AS prob FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.r = 1 AND b.r = 2""",
    "short_texts_dropped": """
WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations)
SELECT conv_id, turn FROM p WHERE length(text) >= 200 AND length(reply) >= 200""",
    "folder_census": "SELECT lang, source AS folder, count(*) AS n FROM documents GROUP BY ALL",
    "perplexities": "SELECT event_type, round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY event_type",
}
