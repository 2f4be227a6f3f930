"""The queries opN_<name>: each applies one operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import capjoin, decontaminate, htmltext, linededup, lmscore, minhash, mixing, tokens, toxicity, warc
from corpusloom.llm.base import save, scratch_path, table

#: Characters of which words, and of which benchmark words, consist not; the lower-casing of both queries and their SQL.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").where("quality = 1")
    scored = lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), target)
    return scored.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op4_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capjoin.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), cosine=0.9)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archives = warc.write_archives(pages, scratch_path(spark, "warc"))
    heads = save(warc.read_archives(archives, payloads=False), "warc-heads")
    records = warc.resolve_revisits(heads)
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    sound = F.when(F.col("valid"), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("WARC record not valid: "), "record_id")).cast("long"))
    return records.select(page("record_id").alias("page_id"), sound.alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=4, percent=80)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = linededup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "removed_units", "removed_words", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_embedding_neardup": op4_embedding_neardup,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_minhash_neardup": op7_minhash_neardup,
    "op8_html_extraction": op8_html_extraction,
    "op9_line_dedup": op9_line_dedup,
    "op10_token_counts": op10_token_counts,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op1_lm_scoring": rf"""
WITH aim AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL),
docs AS (
  SELECT row_number() OVER () AS r, d.doc_id, regexp_extract_all({LOWER}, '{ALNUM_WORD}') AS w, (a.doc_id IS NOT NULL)::INT AS y
  FROM documents d LEFT JOIN aim a ON d.doc_id = a.doc_id),
tokens AS (SELECT r, y, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
total AS (SELECT CAST(count(*) AS DOUBLE) AS b, CAST(coalesce(sum(y), 0) AS DOUBLE) AS t, CAST(count(DISTINCT word) AS DOUBLE) AS m FROM tokens),
smooth AS (SELECT word, (count(*) + 1) / (any_value(n.b) + any_value(n.m) + 1) AS b, (sum(y) + 1) / (any_value(n.t) + any_value(n.m) + 1) AS t FROM tokens, total n GROUP BY word),
steps AS (SELECT r, y, word, coalesce(lag(word) OVER (PARTITION BY r ORDER BY i), '<begin>') AS before FROM tokens),
bigrams AS (SELECT before, word, CAST(count(*) AS DOUBLE) AS b, CAST(sum(y) AS DOUBLE) AS t FROM steps GROUP BY 1, 2),
histories AS (SELECT before, sum(b) AS b, sum(t) AS t FROM bigrams GROUP BY before),
losses AS (
  SELECT g.before, g.word, -ln((g.b + 50 * s.b) / (h.b + 50)) AS b, -ln((g.t + 50 * s.t) / (h.t + 50)) AS t
  FROM bigrams g JOIN histories h USING (before) JOIN smooth s ON s.word = g.word),
sums AS (SELECT r, sum(l.b) AS b, sum(l.t) AS t FROM steps JOIN losses l USING (before, word) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(t / len(w), 6) AS target_loss, round(b / len(w), 6) AS background_loss, round((t - b) / len(w), 6) AS score
FROM docs LEFT JOIN sums USING (r)""",
    "op2_mixing": rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{SPACED_WORD}')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight FROM totals),
led AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - 3.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST)),
shared AS (SELECT level AS share FROM led WHERE level * weight <= 3.0::DOUBLE * source_size ORDER BY source_size / weight, source ASC NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, share * weight) AS target FROM led LEFT JOIN shared ON true),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets),
drawn AS (
  SELECT *, CAST(floor(CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE * 4096) AS INT) AS cell FROM sized),
cells AS (SELECT source, cell, CAST(sum(size) AS BIGINT) AS words FROM drawn GROUP BY source, cell),
ends AS (
  SELECT r.source, c.cell + 1 AS cut, (r.rate - floor(r.rate)) * r.source_size AS wanted, abs(sum(words) OVER (PARTITION BY c.source ORDER BY cell) - (r.rate - floor(r.rate)) * r.source_size) AS off
  FROM cells c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source),
cuts AS (SELECT source, CASE WHEN off < wanted THEN cut ELSE 0 END AS cut FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY off, cut) AS place FROM ends) WHERE place = 1)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN cell < coalesce(cut, 0) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source""",
    "op3_decontamination": rf"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '{ALNUM_WORD}') AS w FROM documents),
bw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all({LOWER}, '{ALNUM_WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dwin AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT r, n, i, item FROM dwin JOIN win USING (n, words)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
owned AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN owned USING (r)""",
    "op7_minhash_neardup": rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({LOWER}, '{SPACED_WORD}') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
shingles AS (SELECT doc_id, unnest(s) AS s FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)),
linked AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM linked UNION SELECT r.doc_id, l.b FROM reach r JOIN linked l ON r.other = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, low) AS component_id, doc_id = least(doc_id, low) AS kept
FROM sets LEFT JOIN (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id) USING (doc_id)""",
    "op4_embedding_neardup": """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.r AS ra, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, low) AS component_id, v.vec_id = least(v.vec_id, low) AS kept
FROM v LEFT JOIN (SELECT ra AS r, count(*) AS n FROM links GROUP BY ra) USING (r)
LEFT JOIN (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id) m ON m.vec_id = v.vec_id""",
    "op5_warc": """
WITH hashed AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS h FROM pages),
chars AS (SELECT *, list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT)) AS v FROM hashed),
coded AS (
  SELECT page_id, size, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((v[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31 AS BIGINT) + 1, 1)), '') AS d FROM chars),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY d, size) AS top FROM coded)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM kept""",
}
