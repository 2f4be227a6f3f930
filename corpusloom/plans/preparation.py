"""Queries of data preparation: paths, documents, archives, vocabularies of labels, small arrays; each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays, registry
from corpusloom.functions import text as texts
from corpusloom.operators import aggregates, evaluation, filters, joins, mixture, packing, sessions
from corpusloom.plans.oracle import ORACLE_SQL, UNICODE_WORDS
from corpusloom.plans.queries import docs, numbered_events, query
from corpusloom.sources import readers, writers
from corpusloom.sources.readers import table


def answers(sql: str) -> Callable:
    """Registers a query and what it should give."""

    def add(f: Callable) -> Callable:
        ORACLE_SQL[f.__name__] = sql
        return query(f)

    return add


def joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def small(*divisors: int) -> Column:
    """A few token ids of a document."""
    return F.array(*[F.pmod("doc_id", F.lit(d)).cast("int") for d in divisors])


# --- paths and names --------------------------------------------------------------------------------------------------------------------


@answers("""
WITH p AS (SELECT doc_id, lang, source, source || '_trim/' || lang || '/train/' || doc_id || '.mp3' AS p FROM documents)
SELECT doc_id, CASE lang WHEN 'en' THEN source || '_trim_neucodec/' || lang || '/train/' || doc_id || '.json' WHEN 'de' THEN source || '_trim_codec/' || lang || '/train/' || doc_id || '.json' END AS styled,
  replace(p, 'trim', 'cut') AS replaced, source || '_trim_neucodec.zip' AS archive, source || '_trim_neucodec/' || lang || '/train/' || doc_id || '.json' AS member,
  'train' AS split, lang AS language, source || '-x' AS name, lang AS part, source AS base, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS first, CASE WHEN doc_id % 3 = 0 THEN 'unk' ELSE source END AS speaker
FROM p""")
def token_paths(spark, root) -> DataFrame:
    d = docs(spark, root, "doc_id", "lang", "source").withColumn("p", F.concat(F.col("source"), F.lit("_trim/"), F.col("lang"), F.lit("/train/"), F.col("doc_id").cast("string"), F.lit(".mp3")))
    c, third = F.col("p"), F.col("doc_id") % 3 == 0
    archive, member = texts.archive_member(c)
    name, part = texts.name_and_split(F.concat("source", F.lit("-x-"), "lang"))
    return d.select(
        "doc_id", texts.token_path_styled(c, F.col("lang"), {"en": "_neucodec", "de": "_codec"}).alias("styled"), texts.replace_everywhere(c, "trim", "cut").alias("replaced"), archive.alias("archive"), member.alias("member"),
        texts.path_split(c).alias("split"), texts.path_language(c).alias("language"), name.alias("name"), part.alias("part"), texts.shard_base(F.concat("source", F.lit("-0-12"))).alias("base"),
        texts.first_text(F.when(third, F.lit(" ")).otherwise(F.col("source")), F.col("lang")).alias("first"), texts.first_value(F.when(~third, F.col("source"))).alias("speaker"),
    )


@answers("""
SELECT lang, count(*) FILTER (contains(source, '1')) AS in_folder, count(*) FILTER (lang IN ('en', 'de')) AS known, count(*) FILTER (doc_id % 2 = 0) AS trained, count(*) FILTER (n_chars / 500 >= 3.2) AS good,
  count(*) FILTER (len(regexp_extract_all(text, chr(10))) BETWEEN 2 AND 9) AS lined, count(*) FILTER (length(text) BETWEEN 100 AND 900) AS sized, count(*) FILTER (length(text) >= 5 AND length(source) >= 5) AS both,
  count(*) FILTER (regexp_matches(text, '\\p{L}')) AS lettered
FROM documents GROUP BY lang""")
def folder_filters(spark, root) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test"), "doc_id")
    d, t = docs(spark, root), F.col("text")
    return d.groupBy("lang").agg(
        F.count_if(filters.in_folder_like(path, "1")).alias("in_folder"), F.count_if(filters.known_language(F.col("lang"), ["en", "de"])).alias("known"), F.count_if(filters.in_split(path, ["train"])).alias("trained"),
        F.count_if(filters.good_quality(F.col("n_chars") / 500)).alias("good"), F.count_if(filters.newlines_between(t, 2, 9)).alias("lined"), F.count_if(filters.length_between(t, 100, 900)).alias("sized"),
        F.count_if(filters.at_least_chars(t, F.col("source"))).alias("both"), F.count_if(texts.has_letter(t)).alias("lettered"),
    )


@answers("""
SELECT doc_id, lang || '_Latn' AS label, lang AS language, 'Latn' AS script, CASE lang WHEN 'en' THEN 'msa' WHEN 'de' THEN 'ara' ELSE lang END AS macro, lang AS base FROM documents""")
def label_columns(spark, root) -> DataFrame:
    label, language, script = texts.label_parts(F.concat(F.lit("__label__"), "lang", F.lit("_Latn")))
    code = F.when(F.col("lang") == "en", "zsm").when(F.col("lang") == "de", "arz").otherwise(F.col("lang"))
    return docs(spark, root, "doc_id", "lang").select("doc_id", label.alias("label"), language.alias("language"), script.alias("script"), texts.macro_language(code).alias("macro"), texts.language_base(F.concat("lang", F.lit("-XX"))).alias("base"))


@answers("""
SELECT o_orderkey, 'mlr  0.' || o_orderkey || '-b' || o_custkey AS name FROM orders""")
def short_names(spark, root) -> DataFrame:
    run = F.concat(F.lit("sweep-lr0.001-mlr0."), F.col("o_orderkey").cast("string"), F.lit("-wd0.01-b"), F.col("o_custkey").cast("string"))
    return table(spark, root, "orders").select("o_orderkey", texts.short_name(run, "sweep").alias("name"))


# --- documents ------------------------------------------------------------------------------------------------------------------------


@answers("""
WITH d AS (SELECT doc_id, lang, source, text, doc_id % 7 AS a, doc_id % 11 AS b, doc_id % 13 AS c FROM documents),
s AS (SELECT *, '<|s_' || a || '|><|s_' || b || '|><|s_' || c || '|>' AS s3, '<|s_' || a || '|><|s_' || b || '|>' AS s2 FROM d)
SELECT doc_id, md5('<|im_start|><|STT|>' || s3 || '<|' || lang || '|>' || text || '<|im_end|>') AS listen, md5('<|im_start|>' || source || '<|speech_start|>' || s2 || '<|im_end|><|im_start|>' || text || '<|speech_start|>' || s3 || '<|im_end|>') AS pair,
  md5('<|im_start|>' || source || '<|speech_start|>' || s3 || '<|im_end|><|im_start|>' || text || '<|speech_start|>' || s2) AS conversion, '1' || repeat(',9', CAST(a AS INT)) || ',2' AS placeholders FROM s""")
def listen_documents(spark, root) -> DataFrame:
    three, two, text = small(7, 11, 13), small(7, 11), F.col("text")
    return docs(spark, root, "doc_id", "lang", "source", "text").select(
        "doc_id", F.md5(packing.listen_document(three, F.col("lang"), text)).alias("listen"), F.md5(packing.pair_document(F.col("source"), two, text, three)).alias("pair"),
        F.md5(packing.conversion_prompt(F.col("source"), three, text, three)).alias("conversion"), joined(packing.placeholder_ids(F.array(F.lit(1)), 9, F.pmod("doc_id", F.lit(7)) * 320 + 319, F.array(F.lit(2)))).alias("placeholders"),
    )


@answers("""
WITH d AS (SELECT *, '<|im_start|>' || source || ': ' || text AS said, '<|s_' || doc_id % 7 || '|><|s_' || doc_id % 11 || '|>' AS s FROM documents)
SELECT doc_id, task, md5(CASE task WHEN 0 THEN said || '<|description|>a ' || lang || ' voice<|speech_start|>' || s || '<|im_end|>' WHEN 1 THEN said || '<|description|>' || lang || '<|speech_start|>' || s || '<|im_end|>'
  WHEN 2 THEN '<|im_start|>' || s || '<|description|>a ' || lang || ' voice<|im_end|>' ELSE '<|im_start|>' || s || '<|description_category|>' || lang || '<|im_end|>' END) AS document
FROM d, (SELECT CAST(unnest([0, 1, 2, 3]) AS INT) AS task)""")
def expressive_prompts(spark, root) -> DataFrame:
    d = docs(spark, root, "doc_id", "lang", "source", "text").withColumn("manner", F.concat(F.lit("a "), "lang", F.lit(" voice"))).withColumn("tokens", small(7, 11))
    return packing.expressive_documents(d, "source", "text", "manner", "lang", "tokens").select("doc_id", "task", F.md5("document").alias("document"))


@answers("""
SELECT doc_id, md5('based on audio attributes,' || chr(10) || 'fluency timestamp: ' || lang || chr(10) || 'pitch: ' || n_chars || chr(10) || 'noise: ' || CASE WHEN doc_id % 2 = 0 THEN 'unknown' ELSE source END || chr(10) || 'transcript: ' || text
  || chr(10) || chr(10) || 'describe' || chr(10) || '1. rate') AS prompt, '[' || lang || ']' || replace(text, ' ', '[SPACE]') AS spoken FROM documents""")
def attribute_prompts(spark, root) -> DataFrame:
    fields = {"pitch": F.col("n_chars"), "noise": F.when(F.col("doc_id") % 2 == 1, F.col("source"))}
    prompt = packing.attribute_prompt(fields, F.col("lang"), F.col("text"), ("describe", "rate"))
    return docs(spark, root).select("doc_id", F.md5(prompt).alias("prompt"), texts.language_prompt(F.col("text"), F.col("lang")).alias("spoken"))


# --- arrays -----------------------------------------------------------------------------------------------------------------------------


@answers("""
WITH a AS (SELECT doc_id, [CAST(doc_id % 7 AS INT), CAST(doc_id % 11 AS INT), CAST(doc_id % 13 AS INT), 1, 2] AS a FROM documents),
p AS (SELECT *, coalesce(list_position(a, 1), 0) AS f, CASE WHEN coalesce(list_position(a, 2), 0) > 0 THEN list_position(a, 2) ELSE 6 END AS l FROM a)
SELECT doc_id, array_to_string(list_transform(a, lambda x: CASE WHEN x IN (1, 2) THEN -100 ELSE x END), ',') AS masked, array_to_string(a[2:], ',') AS shifted, array_to_string(a[f + 1:l - 1], ',') AS cropped,
  array_to_string(a || a, ',') AS flat, array_to_string(a[1:2], ',') || '/' || array_to_string(a[3:4], ',') || '/' || a[5] AS slices, array_to_string(a || a[1:2], ',') AS tiled,
  array_to_string(list_transform(range(0, greatest(1, CAST(greatest(doc_id % 400 - 144, 0) // 16 AS BIGINT) + CASE WHEN greatest(doc_id % 400 - 144, 0) // 16 = 0 OR (greatest(doc_id % 400 - 144, 0) % 16 + 144) / 160 >= 0.8 THEN 1 ELSE 0 END)), lambda i: i * 16), ',') AS starts,
  array_to_string([CAST(a[1] AS DOUBLE) / 2, CAST(a[2] AS DOUBLE) / 2, 0.5], ',') AS mono
FROM p""")
def array_tools(spark, root) -> DataFrame:
    a = F.concat(small(7, 11, 13), F.array(F.lit(1), F.lit(2)))
    slices = F.array_join(F.transform(packing.balanced_slices(a, 2), joined), "/")
    channels = F.array(F.array(F.pmod("doc_id", F.lit(7)), F.lit(0), F.lit(1)), F.array(F.lit(0), F.pmod("doc_id", F.lit(11)))).cast("array<array<float>>")
    return docs(spark, root, "doc_id").select(
        "doc_id", joined(arrays.mask_labels(a, F.array(F.lit(1), F.lit(2)))).alias("masked"), joined(arrays.shifted(a)).alias("shifted"), joined(arrays.crop(a, 1, 2)).alias("cropped"),
        joined(arrays.flattened(F.array(a, a))).alias("flat"), slices.alias("slices"), joined(arrays.tiled(a, F.lit(7))).alias("tiled"),
        joined(arrays.partial_windows(F.col("doc_id") % 400, 160, 16)).alias("starts"), joined(arrays.fitted(arrays.mono(channels), F.lit(3))).alias("mono"),
    )


@answers("""
SELECT event_id, CASE WHEN value / 100 > 0.5 THEN 'fluent' ELSE concat_ws(',', CASE WHEN value / 50 > 0.7 THEN 'block' END, CASE WHEN 0.8 > 0.7 THEN 'repeat' END) END AS fluency,
  lpad(CAST(event_id % 150 AS VARCHAR), CAST(greatest(2, length(CAST(event_id % 150 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(event_id % 150 + 3 AS VARCHAR), CAST(greatest(2, length(CAST(event_id % 150 + 3 AS VARCHAR))) AS INT), '0') || ':' || event_type AS label
FROM events""")
def fluency_labels(spark, root) -> DataFrame:
    p = F.array(F.col("value") / 50, F.lit(0.8))
    start = F.col("event_id") % 150
    return table(spark, root, "events").select("event_id", F.array_join(arrays.fluency(F.col("value") / 100, p, ("block", "repeat")), ",").alias("fluency"), arrays.fluency_label(F.array(F.array(start, start + 3)), F.array("event_type")).alias("label"))


# --- files, archives, datasets ------------------------------------------------------------------------------------------------------------


ENOUGH = rf"length(trim(text)) >= 40 AND len({UNICODE_WORDS}) >= 5"


@answers(rf"""
SELECT doc_id FROM documents WHERE {ENOUGH} AND CAST(substr(source, 4) AS INT) % 3 = 0""")
def eligible_rows(spark, root) -> DataFrame:
    """Folders have audio archives where their number is even or a multiple of 3, and token archives where it is odd or one of 3."""
    d = docs(spark, root, "doc_id", "source", "text")
    number = F.substring(F.col("source"), F.lit(4), F.lit(9)).cast("int")
    sources = d.select("source").distinct()
    audio = sources.where((number % 2 == 0) | (number % 3 == 0)).select(F.concat("source", F.lit("-0-1.zip")).alias("file"))
    tokens = sources.where((number % 2 == 1) | (number % 3 == 0)).select(F.concat("source", F.lit("_neucodec.zip")).alias("file"))
    index = joins.archive_index(audio.union(tokens), "file")
    return joins.eligible(d.withColumn("path", F.concat("source", F.lit("/x.mp3"))), index, "path", "text").select("doc_id")


@answers(rf"""
WITH t AS (SELECT lang, text, CASE WHEN doc_id % 10 > 0 THEN n_chars // 4 END AS n, CASE WHEN doc_id % 7 > 0 THEN n_chars / 200.0 + (doc_id % 4) / 2.0 END AS s, doc_id % 9 AS b FROM documents)
SELECT lang, CASE WHEN n IS NULL THEN 'no_member' WHEN b = 0 THEN 'empty_audio' WHEN n NOT BETWEEN 50 AND 1500 THEN 'token_length' WHEN len({UNICODE_WORDS}) > n THEN 'wordy' WHEN s IS NULL THEN 'unreadable'
  WHEN abs(s - n / 50.0) > greatest(0.4, 0.2 * s) THEN 'length_mismatch' ELSE 'kept' END AS reason, count(*) AS rows FROM t GROUP BY ALL""")
def test_set_funnel(spark, root) -> DataFrame:
    ident = F.col("doc_id")
    tokens = F.when(ident % 10 > 0, F.floor(F.col("n_chars") / 4))
    seconds = F.when(ident % 7 > 0, F.col("n_chars") / 200.0 + (ident % 4) / 2.0)
    steps = filters.token_funnel(tokens, F.col("text"), seconds, audio_bytes=ident % 9)
    return filters.funnel_counts(filters.funnel(docs(spark, root), *steps), ["lang"]).withColumnRenamed("n", "rows")


@answers("""
SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 AND c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey % 5 <> 0""")
def finished_packs(spark, root) -> DataFrame:
    name = lambda c: F.concat(F.col(c).cast("string"), F.when(F.col(c) % 5 == 0, "-dev").otherwise("")).alias("name")
    c = table(spark, root, "customer").select("c_custkey", name("c_custkey"))
    return mixture.finished(c, c.where("c_custkey % 2 = 0"), table(spark, root, "orders").select(name("o_custkey")), "name").select("c_custkey")


@answers("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def files_to_delete(spark, root) -> DataFrame:
    return mixture.not_kept(table(spark, root, "customer").select("c_custkey"), table(spark, root, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@answers("""
SELECT (SELECT count(*) FROM documents) AS files, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS bytes, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS missing,
  (SELECT count(*) FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 3 = 0) AS wrong""")
def copy_check(spark, root) -> DataFrame:
    d = docs(spark, root, "doc_id", "n_chars")
    return writers.verified_copy(d, d.where("doc_id % 5 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))), "doc_id", "n_chars")


@answers("""
SELECT DISTINCT source, '- config_name: ' || source || chr(10) || '  data_files:' || chr(10) || '  - split: train' || chr(10) || '    path: ' || source || '/*.parquet' AS yaml FROM documents""")
def card_entries(spark, root) -> DataFrame:
    return writers.card_config(docs(spark, root, "source"), "source")


@answers("""
SELECT source, count(*) AS rows FROM documents WHERE source GLOB 'src1[0-4]' OR source GLOB 's?c7' GROUP BY source""")
def matched_counts(spark, root) -> DataFrame:
    return readers.row_counts(readers.matching(docs(spark, root, "source"), "source", ["src1[0-4]", "s?c7"]), "source")


@answers("""
SELECT o_orderkey, o_orderstatus AS status, coalesce(CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END, o_orderstatus) AS title, CAST(NULL AS VARCHAR) AS gone FROM orders""")
def fallback_columns(spark, root) -> DataFrame:
    o = table(spark, root, "orders").withColumn("p", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")))
    return readers.with_fallbacks(o, {"status": ["state", "o_orderstatus"], "title": ["p", "o_orderstatus"], "gone": ["nothing"]}, ("o_orderkey",)).select("o_orderkey", "status", "title", "gone")


@answers("""
SELECT doc_id, toxic FROM documents JOIN labels USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def wanted_not_done(spark, root) -> DataFrame:
    d, labels = docs(spark, root, "doc_id", "lang"), table(spark, root, "labels")
    left = joins.not_done(joins.wanted(d, labels.where("quality = 1").select("doc_id"), ["doc_id"]), d.where("lang = 'en'").select("doc_id"), ["doc_id"])
    return joins.inner_lookup(left, labels.select("doc_id", "toxic"), ["doc_id"]).select("doc_id", "toxic")


@answers("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN 'matrix' ELSE 'rest' END AS kind FROM documents""")
def parameter_groups(spark, root) -> DataFrame:
    name = F.when(F.col("doc_id") % 3 == 0, "model.Embed_tokens").otherwise("layers.0.attn.q")
    return docs(spark, root, "doc_id").select("doc_id", registry.parameter_group(name, F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1)).alias("kind"))


# --- scores and events -------------------------------------------------------------------------------------------------------------------------


@answers("""
WITH f AS (SELECT *, CASE event_type WHEN 'click' THEN ['cough', 'sigh'] WHEN 'view' THEN ['sigh'] ELSE ['laughter'] END AS families, value >= 50 AS placed FROM events), e AS (SELECT unnest(families) AS family, placed FROM f)
SELECT family, count(*) FILTER (placed) AS placed, count(*) FILTER (NOT placed) AS overlapped FROM e GROUP BY family""")
def tag_statistics(spark, root) -> DataFrame:
    lists = lambda *names: F.array(*map(F.lit, names))
    e = table(spark, root, "events").withColumn("families", F.when(F.col("event_type") == "click", lists("cough", "sigh")).when(F.col("event_type") == "view", lists("sigh")).otherwise(lists("laughter")))
    return aggregates.tag_stats(e.withColumn("ok", F.col("value") >= 50), "families", "ok")


@answers("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events), g AS (SELECT event_type FROM r WHERE r <= 5 GROUP BY event_type HAVING avg(value) < 45)
SELECT event_id, event_type FROM events WHERE event_type IN (SELECT event_type FROM g)""")
def supported_types(spark, root) -> DataFrame:
    e = table(spark, root, "events").select("event_id", "event_type", "value")
    return filters.supported(e.drop("value"), e, "event_type", "event_id", "value", 5, 45.0).select("event_id", "event_type")


@answers("""
SELECT round(avg(levenshtein(lower(p_name), lower(p_brand)) / length(p_name)), 6) AS cer FROM part""")
def untagged_cer(spark, root) -> DataFrame:
    p = table(spark, root, "part").select(F.concat(F.lit("<|sfx:cough|>"), "p_name").alias("r"), F.concat(F.col("p_brand"), F.lit("  <|sfx:sigh|> ")).alias("h"))
    return evaluation.untagged_error(p, "r", "h").select(F.round("cer", 6).alias("cer"))


@answers("""
SELECT p_partkey, round(least(1, levenshtein(p_name, p_type) / length(p_name)), 6) AS cer FROM part""")
def part_error_rates(spark, root) -> DataFrame:
    return evaluation.error_rates(table(spark, root, "part"), "p_name", "p_type").select("p_partkey", F.round("cer", 6).alias("cer"))


_SESSION = ORACLE_SQL["event_sessions"].strip()


def _family(name: str, score: str, enter: float, peak: float, least: int) -> str:
    """The SQL of one family's sessions, of frames with another score, other thresholds and the usual gap."""
    sql = _SESSION.replace("(SELECT *, CAST(row_number()", f"(SELECT * REPLACE ({score} AS value), CAST(row_number()")
    return f"SELECT '{name}' AS family, * FROM ({sql})".replace(">= 60", f">= {peak}").replace(">= 40", f">= {enter}").replace(">= 3 ", f">= {least} ").replace("< 2 THEN", "< 0.3 THEN")


@answers(_family("quiet", "greatest(value, 30)", 40, 60, 3) + " UNION ALL " + _family("loud", "100 - value", 50, 80, 2))
def family_sessions(spark, root) -> DataFrame:
    f = numbered_events(spark, root).withColumns({"low": F.lit(30.0), "inverse": 100 - F.col("value")})
    tracks = sessions.family_track(f, {"quiet": ["value", "low"], "loud": ["inverse"]})
    out = sessions.all_families(tracks, ["user_id"], "frame", fps=1.0, families={"quiet": (40.0, 60.0, 3.0), "loud": (50.0, 80.0, 2.0)})
    return out.select("family", "user_id", F.col("onset").cast("long").alias("onset"), F.col("offset").cast("long").alias("offset"), F.round("peak", 6).alias("peak"))
