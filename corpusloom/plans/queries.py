"""Queries by name: each takes (spark, folder of the tables) and applies operators to whole tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom import session, streaming
from corpusloom.functions import arrays, normalizer
from corpusloom.functions import text as texts
from corpusloom.operators import aggregates, cluster, evaluation, filters, joins, mixture, packing, selection, sessions
from corpusloom.sources.readers import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, root: str) -> DataFrame:
        session.reachable(spark)
        return f(spark, root)

    QUERIES[f.__name__] = run
    return run


#: Words as both engines count them: what ASCII white space parts.
ASCII_WORD = r"[^ \t\n\x0B\f\r]+"


def words(c: str = "text"):
    return F.coalesce(F.regexp_count(F.col(c), F.lit(ASCII_WORD)), F.lit(0)).cast("long")


def folded(c: str = "text"):
    """Lower case, ASCII white space folded."""
    return F.trim(F.regexp_replace(F.lower(F.col(c)), r"[ \t\n\x0B\f\r]+", " "))


def docs(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    df = table(spark, root, "documents")
    df = df.select(*columns) if columns else df
    return session.spread(df) if "text" in df.columns else df


def numbered_events(spark: SparkSession, root: str) -> DataFrame:
    """Events as frames: each user's, numbered in order of time."""
    e = table(spark, root, "events")
    return e.select("user_id", "event_id", "event_type", "value", "ts", (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("frame"))


# --- histograms, shares, ranks ---------------------------------------------------------------------------------------------------------------------


@query
def attested_sources(spark, root):
    counts = aggregates.histogram(docs(spark, root, "source", "lang"), ["source", "lang"])
    good = selection.attested(counts, "source", "lang", "n", least=5, share=0.15)
    ranked = good.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "source")))
    return ranked.select("lang", "source", "n", F.round("share", 6).alias("share"), "rank")


@query
def lang_histogram_by_source(spark, root):
    fine = aggregates.histogram(docs(spark, root, "source", "lang", "n_chars").withColumn("bucket", F.floor(F.col("n_chars") / 1000)), ["source", "bucket", "lang"])
    return aggregates.regrouped(fine, ["source", "lang"])


@query
def lang_totals(spark, root):
    counts = aggregates.shares(aggregates.histogram(docs(spark, root, "lang", "source"), ["source", "lang"]), "lang")
    return counts.groupBy("lang").agg(F.sum("n").cast("long").alias("n"), F.round(F.max("share"), 6).alias("top_share"), F.count("*").alias("sources"))


# --- funnels and predicates -------------------------------------------------------------------------------------------------------------------------


@query
def doc_funnel_reasons(spark, root):
    d = docs(spark, root, "doc_id", "text", "lang", "source", "n_chars").join(table(spark, root, "labels"), "doc_id", "left")
    steps = (("toxic", F.col("toxic") == 1), ("empty_text", F.trim("text") == ""), ("short", F.col("n_chars") < 40), ("few_words", words() < 5), ("long", words() > 1500), ("low_quality", F.col("quality") == 0))
    return filters.funnel_counts(filters.funnel(d, *steps), ["lang"])


@query
def doc_funnel_summary(spark, root):
    d = docs(spark, root, "text", "source", "n_chars")
    steps = (("short", F.col("n_chars") < 200), ("wordy", words() > F.ceil(F.col("n_chars") / 4)))
    return filters.funnel_summary(filters.funnel(d, *steps), ["short", "wordy"], ["source"])


@query
def reject_anti_join(spark, root):
    rejected = table(spark, root, "labels").where("quality = 0 OR toxic = 1").select("doc_id")
    return joins.excluding(docs(spark, root, "doc_id", "source", "n_chars"), rejected, "doc_id")


@query
def enough_text_by_lang(spark, root):
    return docs(spark, root, "lang", "text").groupBy("lang").agg(F.count_if(filters.enough_text(F.col("text"))).alias("enough"), F.count("*").alias("n"))


@query
def ngram_repetition(spark, root):
    w = F.regexp_extract_all("text", F.lit(ASCII_WORD), F.lit(0))
    return docs(spark, root, "doc_id", "text").select("doc_id", F.coalesce(texts.most_repeated(texts.ngrams(w, 5)), F.lit(0)).alias("most_repeated"))


@query
def accept_text(spark, root):
    ok = filters.acceptable_text(F.col("text"))
    return docs(spark, root, "doc_id", "text").select("doc_id", ok.alias("accepted"), filters.length_between(F.col("text"), 600, 1300).alias("fits"), filters.newlines_between(F.col("text"), 5, 15).alias("lines_fit"))


@query
def publish_invariants(spark, root):
    return filters.publish_invariants(docs(spark, root, "doc_id", "text"), "doc_id", "text")


# --- lookups, semi and anti joins, sets --------------------------------------------------------------------------------------------------------------


@query
def benchmark_semi_overlap(spark, root):
    keys = table(spark, root, "benchmark").select(F.explode(F.split("text", r"\n")).alias("t")).select(folded("t").alias("line")).where("line <> ''").distinct()
    lines = docs(spark, root, "doc_id", "text").select("doc_id", F.explode(F.split("text", r"\n")).alias("t")).select("doc_id", folded("t").alias("line"))
    return joins.wanted(lines, keys, ["line"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def lookup_left_default(spark, root):
    d = docs(spark, root, "doc_id", "lang", "source")
    out = joins.left_lookup(d, table(spark, root, "labels"), "doc_id", "quality", "toxic", default=-1)
    return out.select("doc_id", F.col("quality").cast("int").alias("quality"), texts.first_value(F.col("source"), F.col("lang")).alias("voice"))


@query
def lookup_missing_counts(spark, root):
    out = joins.counted_lookup(docs(spark, root, "doc_id", "source"), table(spark, root, "labels"), "doc_id", "quality")
    return out.groupBy("source").agg(F.count_if("missing").alias("missing"), F.count("*").alias("n"))


@query
def set_difference(spark, root):
    return mixture.missing_from(docs(spark, root, "doc_id"), table(spark, root, "labels").select("doc_id"))


@query
def set_intersection(spark, root):
    return docs(spark, root, "doc_id").intersect(table(spark, root, "labels").where("quality = 1").select("doc_id"))


@query
def union_all_tables(spark, root):
    parts = [table(spark, root, t).select(F.lit(t).alias("origin"), F.length("text").cast("long").alias("size")) for t in ("documents", "benchmark", "conversations")]
    return mixture.all_of(*parts).groupBy("origin").agg(F.count("*").alias("n"), F.sum("size").alias("size"))


@query
def hard_negatives(spark, root):
    e = table(spark, root, "events")
    mined = e.where("value >= 40").select("event_id", "user_id", "event_type")
    verified = e.where("value >= 60").select("event_id")
    return joins.hard_negatives(mined, verified, ["event_id"])


# --- strings -------------------------------------------------------------------------------------------------------------------------------------------


@query
def clean_markers(spark, root):
    clean = texts.clean_markers(F.col("html"))
    return table(spark, root, "pages").select("page_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("md5"), texts.has_letter(clean).alias("scoreable"))


@query
def script_flags(spark, root):
    c = F.col("text")
    return docs(spark, root, "doc_id", "text").select("doc_id", texts.has_han(c).alias("han"), texts.has_cyrillic(c).alias("cyrillic"), texts.has_arabic(c).alias("arabic"), texts.has_indic(c).alias("indic"), texts.character_type(c).alias("kind"))


@query
def normalize_text(spark, root):
    return docs(spark, root, "doc_id", "text").select("doc_id", normalizer.normalized(F.col("text")).alias("normalized"))


@query
def tidy_text(spark, root):
    c = texts.collapse_marks(texts.tidy_space(F.col("text")))
    return table(spark, root, "conversations").select("conv_id", "turn", F.md5(c).alias("md5"), F.length(c).cast("long").alias("n_chars"))


@query
def url_parse(spark, root):
    p = texts.url_parts(F.col("url"))
    return table(spark, root, "pages").select("page_id", *[p[k].alias(k) for k in ("scheme", "host", "path", "query", "fragment", "section")])


@query
def path_columns(spark, root):
    p = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".v1.mp3")))
    d = docs(spark, root, "doc_id", "source", "lang").withColumn("p", p)
    c = F.col("p")
    return d.select("doc_id", texts.token_path(c).alias("token_path"), texts.folder(c).alias("folder"), texts.rebase(c, "audio").alias("audio"), texts.path_language(c).alias("language"), texts.file_key(c).alias("file_key"), texts.basename(c).alias("name"))


@query
def json_props(spark, root):
    e = table(spark, root, "events").select("event_type", F.from_json("props", "k INT").alias("p"))
    return e.groupBy("event_type").agg(F.count("p.k").alias("n"), F.sum("p.k").cast("long").alias("total"), F.min("p.k").alias("least"), F.max("p.k").alias("most"))


@query
def cer_adjacent_turns(spark, root):
    pairs = table(spark, root, "conversations").withColumn("hyp", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("hyp IS NOT NULL")
    return pairs.select("conv_id", "turn", F.round(texts.error_rate(F.col("text"), F.col("hyp"), clip=True), 6).alias("cer"))


@query
def tag_f1(spark, root):
    c = table(spark, root, "conversations").where("role = 'user'")
    tag = lambda k: F.concat(F.lit("<|sfx:"), F.when(F.length("text") % k == 0, "cough").when(F.length("text") % k == 1, "sigh").otherwise("laughter"), F.lit("|> "))
    rows = c.select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.concat(tag(3), F.col("text")).alias("ref"), F.concat(tag(4), F.col("text")).alias("hyp"))
    return evaluation.tag_scores(rows, "id", "ref", "hyp").select("tag", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"), F.col("fn").cast("long").alias("fn"), "precision", "recall", "f1")


# --- documents, packing, mixtures ---------------------------------------------------------------------------------------------------------------------


@query
def chat_render(spark, root):
    out = packing.chat(table(spark, root, "conversations"))
    return out.select("conv_id", "n_turns", F.md5("document").alias("md5"), F.length("document").cast("long").alias("n_chars"))


@query
def speak_documents(spark, root):
    d = docs(spark, root, "doc_id", "source", "text", "n_chars")
    tokens = F.transform(F.sequence(F.lit(0), F.least(F.lit(7), (F.col("n_chars") % 8)).cast("int")), lambda i: (i * 31 + F.col("doc_id")) % 65536)
    return d.select("doc_id", F.md5(packing.speak_document(F.col("source"), F.col("text"), tokens)).alias("md5"))


def _packed(spark, root):
    d = docs(spark, root, "doc_id", "source", "text").select("doc_id", "source", F.floor(F.col("doc_id") / 10_000).alias("shard"), words().alias("n"))
    return packing.greedy_blocks(d, ["source", "shard"], "doc_id", "n", 2048)


@query
def pack_documents(spark, root):
    return _packed(spark, root).select("source", "doc_id", "n", "block", "offset")


@query
def block_layout(spark, root):
    out = packing.block_layout(_packed(spark, root), ["source", "shard"], "doc_id", "n", block=2048)
    last = F.element_at("cu_seq_lens", -1)
    return out.select("source", "shard", "block", F.size("lengths").cast("long").alias("n_docs"), "n_tokens", "max_length", last.alias("end"), F.size("position_ids").cast("long").alias("n_positions"), "oversized")


@query
def mixture_index(spark, root):
    return mixture.strided(docs(spark, root, "doc_id", "source"), ["source"], "doc_id", 0.3).select("source", "doc_id", "copy")


@query
def mixture_repeats(spark, root):
    return mixture.strided(table(spark, root, "benchmark").select("item_id").withColumn("arm", F.lit("benchmark")), ["arm"], "item_id", 2.6).select("item_id", "copy")


@query
def mixture_totals(spark, root):
    packs = docs(spark, root, "source", "lang", "n_chars").groupBy("lang", "source").agg(F.count("*").alias("blocks"))
    weighted = packs.withColumn("weight", F.when(F.col("lang") == "en", 1.0).otherwise(2.5))
    out = mixture.mixture_totals(weighted, "lang", "blocks", "weight", step_blocks=64)
    return out.select("lang", "packs", F.col("blocks").cast("long").alias("blocks"), "tokens", F.round("weighted", 6).alias("weighted"), F.round("share", 6).alias("share"), "steps", "decay")


@query
def vocab_append(spark, root):
    d = docs(spark, root, "lang", "source")
    old = d.where("lang = 'en'").select(F.col("source").alias("token")).distinct()
    old = old.withColumn("pos", (F.row_number().over(W.orderBy(F.desc("token"))) - 1).cast("long"))
    new = mixture.union_values("token", d.select(F.col("lang").alias("token")), d.select(F.col("source").alias("token")))
    return mixture.append_vocabulary(old, new)


@query
def tag_vocabulary(spark, root):
    e = table(spark, root, "events").select(F.concat(F.lit("<|"), "event_type", F.lit("|>")).alias("token"))
    d = docs(spark, root, "lang").select(F.concat(F.lit("<|"), "lang", F.lit("|>")).alias("token"))
    return mixture.union_values("token", e, d).withColumn("pos", (F.row_number().over(W.orderBy("token")) - 1).cast("long"))


# --- ranking and sampling -----------------------------------------------------------------------------------------------------------------------------


@query
def topk_dedup_speaker_cap(spark, root):
    d = docs(spark, root, "doc_id", "lang", "source", "text", "n_chars")
    out = selection.pick_with_caps(d, "lang", "source", "text", ["-n_chars", "doc_id"])
    return out.select("lang", "source", "doc_id", "rank", F.coalesce(F.col("cap"), F.lit(-1)).alias("cap"))


@query
def stratified_sample(spark, root):
    return selection.hash_sample(docs(spark, root, "doc_id", "source"), ["source"], "doc_id", 10, "7").select("source", "doc_id", "rank")


@query
def budget_round_robin(spark, root):
    d = docs(spark, root, "doc_id", "source", "n_chars")
    out = selection.budget_round_robin(d, "source", "doc_id", "n_chars", 1_000_000)
    return out.select("source", "doc_id", F.col("depth").cast("long").alias("depth"), "taken")


@query
def snake_assignment(spark, root):
    c = table(spark, root, "customer")
    return selection.snake(c.select("c_custkey", "c_nationkey"), "c_nationkey", "c_custkey", 7).select("c_custkey", "worker")


@query
def chunk_assignment(spark, root):
    out = selection.near_equal_chunks(table(spark, root, "supplier").select("s_suppkey"), "s_suppkey", 7)
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first"))


@query
def wave_assignment(spark, root):
    return selection.waves(table(spark, root, "nation").select("n_name"), "n_name", 4)


@query
def cap_per_file(spark, root):
    d = docs(spark, root, "doc_id", "source", "lang")
    return selection.cap_per_file(d, "source", "lang", "doc_id", 3).select("source", "lang", "doc_id")


# --- scores ---------------------------------------------------------------------------------------------------------------------------------------------


@query
def bin_labels(spark, root):
    e = table(spark, root, "events").select("event_id", "value")
    return aggregates.binned(e, "value", arrays.LABELS["noise"]).select("event_id", "label")


@query
def bin_labels_by_group(spark, root):
    e = table(spark, root, "events").select("event_id", "event_type", "value")
    return aggregates.binned(e, "value", arrays.LABELS["pitch"], ["event_type"]).select("event_id", "event_type", "label")


@query
def calibrated_scores(spark, root):
    e = table(spark, root, "events").withColumn("v", F.col("value") / 100)
    out = aggregates.window_means(e, ["user_id"], {"OVRL": "v", "SIG": "v", "BAK": "v"})
    return out.select("user_id", "num_hops", *(F.round(c, 6).alias(c.lower()) for c in ("OVRL_raw", "OVRL", "SIG", "BAK")))


@query
def nested_mean_scores(spark, root):
    fine, users, overall = evaluation.nested_means(table(spark, root, "events"), "value", ["event_type", "user_id"])
    del fine
    types = users.select("event_type", F.round("score", 6).alias("score"))
    return types.unionByName(overall.select(F.lit("all").alias("event_type"), F.round("score", 6).alias("score")))


@query
def audit_summary(spark, root):
    d = docs(spark, root, "doc_id", "text", "lang", "source", "n_chars").withColumn("prob", (F.col("n_chars") % 100) / 100).withColumn("margin", (F.col("n_chars") % 7) / 10)
    d = d.withColumn("macro", F.when(F.col("lang").isin("fr", "es"), "romance").otherwise(F.col("lang")))
    out = aggregates.label_audit(d, "source", "lang", "macro", "prob", "margin", "doc_id", "text")
    return out.select("source", "n", F.round("mean_prob", 6).alias("mean_prob"), "confident", "unsure", "close", "dominant", F.round("dominant_share", 6).alias("dominant_share"), "dominant_macro", F.round("macro_share", 6).alias("macro_share"), "top_labels", F.md5(F.array_join("examples", "|")).alias("examples_md5"))


@query
def group_advantage(spark, root):
    return evaluation.group_advantage(table(spark, root, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


@query
def threshold_sweep(spark, root):
    e = table(spark, root, "events").select("value", (F.col("event_type") == "click").alias("hit"))
    return aggregates.threshold_sweep(e, "value", "hit", (10, 50, 100, 200, 400)).select("threshold", F.round("recall", 6).alias("recall"), F.round("false_positive_rate", 6).alias("false_positive_rate"))


@query
def value_percentiles(spark, root):
    return aggregates.percentiles(table(spark, root, "events"), "value").select("percentile", F.round("value", 6).alias("value"))


@query
def leaderboard(spark, root):
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))
    o = aggregates.in_order(table(spark, root, "orders"), ["o_custkey"], ["o_orderkey", "o_totalprice"], train=F.sum("o_totalprice"), status=F.min("o_orderstatus"), dev=F.avg(urgent))
    out = evaluation.leaderboard(o, "o_custkey", "status", "dev", "train", ok="F")
    return out.select("o_custkey", F.round("metric", 2).alias("metric"), "place")


@query
def pivot_best(spark, root):
    c = table(spark, root, "customer").join(table(spark, root, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    means = c.groupBy("n_name", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("score"))
    return evaluation.best_of_columns(means, "c_mktsegment", "score", "n_name").select("n_name", "c_mktsegment", "score", "best", F.round("scaled", 6).alias("scaled"))


@query
def dataset_card(spark, root):
    out = aggregates.card_table(docs(spark, root, "lang", "source", "n_chars"), "lang", "source", F.col("n_chars").cast("double"))
    return out.select("lang", "rows", F.round("minutes", 6).alias("minutes"), F.array_join("subsets", ",").alias("subsets"))


@query
def speaker_sizes(spark, root):
    out = aggregates.group_sizes(docs(spark, root, "lang", "source"), "lang", "source")
    return out.select("lang", "members", F.array_join(F.transform("sizes", lambda k: k.cast("string")), ",").alias("sizes"), "least", "median", "most", "upper_middle")


# --- vectors --------------------------------------------------------------------------------------------------------------------------------------------


@query
def speaker_pairs(spark, root):
    return joins.similar_pairs(table(spark, root, "embeddings"), ["label"], "vec_id", "embedding", 0.3).select("label", "a", "b", F.round("similarity", 6).alias("similarity"))


@query
def centroid_assign(spark, root):
    e = table(spark, root, "embeddings")
    centers = aggregates.mean_vectors(e, ["label"], "embedding").select(F.col("label").alias("centroid"), "center")
    return joins.nearest(e, centers, "vec_id", "embedding", "centroid", "center").select("vec_id", "centroid", F.round("similarity", 6).alias("similarity"))


@query
def cluster_constrained(spark, root):
    e = table(spark, root, "embeddings").withColumn("place", F.col("label") % 2)
    return cluster.constrained(e, "place", "label", "vec_id", "embedding")


@query
def silhouette(spark, root):
    e = table(spark, root, "embeddings").withColumn("place", F.col("label") % 2)
    return cluster.silhouette(e, ["place"], "vec_id", "label", "embedding").select("place", F.round("silhouette", 6).alias("silhouette"))


# --- events ----------------------------------------------------------------------------------------------------------------------------------------------


@query
def event_sessions(spark, root):
    f = numbered_events(spark, root)
    out = sessions.sessions(f, ["user_id"], "frame", "value", enter=40.0, peak=60.0, least=3.0, gap=2.0, fps=1.0, smooth=True)
    return out.select("user_id", F.col("onset").cast("long").alias("onset"), F.col("offset").cast("long").alias("offset"), F.round("peak", 6).alias("peak"))


@query
def interval_overlap(spark, root):
    e = numbered_events(spark, root).withColumn("t", F.col("frame").cast("double"))
    spans = e.where("event_type = 'click'").select("user_id", "event_id", F.col("t").alias("onset"), (F.col("t") + F.col("value") / 100).alias("offset"))
    others = e.where("event_type <> 'click'").select("user_id", (F.col("t") + 0.25).alias("start"), (F.col("t") + 0.75).alias("end"))
    out = joins.interval_overlap(spans, others, "user_id", "event_id", "onset", "offset", "start", "end", width=16.0)
    return out.select("user_id", "event_id", F.round("overlap", 6).alias("overlap"))


@query
def asof_forward(spark, root):
    e = numbered_events(spark, root)
    left = e.where("event_type = 'click'").select("user_id", "event_id", "frame")
    right = e.where("event_type = 'purchase'").select("user_id", F.col("frame").alias("at"), F.col("event_id").alias("purchase"))
    return joins.next_at_or_after(left, right, ["user_id"], "frame", "at", "purchase").select("user_id", "event_id", "purchase")


@query
def cyclic_pairing(spark, root):
    d = docs(spark, root, "doc_id", "source", "lang")
    return joins.cyclic_partner(d, ["source"], [F.col("doc_id")], "lang").select("source", "doc_id", "partner")


@query
def retries_missing(spark, root):
    grid = joins.with_retries(docs(spark, root, "doc_id", "lang"), 3)
    done = docs(spark, root, "doc_id", "n_chars").select("doc_id", (F.col("n_chars") % 3).cast("int").alias("retry"))
    return joins.not_done(grid, done, ["doc_id", "retry"]).groupBy("lang", "retry").agg(F.count("*").alias("n"))


@query
def stream_tumbling(spark, root):
    return streaming.tumbling(table(spark, root, "events"), ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query
def stream_sliding(spark, root):
    return streaming.sliding(table(spark, root, "events"), ["event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query
def stream_session(spark, root):
    out = streaming.by_session(table(spark, root, "events"), ["user_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


# --- more of the operators -------------------------------------------------------------------------------------------------------------------------------


@query
def frame_layout(spark, root):
    d = docs(spark, root, "doc_id", "source", "n_chars").withColumn("samples", F.col("n_chars") % 2000)
    out = packing.frame_layout(d, ["source"], "doc_id", "samples")
    return out.groupBy("source").agg(F.count("*").alias("frames"), F.max("segment_id").cast("long").alias("segments"), F.max("frame_index").alias("longest"))


@query
def generated_tokens(spark, root):
    said = F.concat(F.lit("<|speech_start|><|s_9|>"), F.lit("<|speech_start|>"), packing.speech(F.array(F.col("doc_id"), F.col("n_chars"))))
    return docs(spark, root, "doc_id", "n_chars").select("doc_id", F.array_join(F.transform(packing.generated_tokens(said), lambda t: t.cast("string")), ",").alias("tokens"))


@query
def codec_layers(spark, root):
    one = F.array(F.col("doc_id").cast("int") % 4096)
    two = F.array(*[(F.col("doc_id").cast("int") + i) % 4096 for i in range(2)])
    three = F.array(*[(F.col("doc_id").cast("int") * 3 + i) % 4096 for i in range(4)])
    d = docs(spark, root, "doc_id").withColumn("codes", arrays.interleaved(one, two, three))
    a, b, c = arrays.layers(F.col("codes"))
    show = lambda x: F.array_join(F.transform(x, lambda t: t.cast("string")), ",")
    return d.select("doc_id", show(F.col("codes")).alias("ids"), show(a).alias("one"), show(b).alias("two"), show(c).alias("three"))


@query
def window_counts(spark, root):
    d = docs(spark, root, "doc_id", "n_chars").withColumn("samples", F.col("n_chars") * 160)
    return d.select("doc_id", arrays.hops(F.col("samples")).alias("hops"), arrays.trimmed(F.col("samples")).alias("trimmed"), arrays.positions(F.col("samples")).alias("positions"), filters.duration_between(F.col("samples")).alias("fits"))


@query
def run_summaries(spark, root):
    e = numbered_events(spark, root).withColumn("dev", F.when(F.col("event_type") == "click", F.col("value")))
    out = evaluation.run_summaries(e, "user_id", "frame", "value", {"click": "dev"})
    return out.select("user_id", F.round("final_loss", 6).alias("final_loss"), F.round("last_mean_loss", 6).alias("last_mean_loss"), F.round("min_loss", 6).alias("min_loss"), "steps_logged", F.round("click_final", 6).alias("click_final"), F.round("click_min", 6).alias("click_min"), "click_points", F.round("dev_mean", 6).alias("dev_mean"), F.round("dev_min_mean", 6).alias("dev_min_mean"))


@query
def heat_map(spark, root):
    d = docs(spark, root, "source", "lang", "n_chars")
    out = evaluation.heat_map(d, "source", "lang", "n_chars", ["de", "en", "es", "fr"])
    return out.select("source", *(F.round(c, 4).alias(c) for c in ("de", "en", "es", "fr", "mean")))


@query
def rank_table(spark, root):
    n = table(spark, root, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("train"), F.lit("ok").alias("status"), F.lit(None).cast("double").alias("dev"))
    led = evaluation.leaderboard(n, "c_nationkey", "status", "dev", "train")
    return evaluation.markdown(led, "place", [F.col("c_nationkey")])


@query
def trusted_labels(spark, root):
    d = docs(spark, root, "doc_id", "lang", "n_chars").withColumn("prob", (F.col("n_chars") % 100) / 100).withColumn("margin", (F.col("n_chars") % 11) / 10)
    ok = filters.trusted_label(F.col("lang"), F.lit("en"), F.col("prob"), F.col("margin"))
    return d.groupBy("lang").agg(F.count_if(ok).alias("trusted"), F.count("*").alias("n"))


@query
def event_gate(spark, root):
    e = table(spark, root, "events")
    gated = filters.event_kept(F.col("value"), F.col("value") / 50, 30.0, 0.8)
    sure = filters.verified_event(F.col("value") / 100, F.col("value") / 50)
    return e.groupBy("event_type").agg(F.count_if(gated).alias("kept"), F.count_if(sure).alias("verified"), F.count("*").alias("n"))


@query
def tag_families(spark, root):
    c = table(spark, root, "conversations").where("role = 'user'")
    family = F.when(F.length("text") % 3 == 0, "burping").when(F.length("text") % 3 == 1, "sigh").otherwise("cough")
    tagged = c.select("conv_id", "turn", F.concat(F.substring("text", 1, 20), F.lit(" <|sfx:"), family, F.lit("|>"), F.substring(F.col("text"), F.lit(21), F.length("text"))).alias("t"))
    return filters.tag_filter(tagged, "t").select("conv_id", "turn", F.md5("t").alias("md5"), F.array_join("families", ",").alias("families"), "no_tag_left")


@query
def prompt_texts(spark, root):
    c = table(spark, root, "conversations")
    return c.select("conv_id", "turn", F.md5(texts.prompt_punctuation(F.col("text"))).alias("md5"))


@query
def mixed_words(spark, root):
    w = texts.mixed_words(F.col("text"))
    return docs(spark, root, "doc_id", "text").select("doc_id", F.size(w).cast("long").alias("n"), F.md5(F.array_join(w, " ")).alias("md5"))


@query
def speech_marks(spark, root):
    return docs(spark, root, "doc_id", "text").select("doc_id", F.md5(texts.strip_speech_marks(F.col("text"))).alias("md5"))


@query
def loose_marks(spark, root):
    out = texts.drop_empty_brackets(texts.drop_loose_marks(F.col("text")))
    return docs(spark, root, "doc_id", "text").select("doc_id", F.length(out).cast("long").alias("n_chars"), F.md5(out).alias("md5"))


@query
def complete_groups(spark, root):
    d = docs(spark, root, "doc_id", "source", "n_chars").withColumn("weight", F.sum("n_chars").over(W.partitionBy("source")))
    return selection.complete_groups(d, "source", [F.col("doc_id")], 5, 7, "weight").select("source", "doc_id")


@query
def renumbered_clusters(spark, root):
    return selection.renumbered(docs(spark, root, "doc_id", "lang", "source"), "lang", "source").select("doc_id", "lang", "spk")


@query
def row_index(spark, root):
    from corpusloom.sources.readers import indexed

    return indexed(docs(spark, root, "doc_id", "source"), "doc_id").select("doc_id", F.col("row").cast("long").alias("row"))


@query
def first_per_source(spark, root):
    from corpusloom.sources.readers import first_per_file

    return first_per_file(docs(spark, root, "doc_id", "source", "lang"), "source", "doc_id", "lang")


@query
def model_margins(spark, root):
    e = table(spark, root, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    names = F.transform("p", lambda _, i: F.concat(F.lit("m"), F.lpad(i.cast("string"), 2, "0")))
    best = evaluation.top_two(arrays.softmax(F.col("p")), names)
    capped = evaluation.ensemble(best["prob"], best["label"], F.lit("m00"))
    return e.select("vec_id", best["label"].alias("label"), F.round(best["margin"], 6).alias("margin"), F.round(capped, 6).alias("prob"))


@query
def short_texts_dropped(spark, root):
    p = table(spark, root, "conversations").withColumn("reply", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn")))
    return p.where(filters.at_least_chars(F.col("text"), F.col("reply"), least=200)).select("conv_id", "turn")


@query
def folder_census(spark, root):
    d = docs(spark, root, "doc_id", "lang", "source").withColumn("p", F.concat_ws("/", "source", "doc_id"))
    return aggregates.folder_census(d, "lang", "p")


@query
def perplexities(spark, root):
    e = table(spark, root, "events").groupBy("event_type").agg(F.avg(F.col("value") / 100).alias("loss"))
    return e.select("event_type", F.round(evaluation.perplexity(F.col("loss")), 6).alias("perplexity"))
