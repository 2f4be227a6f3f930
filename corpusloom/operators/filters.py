"""Row filters and funnels: each dropped row has the first reason that applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays, text

KEPT = "kept"


def reasons(*steps: tuple[str, Column]) -> Column:
    """The name of the first step whose condition holds, else "kept". A null condition doesn't hold."""
    out = F.lit(KEPT)
    for name, condition in reversed(steps):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def funnel(df: DataFrame, *steps: tuple[str, Column]) -> DataFrame:
    return df.withColumn("reason", reasons(*steps))


def funnel_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, reason, n)."""
    return df.groupBy(*(by or []), "reason").agg(F.count("*").alias("n"))


def funnel_summary(df: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (a group) with a counter of every reason, "kept" among them."""
    return df.groupBy(*(by or [])).agg(*[F.count_if(F.col("reason") == n).alias(n) for n in [KEPT, *names]])


# --- predicates -------------------------------------------------------------------------------------------------------------------------


def in_folder_like(path: Column, part: str) -> Column:
    """Whether the top folder has ``part`` in its name."""
    return F.contains(F.substring_index(path, "/", 1), F.lit(part))


def blank(c: Column) -> Column:
    return F.coalesce(text.strip(c), F.lit("")) == ""


def wordier_than(c: Column, tokens: Column) -> Column:
    """More words than tokens: the alignment can't be right."""
    return text.word_count(c) > F.coalesce(tokens, F.lit(0))


def known_language(language: Column, known: list[str] | None = None) -> Column:
    ok = language.isNotNull() & ~language.isin("", "und")
    return ok & language.isin(*known) if known is not None else ok


def in_split(path: Column, splits: list[str]) -> Column:
    return text.path_split(path).isin(*splits)


def duration_between(samples: Column, least: float = 0.3, most: float = 30.0, rate: int = arrays.RATE) -> Column:
    return samples.between(int(least * rate), int(most * rate))


def trusted_label(label: Column, expected: Column, prob: Column, margin: Column, least_prob: float = 0.90, least_margin: float = 0.50) -> Column:
    return (label == expected) & (prob >= least_prob) & (margin >= least_margin)


def enough_text(c: Column, chars: int = 40, words: int = 5, dense_share: float = 0.5) -> Column:
    """``chars`` characters, and ``words`` words or half of it in scripts without spaces."""
    dense = F.regexp_count(c, F.lit(f"[{text.UNSPACED}]"))
    return F.coalesce((F.length(c) >= chars) & ((text.word_count(c) >= words) | (dense >= dense_share * F.length(c))), F.lit(False))


def length_between(c: Column, least: int, most: int) -> Column:
    return F.length(c).between(least, most)


def newlines_between(c: Column, least: int, most: int) -> Column:
    return F.regexp_count(c, F.lit("\n")).between(least, most)


def at_least_chars(*columns: Column, least: int = 5) -> Column:
    """Every text has ``least`` characters."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.length(c), F.lit(0)) >= least)
    return out


def good_quality(score: Column, least: float = 3.2) -> Column:
    return score >= least


def event_kept(peak: Column, seconds: Column, least_peak: float, least_seconds: float) -> Column:
    return (peak >= least_peak) & (seconds >= least_seconds)


def verified_event(prob: Column, seconds: Column, least_prob: float = 0.55, least_seconds: float = 0.1) -> Column:
    return (prob >= least_prob) & (seconds >= least_seconds)


#: Characters that give a machine's text away (fixed values).
ODD_CHARACTERS = r"\x{FFFD}\x{2018}\x{201A}\x{201E}\x{20AC}"


def acceptable_text(c: Column, least_words: int = 20, n: int = 5, most_repeats: int = 3, bold: bool = True) -> Column:
    """A generated description that may be used: no bold marks, enough words, no odd character, no run of ``n`` words more than
    ``most_repeats`` times, no Arabic, Cyrillic, Indic or Han script."""
    body = text.strip(c)
    w = text.words(body)
    odd = text.has_any(body, ODD_CHARACTERS + text.ARABIC + text.CYRILLIC + text.INDIC + text.HAN)
    ok = (F.size(w) >= least_words) & ~odd & (text.most_repeated(text.ngrams(w, n)) <= most_repeats)
    return F.coalesce(ok & ~F.contains(body, F.lit("**")) if bold else ok, F.lit(False))


def token_funnel(tokens: Column, body: Column, seconds: Column, least: int = 50, most: int = 1500, audio_bytes: Column | None = None) -> tuple[tuple[str, Column], ...]:
    """The steps of a test set: a member that wasn't found (null tokens), empty audio (if ``audio_bytes`` are given), number of tokens, words, unreadable
    audio, a length that the tokens deny."""
    told = tokens / 50.0
    empty = (("empty_audio", F.coalesce(audio_bytes, F.lit(0)) == 0),) if audio_bytes is not None else ()
    return (
        ("no_member", tokens.isNull()),
        *empty,
        ("token_length", ~tokens.between(least, most)),
        ("wordy", wordier_than(body, tokens)),
        ("unreadable", seconds.isNull()),
        ("length_mismatch", F.abs(seconds - told) > F.greatest(F.lit(0.4), 0.2 * seconds)),
    )


def tag_filter(df: DataFrame, body: str, drop: tuple[str, ...] = ("burping",)) -> DataFrame:
    """Dropped families' tags are cut out of the text, the words they stood before stay as plain speech; ``families`` has those left, ``no_tag_left`` marks rows without."""
    cut = F.col(body)
    for family in drop:
        cut = F.replace(cut, F.lit(f"<|sfx:{family}|>"), F.lit(""))
    out = df.withColumn(body, text.fold_space(cut))
    return out.withColumn("families", F.array_sort(F.array_distinct(text.tags(F.col(body))))).withColumn("no_tag_left", F.size("families") == 0)


def supported(df: DataFrame, scores: DataFrame, language: str, order: str, score: str, first: int = 5, below: float = 0.8) -> DataFrame:
    """Rows of the languages whose average score over their first rows is good enough."""
    from pyspark.sql import Window as W

    head = scores.withColumn("_n", F.row_number().over(W.partitionBy(language).orderBy(order))).where(F.col("_n") <= first)
    good = head.groupBy(language).agg(F.avg(score).alias("_avg")).where(F.col("_avg") < below).select(language)
    return df.join(good, language, "left_semi")


def publish_invariants(df: DataFrame, key: str, body: str, tokens: str | None = None, payload: str | None = None, most_token: int = 65_535) -> DataFrame:
    """One row of counts that must all be 0 but ``n``: empty texts, repeated keys, missing payloads, ids out of range."""
    checks = [F.count("*").alias("n"), F.count_if(blank(F.col(body))).alias("empty_text"), (F.count("*") - F.count_distinct(key)).alias("repeated_key")]
    if payload:
        checks.append(F.count_if(F.coalesce(F.length(payload), F.lit(0)) == 0).alias("missing_payload"))
    if tokens:
        checks.append(F.count_if(F.exists(tokens, lambda t: (t < 0) | (t > most_token))).alias("bad_token"))
    return df.agg(*checks)
