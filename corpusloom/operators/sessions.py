"""Events from framewise scores, and their tags in a transcript."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as texts

#: Per family: score from which it goes on, peak it must reach, least seconds (fixed values).
FAMILIES = {
    "burping": (0.25, 0.60, 0.10), "cough": (0.20, 0.50, 0.15), "crying": (0.20, 0.50, 0.40), "humming": (0.20, 0.50, 0.30), "laughter": (0.20, 0.50, 0.30),
    "screaming": (0.25, 0.60, 0.20), "sigh": (0.15, 0.40, 0.20), "sneeze": (0.20, 0.50, 0.10), "sniff": (0.20, 0.50, 0.10),
}
MERGE_SECONDS = 0.30


def family_track(df: DataFrame, members: dict[str, list[str]]) -> DataFrame:
    """Adds a column for each family: the greatest score of its member columns."""
    return df.withColumns({f: F.greatest(*[F.col(c) for c in cs]) if len(cs) > 1 else F.col(cs[0]) for f, cs in members.items()})


def median_five(frames: DataFrame, keys: list[str], frame: str, score: str, name: str = "smooth") -> DataFrame:
    """Adds the median of five frames around each; at the ends the track is mirrored, its last frame twice."""
    w = W.partitionBy(*keys).orderBy(frame)
    s = F.col(score)
    b1, b2, a1, a2 = F.lag(score, 1).over(w), F.lag(score, 2).over(w), F.lead(score, 1).over(w), F.lead(score, 2).over(w)
    # mirrored: before frame 0 come frames 0, 1; after the last, the last and the one before it
    one, two = F.coalesce(b1, s), F.coalesce(b2, F.when(b1.isNull(), F.coalesce(a1, s)).otherwise(b1))
    three, four = F.coalesce(a1, s), F.coalesce(a2, F.when(a1.isNull(), F.coalesce(b1, s)).otherwise(a1))
    return frames.withColumn(name, F.array_sort(F.array(two, one, s, three, four))[2])


def sessions(frames: DataFrame, keys: list[str], frame: str, score: str, enter: float, peak: float, least: float, gap: float = MERGE_SECONDS, fps: float = 100.0, smooth: bool = True) -> DataFrame:
    """(keys, session, onset, offset, peak): runs of frames that score ``enter`` or more, those less than ``gap`` seconds apart as one, kept from
    ``least`` seconds and ``peak`` on. A key whose raw scores never reach ``peak`` has none. Frames are numbered without holes.

    Two passes over one sort by key and frame: change flags number the runs, gaps between runs number the sessions.
    """
    whole = W.partitionBy(*keys)
    w = whole.orderBy(frame)
    rows = frames.withColumn("_raw", F.max(score).over(whole)).where(F.col("_raw") >= peak)
    rows = median_five(rows, keys, frame, score, "_s") if smooth else rows.withColumn("_s", F.col(score))
    on = F.col("_s") >= enter
    rows = rows.withColumn("_start", F.when(on & ~F.coalesce(F.lag(on).over(w), F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("_run", F.sum("_start").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).where(on)
    runs = rows.groupBy(*keys, "_run").agg(F.min(frame).alias("a"), (F.max(frame) + 1).alias("b"), F.max("_s").alias("p"))
    r = whole.orderBy("a")
    apart = F.coalesce((F.col("a") - F.lag("b").over(r)) / fps >= gap, F.lit(True))
    runs = runs.withColumn("session", F.sum(F.when(apart, 1).otherwise(0)).over(r.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = runs.groupBy(*keys, "session").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.max("p").alias("peak"))
    kept = out.where(((F.col("b") - F.col("a")) / fps >= least) & (F.col("peak") >= peak))
    return kept.select(*keys, "session", (F.col("a") / fps).alias("onset"), (F.col("b") / fps).alias("offset"), "peak")


def all_families(frames: DataFrame, keys: list[str], frame: str, scale: float = 1.0, fps: float = 100.0, families: dict[str, tuple[float, float, float]] | None = None) -> DataFrame:
    """``sessions`` of every family that has a column; ``scale`` multiplies both thresholds."""
    out = None
    for name, (enter, peak, least) in (families or FAMILIES).items():
        if name in frames.columns:
            found = sessions(frames.select(*keys, frame, name), keys, frame, name, enter * scale, peak * scale, least, fps=fps).withColumn("family", F.lit(name))
            out = found if out is None else out.unionByName(found)
    return out


# --- tags in a transcript --------------------------------------------------------------------------------------------------------------------


def overlap_share(onset: Column, offset: Column, words: Column) -> Column:
    """Part of an event that words (start, end, text) cover."""
    shared = F.aggregate(words, F.lit(0.0), lambda s, w: s + F.greatest(F.lit(0.0), F.least(w["end"], offset) - F.greatest(w["start"], onset)))
    return shared / F.greatest(F.lit(1e-6), offset - onset)


def place(onset: Column, words: Column) -> Column:
    """Index of the first word that starts at or after the onset; the number of words if none does."""
    n = F.size(words)
    index = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(index, lambda i: F.get(words, i)["start"] >= onset)), n)


def place_tags(df: DataFrame, words: str, events: str, language: str, most: float = 0.5) -> DataFrame:
    """Adds ``placed`` (events with overlap, whether placed, index), ``nv_text`` with every event's label, ``tagged_text`` with the placed
    events as tag and sound, and ``n_placed``. Events are ordered by onset; several at a word keep their order before it."""
    ordered = F.array_sort(F.transform(events, lambda e: F.struct(e["onset"].alias("onset"), e["offset"].alias("offset"), e["family"].alias("family"))))

    def judged(e):
        share = overlap_share(e["onset"], e["offset"], F.col(words))
        return F.struct(e["onset"], e["offset"], e["family"], share.alias("overlap"), (share <= most).alias("ok"), place(e["onset"], F.col(words)).alias("at"))

    out = df.withColumn("_events", F.transform(ordered, judged))
    plain = lambda e: F.concat(F.lit("["), e["family"], F.lit("]"))
    tag = lambda e: F.concat(F.lit("<|sfx:"), e["family"], F.lit("|>"), texts.sound(e["family"], F.col(language), e["offset"] - e["onset"]))
    out = out.withColumn("nv_text", _rendered(F.col(words), F.col("_events"), plain))
    out = out.withColumn("tagged_text", _rendered(F.col(words), F.filter("_events", lambda e: e["ok"]), tag))
    shown = F.transform("_events", lambda e: e.withField("overlap", F.bround(e["overlap"], 3)))
    return out.withColumn("placed", shown).withColumn("n_placed", F.size(F.filter("_events", lambda e: e["ok"]))).drop("_events")


def _rendered(words: Column, events: Column, show) -> Column:
    n = F.size(words)

    def at(i):
        here = F.transform(F.filter(events, lambda e: e["at"] == i), show)
        return F.concat(here, F.when(i < n, F.array(F.get(words, i)["text"])).otherwise(F.array().cast("array<string>")))

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), at)), " ")
