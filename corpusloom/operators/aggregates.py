"""Histograms, audits, bins and vector means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.functions import text as texts


def histogram(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, n); counted in each task before the shuffle."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def regrouped(counts: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """Finer counts summed."""
    return counts.groupBy(*by).agg(F.sum(n).cast("long").alias(n))


def shares(counts: DataFrame, group: str, n: str = "n", digits: int | None = None) -> DataFrame:
    share = F.col(n) / F.sum(n).over(W.partitionBy(group))
    return counts.withColumn("share", share if digits is None else F.bround(share, digits))


def distinct_values(df: DataFrame, column: str, without: tuple[str, ...] = ("", "und")) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull() & ~F.col(column).isin(*without)).distinct()


def folder_census(df: DataFrame, config: str, path: str) -> DataFrame:
    return df.groupBy(config, texts.folder(F.col(path)).alias("folder")).agg(F.count("*").alias("n"))


def label_audit(df: DataFrame, group: str, label: str, macro: str, prob: str, margin: str, ident: str, text: str, sure: float = 0.5, close: float = 0.1, top: int = 8, examples: int = 3, cut: int = 120) -> DataFrame:
    """One row a group: ``n``, ``mean_prob``, counts of confident, unsure and close rows, the dominant label and macro label with their shares of
    all rows, the ``top`` labels as "label:n" and the first ``examples`` confident texts of another macro label.

    Ties go to the smaller label. Labels are counted before anything is gathered, so a group's row holds no more than its labels.
    """
    confident = F.col(prob) >= sure
    sums = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.avg(prob).alias("mean_prob"),
        F.count_if(confident).alias("confident"),
        F.count_if(~confident).alias("unsure"),
        F.count_if(F.col(margin) < close).alias("close"),
    )
    kinds = df.where(confident).groupBy(group, label, macro).agg(F.count("*").alias("_k"))
    by_label = kinds.groupBy(group, label).agg(F.sum("_k").alias("_k"))
    by_macro = kinds.groupBy(group, macro).agg(F.sum("_k").alias("_k"))
    key = lambda c: F.struct(-F.col("_k"), F.col(c))
    best = by_label.groupBy(group).agg(F.min_by(label, key(label)).alias("dominant"), F.max("_k").alias("_dominant"))
    best_macro = by_macro.groupBy(group).agg(F.min_by(macro, key(macro)).alias("dominant_macro"), F.max("_k").alias("_macro"))
    ranked = by_label.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc("_k"), label))).where(F.col("_r") <= top)
    listed = ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", F.col(label), F.col("_k").cast("string")).alias("s")))), lambda x: x["s"]), " ").alias("top_labels"))
    off = df.where(confident).join(best_macro.select(group, "dominant_macro"), group).where(F.col(macro) != F.col("dominant_macro"))
    off = off.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(ident))).where(F.col("_r") <= examples)
    shown = off.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", F.substring(text, 1, cut).alias("s")))), lambda x: x["s"]).alias("examples"))
    out = sums
    for side in (best, best_macro, listed, shown):
        out = out.join(side, group, "left")
    return out.select(
        group, "n", "mean_prob", "confident", "unsure", "close", F.coalesce("dominant", F.lit("und")).alias("dominant"), (F.coalesce("_dominant", F.lit(0)) / F.col("n")).alias("dominant_share"),
        F.coalesce("dominant_macro", F.lit("und")).alias("dominant_macro"), (F.coalesce("_macro", F.lit(0)) / F.col("n")).alias("macro_share"), F.coalesce("top_labels", F.lit("")).alias("top_labels"),
        F.coalesce("examples", F.array().cast("array<string>")).alias("examples"),
    )


# --- bins -------------------------------------------------------------------------------------------------------------------------------------


def exact_percentiles(df: DataFrame, value: str, points: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(by, p): the exact percentiles at ``points`` (0 to 1) in an array, interpolated between neighbours; nulls and NaN are left out, and no values give an
    array of nulls (no row of that group with ``by``).

    Equal values are counted before the shuffle, ranges of values are summed apart, and ranks are looked up in the ranges that hold them, so no task holds a
    group's values, however large it is.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranged = counts.repartitionByRange(*by, "_v").withColumn("_part", F.spark_partition_id())
    sums = ranged.groupBy(*by, "_part").agg(F.sum("_n").alias("_size"), F.min("_v").alias("_low"))
    whole, rising = W.partitionBy(*by), W.partitionBy(*by).orderBy("_low")  # a row a range
    marks = sums.select(*by, "_low", F.lead("_low").over(rising).alias("_high"), (F.sum("_size").over(rising) - F.col("_size")).alias("_before"), "_size", F.sum("_size").over(whole).alias("_all"))
    place = [(F.col("_all") - 1) * F.lit(float(x)) for x in points]
    holds = F.lit(False)
    for t in place:
        holds = holds | ((F.floor(t) < F.col("_before") + F.col("_size")) & (F.ceil(t) >= F.col("_before")))
    marks = marks.where(holds)
    marks = marks if by else F.broadcast(marks)  # two rows a point at most
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    inside = (F.col("a._v") >= F.col("b._low")) & (F.col("b._high").isNull() | (F.col("a._v") < F.col("b._high")))
    for c in same:
        inside = inside & c
    met = counts.alias("a").join(marks.alias("b"), inside).select(*[F.col(f"a.{c}").alias(c) for c in by], "_v", "_n", "_low", "_before", "_all")
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*by, "_low").orderBy("_v"))
    ranked = met.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))
    at = lambda t: F.max(F.when((F.col("_from") <= t) & (t < F.col("_to")), F.col("_v")))
    picked = ranked.groupBy(*by).agg(F.max("_all").alias("_all"), *[c for k, t in enumerate(place) for c in (at(F.floor(t)).alias(f"_l{k}"), at(F.ceil(t)).alias(f"_h{k}"))])
    between = [F.when(F.col(f"_l{k}") == F.col(f"_h{k}"), F.col(f"_l{k}")).otherwise((F.ceil(t) - t) * F.col(f"_l{k}") + (t - F.floor(t)) * F.col(f"_h{k}")) for k, t in enumerate(place)]
    return picked.select(*by, F.array(*between).alias("p"))


def bin_edges(df: DataFrame, value: str, bins: int, by: list[str] | None = None, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(by, edges): ``bins``+1 equal steps over the values between two percentiles, NaN left out; equal values widen by half each way."""
    p = exact_percentiles(df, value, (low, high), by)
    a = F.when(F.col("p")[0] == F.col("p")[1], F.col("p")[0] - 0.5).otherwise(F.col("p")[0])
    b = F.when(F.col("p")[0] == F.col("p")[1], F.col("p")[1] + 0.5).otherwise(F.col("p")[1])
    return p.select(*(by or []), F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: a + (b - a) * i / bins).alias("edges"))


def binned(df: DataFrame, value: str, labels: tuple[str, ...], by: list[str] | None = None, name: str = "label") -> DataFrame:
    """Adds the label of each value's bin; bins of each group if ``by`` is given."""
    edges = bin_edges(df, value, len(labels), by)
    joined = df.join(edges, by, "left") if by else df.crossJoin(F.broadcast(edges))  # one row of edges
    return joined.withColumn(name, arrays.bin_label(arrays.bin_index(F.col(value), F.col("edges"), len(labels)), labels)).drop("edges")


# --- groups -------------------------------------------------------------------------------------------------------------------------------------


def window_means(df: DataFrame, keys: list[str], raw: dict[str, str], personal: bool = False) -> DataFrame:
    """Means over windows of raw scores and of calibrated ones; each window is calibrated before the mean."""
    sums = [F.count("*").alias("num_hops")]
    for kind, column in raw.items():
        sums += [F.avg(column).alias(f"{kind}_raw"), F.avg(arrays.calibrated(F.col(column), kind, personal)).alias(kind)]
    return df.groupBy(*keys).agg(*sums)


def group_sizes(df: DataFrame, group: str, member: str) -> DataFrame:
    """Per group: members, and of their rows: sizes descending, least, median, upper middle and most."""
    sizes = df.groupBy(group, member).agg(F.count("*").alias("k"))
    out = sizes.groupBy(group).agg(F.count("*").alias("members"), F.sort_array(F.collect_list("k"), asc=False).alias("sizes"), F.min("k").alias("least"), F.percentile("k", F.lit(0.5)).alias("median"), F.max("k").alias("most"))
    return out.withColumn("upper_middle", F.get("sizes", F.floor(F.size("sizes") / 2).cast("int")))


def in_order(df: DataFrame, keys: list[str], order: list[str], **made: Column) -> DataFrame:
    """(keys, made): aggregates over a key's rows, taken in ``order`` one by one. Sums of doubles go by the order they are added in; so they are the same to the last
    bit however the rows are dealt out, and keys of equal rows get equal sums, where partial sums that meet as tasks end do not. A key's rows are sorted in one
    task, which spills; none are gathered."""
    w = W.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = df.select(*keys, *[c.over(upto).alias(n) for n, c in made.items()], F.lead(F.lit(1)).over(w).isNull().alias("_last"))
    return rows.where("_last").drop("_last")


def mean_vectors(df: DataFrame, keys: list[str], vector: str, normalise: bool = True) -> DataFrame:
    """(keys, n, center): the mean of (unit) vectors, component by component; summed in each task before the shuffle."""
    v = arrays.unit(F.col(vector)) if normalise else F.col(vector)
    parts = df.select(*keys, F.posexplode(v).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    return parts.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


def card_table(df: DataFrame, group: str, subset: str, seconds: Column) -> DataFrame:
    """(group, rows, minutes, subsets): what a dataset card lists of each group."""
    return df.groupBy(group).agg(F.count("*").alias("rows"), (F.sum(seconds) / 60).alias("minutes"), F.array_sort(F.collect_set(subset)).alias("subsets"))


def tag_stats(df: DataFrame, families: str, placed: str) -> DataFrame:
    """(family, placed, overlapped): events of each family by whether they were placed."""
    each = df.select(F.explode(families).alias("family"), F.col(placed).alias("ok"))
    return each.groupBy("family").agg(F.count_if("ok").alias("placed"), F.count_if(~F.col("ok")).alias("overlapped"))


def threshold_sweep(df: DataFrame, score: str, positive: str, thresholds: tuple[float, ...]) -> DataFrame:
    """(threshold, recall, false_positive_rate)."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    rows = df.select(score, positive, t)
    over = (F.col(score) >= F.col("threshold")).cast("double")
    return rows.groupBy("threshold").agg(F.avg(F.when(F.col(positive), over)).alias("recall"), F.avg(F.when(~F.col(positive), over)).alias("false_positive_rate"))


def percentiles(df: DataFrame, value: str, points: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """(percentile, value); null values if there are none."""
    p = exact_percentiles(df, value, tuple(x / 100 for x in points))
    return p.select(F.posexplode("p").alias("i", "value")).select(F.get(F.array(*[F.lit(x) for x in points]), "i").alias("percentile"), "value")
