"""Scores of models: nested means, error rates, tag scores, advantages, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import text as texts
from corpusloom.sources.readers import indexed


def nested_means(df: DataFrame, score: str, levels: list[str], alias: str = "score") -> list[DataFrame]:
    """Means of means: over the rows of the finest level, then over each level's members, each counting once. ``levels`` go from coarse to
    fine; the last frame is the overall mean in one row. Missing scores are left out."""
    out = [df.where(F.col(score).isNotNull()).groupBy(*levels).agg(F.avg(score).alias(alias))]
    for k in range(len(levels) - 1, -1, -1):
        out.append(out[-1].groupBy(*levels[:k]).agg(F.avg(alias).alias(alias)))
    return out


def error_rates(df: DataFrame, reference: str, hypothesis: str, clip: bool = True, name: str = "cer") -> DataFrame:
    return df.withColumn(name, texts.error_rate(F.col(reference), F.col(hypothesis), clip))


def tag_scores(df: DataFrame, ident: str, reference: str, hypothesis: str) -> DataFrame:
    """(tag, tp, fp, fn, precision, recall, f1): tags as multisets of each row, summed."""
    count = lambda c, n: df.select(ident, F.explode(texts.tags(F.col(c))).alias("tag")).groupBy(ident, "tag").agg(F.count("*").alias(n))
    both = count(reference, "r").join(count(hypothesis, "h"), [ident, "tag"], "full").fillna(0, ["r", "h"])
    sums = both.groupBy("tag").agg(F.sum(F.least("r", "h")).alias("tp"), F.sum(F.greatest(F.lit(0), F.col("h") - F.col("r"))).alias("fp"), F.sum(F.greatest(F.lit(0), F.col("r") - F.col("h"))).alias("fn"))
    out = sums.withColumn("precision", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).withColumns({c: F.bround(c, 4) for c in ("precision", "recall", "f1")})


def untagged_error(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """One row: the mean error rate of texts without tags, not clipped."""
    return df.agg(F.avg(texts.error_rate(texts.without_tags(F.col(reference)), texts.without_tags(F.col(hypothesis)))).alias("cer"))


def group_advantage(df: DataFrame, group: str, reward: str, epsilon: float = 1e-8) -> DataFrame:
    """Adds ``advantage``: (reward - mean) / (deviation + epsilon) within the group, with the unbiased deviation; 0 in a group of one."""
    w = W.partitionBy(group)
    return df.withColumn("advantage", F.coalesce((F.col(reward) - F.avg(reward).over(w)) / (F.stddev_samp(reward).over(w) + epsilon), F.lit(0.0)))


def run_summaries(logs: DataFrame, run: str, step: str, loss: str, tasks: dict[str, str], last: int = 10) -> DataFrame:
    """One row a run: final and least loss, mean of the last ``last``, number of logged steps, per task final, least and number of points, and the means
    of finals and of least losses over tasks that have any."""
    trained = logs.where(F.col(loss).isNotNull()).withColumn("_r", F.row_number().over(W.partitionBy(run).orderBy(F.desc(step))))
    base = trained.groupBy(run).agg(
        F.max_by(loss, step).alias("final_loss"), F.avg(F.when(F.col("_r") <= last, F.col(loss))).alias("last_mean_loss"), F.min(loss).alias("min_loss"), F.count("*").alias("steps_logged")
    )
    sums = []
    for name, column in tasks.items():
        seen = F.col(column).isNotNull()
        sums += [F.max_by(column, F.when(seen, F.col(step))).alias(f"{name}_final"), F.min(column).alias(f"{name}_min"), F.count(column).alias(f"{name}_points")]
    dev = logs.groupBy(run).agg(*sums)
    for name, kind in (("dev_mean", "final"), ("dev_min_mean", "min")):
        present = F.array_compact(F.array(*[F.col(f"{n}_{kind}") for n in tasks]))
        dev = dev.withColumn(name, F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present)))
    return base.join(dev, run, "full")


def leaderboard(runs: DataFrame, ident: str, status: str, dev: str, train: str, ok: str = "ok") -> DataFrame:
    """Adds ``metric`` and ``place``: runs that ended well by rising metric, then the others without a place. The metric is the dev loss
    if every such run has one, else the training loss. Ranges are ranked apart; no one task sorts all runs."""
    good = F.col(status) == ok
    missing = runs.agg(F.coalesce(F.max(F.when(good & F.col(dev).isNull(), 1)), F.lit(0)).alias("_missing"))
    scored = runs.crossJoin(F.broadcast(missing)).withColumn("metric", F.when(good, F.when(F.col("_missing") == 0, F.col(dev)).otherwise(F.col(train)))).drop("_missing")
    ranked = indexed(scored.where("metric is not null").withColumn("_order", F.struct("metric", ident)), "_order")
    placed = ranked.withColumn("place", (F.col("row") + 1).cast("int")).select(*scored.columns, "place")
    return placed.unionByName(scored.where("metric is null").withColumn("place", F.lit(None).cast("int")))


def markdown(runs: DataFrame, place: str, columns: list[Column]) -> DataFrame:
    """(line): a row of a table each; a missing place is a dash."""
    cells = [F.coalesce(F.col(place).cast("string"), F.lit("—")), *[F.coalesce(c.cast("string"), F.lit("—")) for c in columns]]
    return runs.select(place, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def heat_map(df: DataFrame, row: str, column: str, score: str, columns: list[str]) -> DataFrame:
    """Means by row and column, columns side by side, and ``mean`` over those present."""
    out = df.groupBy(row).pivot(column, columns).agg(F.avg(score))
    present = F.array_compact(F.array(*[F.col(f"`{c}`") for c in columns]))
    return out.withColumn("mean", F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(present), F.lit(0)))


def best_of_columns(df: DataFrame, column: str, score: str, ident: str) -> DataFrame:
    """Adds ``best`` and ``scaled``: whether a row has its column's least score (the smallest name of equals), and its place between the column's extremes."""
    w = W.partitionBy(column)
    low, high = F.min(score).over(w), F.max(score).over(w)
    first = F.row_number().over(w.orderBy(score, ident)) == 1
    return df.withColumn("best", first).withColumn("scaled", F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(0.0))


def perplexity(loss: Column) -> Column:
    return F.exp(loss)


def ensemble(prob: Column, label: Column, other: Column, cap: float = 0.49) -> Column:
    """A label's probability, capped where the other model disagrees."""
    return F.when(label == other, F.least(prob, F.lit(1.0))).otherwise(F.least(prob, F.lit(cap)))


def top_two(probs: Column, labels: Column) -> dict[str, Column]:
    """label, prob and margin of the best of an array of probabilities."""
    order = F.reverse(F.array_sort(F.arrays_zip(probs.alias("p"), labels.alias("l"))))
    first, second = F.get(order, F.lit(0)), F.get(order, F.lit(1))
    return {"label": first["l"], "prob": F.least(first["p"], F.lit(1.0)), "margin": first["p"] - F.coalesce(second["p"], F.lit(0.0))}
