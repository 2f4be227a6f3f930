"""Weighted mixtures of datasets, vocabularies and set operations on listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse_spec(spec: str) -> list[tuple[str, float]]:
    """``path[:weight],...``: the weight stands after the last colon; a tail that is no number belongs to the path."""
    out = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        path, colon, tail = part.rpartition(":")
        try:
            out.append((path, float(tail)) if colon else (part, 1.0))
        except ValueError:
            out.append((part, 1.0))
    return out


def mixture_index(spark: SparkSession, sizes: list[int], weights: list[float]) -> DataFrame:
    """(dataset, position, row): which row of which dataset comes at each position. A weight below 1 strides evenly, above 1 repeats;
    every dataset has one row at least."""
    parts = []
    for k, (n, w) in enumerate(zip(sizes, weights, strict=True)):
        count = max(1, round(n * w))
        i = F.col("id")
        row = (i * F.lit(n / count)).cast("long") if count <= n else i % n
        parts.append(spark.range(count).select(F.lit(k).alias("dataset"), i.alias("position"), row.alias("row")))
    return reduce(DataFrame.unionByName, parts)


def strided(df: DataFrame, keys: list[str], order: str, weight: float) -> DataFrame:
    """The rows that a mixture takes of each key's, ``weight`` of them: repeated (``copy`` from 0) or evenly strided."""
    n = F.count("*").over(W.partitionBy(*keys))
    ranked = df.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1).withColumn("_n", n)
    count = F.greatest(F.lit(1.0), F.bround(F.col("_n") * weight)).cast("long")
    ranked = ranked.withColumn("_count", count)
    if weight > 1:
        times = F.floor((F.col("_count") - 1 - F.col("_i")) / F.col("_n"))
        return ranked.where(F.col("_i") < F.col("_count")).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), times))).drop("_i", "_n", "_count")
    step = F.col("_n") / F.col("_count")
    first = F.ceil(F.col("_i") / step)
    hit = F.exists(F.array(first - 1, first, first + 1), lambda k: (k >= 0) & (k < F.col("_count")) & ((k * step).cast("long") == F.col("_i")))
    return ranked.where(hit).withColumn("copy", F.lit(0).cast("long")).drop("_i", "_n", "_count")


def mixture_totals(packs: DataFrame, arm: str, blocks: str, weight: str, tokens: str | None = None, block: int = 10_240, fill: float = 0.97, step_blocks: int = 2_048, epochs: float = 1.0) -> DataFrame:
    """(arm, packs, blocks, tokens, weighted, share, steps, decay): an arm's part of a mixture, and of its training steps."""
    told = F.coalesce(F.col(tokens), F.floor(F.col(blocks) * block * fill)) if tokens else F.floor(F.col(blocks) * block * fill)
    sums = packs.groupBy(arm).agg(F.count("*").alias("packs"), F.sum(blocks).alias("blocks"), F.sum(told).cast("long").alias("tokens"), F.sum(F.col(blocks) * F.col(weight)).alias("weighted"))
    grand = F.sum("weighted").over(W.partitionBy())
    steps = F.floor(epochs * grand / step_blocks).cast("long")
    return sums.withColumn("share", F.col("weighted") / grand).withColumn("steps", steps).withColumn("decay", F.greatest(F.lit(1), F.bround(steps * 0.1)).cast("long"))


def finished(packs: DataFrame, index: DataFrame, summaries: DataFrame, name: str, training: bool = True) -> DataFrame:
    """Packs that have an index and a summary; those for development stay out of training."""
    out = packs.join(index.select(name).distinct(), name, "left_semi").join(summaries.select(name).distinct(), name, "left_semi")
    return out.where(~F.endswith(F.col(name), F.lit("-dev"))) if training else out


# --- vocabularies and sets -----------------------------------------------------------------------------------------------------------------


def union_values(column: str, *frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, [f.select(column) for f in frames]).where(F.col(column).isNotNull()).distinct()


def append_vocabulary(old: DataFrame, new: DataFrame, token: str = "token", position: str = "pos") -> DataFrame:
    """(token, pos): the old list as it is, then new tokens in order after it. Positions of old tokens never change."""
    fresh = new.select(token).where(F.col(token).isNotNull()).distinct().join(old.select(token), token, "left_anti")
    start = old.agg(F.coalesce(F.max(position) + 1, F.lit(0)).alias("_start"))
    placed = fresh.withColumn("_r", F.row_number().over(W.orderBy(token)) - 1).crossJoin(F.broadcast(start))  # one row
    return old.select(token, F.col(position).cast("long")).unionByName(placed.select(token, (F.col("_start") + F.col("_r")).cast("long").alias(position)))


def broken_prefix(old: DataFrame, new: DataFrame, token: str = "token", position: str = "pos") -> DataFrame:
    """Old tokens that aren't at their old position in the new list; none if it is an extension."""
    return old.select(token, position).join(new.select(token, position), [token, position], "left_anti")


def missing_from(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.select(*target.columns).exceptAll(target)


def all_of(*frames: DataFrame) -> DataFrame:
    """The frames one after the other, missing columns being null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def not_kept(listing: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """Files to delete; deleting them is the caller's."""
    return listing.join(kept, name, "left_anti")
