"""Constrained clustering of vectors within groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.operators import aggregates, joins, selection


def average_linkage(units: np.ndarray, cut: float) -> np.ndarray:
    """Clusters of unit vectors by average-linkage agglomeration on cosine distance, merging what is nearer than ``cut``; numbered by first member.

    Chains of nearest neighbours end in pairs that are each other's nearest, which may be merged at once, as an average is never below the nearer of
    its parts; what has no neighbour nearer than ``cut`` is done. So time and memory go with the square of the members, not the cube. Of neighbours at the
    same distance the one that the chain came from goes first, then the first member.
    """
    n = len(units)
    label, size, waiting, chain = np.arange(n), np.ones(n), np.ones(n, bool), []
    d = units @ units.T
    d = 1.0 - (d + d.T) / 2  # the same both ways, to the last bit
    np.fill_diagonal(d, np.inf)
    while chain or waiting.any():
        chain = chain or [int(np.argmax(waiting))]
        last = chain[-1]
        near = int(np.argmin(d[last]))
        if not d[last, near] < cut:  # alone in its chain, or it would be nearer to what leads to it
            waiting[last], chain = False, []
            d[last], d[:, last] = np.inf, np.inf
            continue
        if len(chain) > 1 and d[last, chain[-2]] <= d[last, near]:
            i, j = sorted((last, chain[-2]))
            chain = chain[:-2]
            d[i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i, i] = np.inf
            d[:, i] = d[i]
            d[j], d[:, j] = np.inf, np.inf
            size[i] += size[j]
            waiting[j] = False
            label[label == j] = i
        else:
            chain.append(near)
    return np.unique(label, return_inverse=True)[1]


def agglomerate(df: DataFrame, groups: list[str], ident: str, vector: str, cut: float = 0.4) -> DataFrame:
    """(groups, ident, vector, cluster): each group clustered on its own. A group is one person's or place's vectors and fits in a task, with the
    square of their number in memory."""
    kept = [*groups, ident, vector]
    rows = df.select(*kept)

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(ident)
        m = np.array([np.asarray(v, float) for v in frame[vector]])
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-8)
        return frame.assign(cluster=average_linkage(m, cut) if len(frame) > 1 else 0)

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.groupBy(*groups).applyInPandas(one, StructType([*rows.schema.fields, StructField("cluster", LongType())]))


def fold_small(clusters: DataFrame, groups: list[str], ident: str, vector: str, least: int = 5) -> DataFrame:
    """Members of clusters under ``least`` go to the nearest centroid of a larger one of their group, if there is one. Centroids are those
    before any move."""
    sizes = clusters.groupBy(*groups, "cluster").agg(F.count("*").alias("_n"))
    sized = clusters.join(sizes, [*groups, "cluster"])
    centers = aggregates.mean_vectors(sized.where(F.col("_n") >= least), [*groups, "cluster"], vector).select(*groups, F.col("cluster").alias("_to"), "center")
    moved = joins.nearest(sized.where(F.col("_n") < least).select(*groups, ident, vector), centers, ident, vector, "_to", "center", groups)
    out = sized.join(moved.select(*groups, ident, "_to"), [*groups, ident], "left")
    return out.select(*groups, ident, vector, F.coalesce("_to", "cluster").alias("cluster"))


def constrained(df: DataFrame, place: str, kind: str, ident: str, vector: str, cut: float = 0.4, least: int = 5, name: str = "spk") -> DataFrame:
    """(place, kind, ident, spk): clusters never mix kinds (null is UNKNOWN), small ones are folded, names go by falling size over the place."""
    known = df.withColumn(kind, F.coalesce(F.col(kind).cast("string"), F.lit("UNKNOWN")))
    folded = fold_small(agglomerate(known, [place, kind], ident, vector, cut), [place, kind], ident, vector, least)
    whole = folded.withColumn("cluster", F.concat_ws("/", F.col(kind), F.lpad(F.col("cluster").cast("string"), 8, "0")))
    return selection.renumbered(whole, place, "cluster", name).select(place, kind, ident, name)


def silhouette(df: DataFrame, groups: list[str], ident: str, cluster: str, vector: str) -> DataFrame:
    """(groups, silhouette): the mean over members of (b - a) / max(a, b), on cosine distance; null unless there are more clusters than
    one and fewer than members.

    The mean distance of a unit vector to a cluster follows from the cluster's sum of unit vectors, so members meet clusters, never each other.
    """
    rows = df.select(*groups, ident, F.col(cluster).alias("c"), arrays.unit(F.col(vector)).alias("u"))
    parts = rows.select(*groups, "c", F.posexplode("u").alias("i", "x")).groupBy(*groups, "c", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    sums = parts.groupBy(*groups, "c").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda s: s["s"]).alias("sum"))
    joined = rows.join(sums.withColumnRenamed("c", "o"), groups)
    same = F.col("c") == F.col("o")
    near = arrays.dot(F.col("u"), F.col("sum"))
    mean = F.when(same, F.when(F.col("n") > 1, (F.col("n") - 1 - (near - arrays.dot(F.col("u"), F.col("u")))) / (F.col("n") - 1))).otherwise(1 - near / F.col("n"))
    per = joined.groupBy(*groups, ident, "c").agg(F.max(F.when(same, mean)).alias("a"), F.min(F.when(~same, mean)).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    out = per.groupBy(*groups).agg(F.avg(s).alias("s"), F.count_distinct("c").alias("k"), F.count("*").alias("n"))
    return out.select(*groups, F.when((F.col("k") > 1) & (F.col("k") < F.col("n")), F.col("s")).alias("silhouette"))
