"""Connected components by alternating large-star and small-star steps over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import base


#: Links of one id that a task takes without trouble; beyond them heavy ids are broadcast instead of shuffled.
HUB = 50_000


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that a link to another id names; component is the smallest id reachable.

    Each round is a handful of joins and aggregations by id, combined before the shuffle. Where an id has very many links, such ids, which are
    few, are broadcast and their links stay where they are, so none is gathered; no component meets in one task. Each round's links are
    written to the shared folder; the last round's are dropped. Nulls and links of an id with itself name nothing.
    """
    edges = base.save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    while True:
        both = edges.select("u", "v", F.lit(1).alias("down")).union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("down")))
        down, most = both.groupBy("u").agg(F.sum("down").alias("down"), F.count("*").alias("n")).agg(F.max("down"), F.max("n")).first()
        if down is None or down == 1 and not edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").limit(1).count():
            break  # every id has one link down, to an id without one
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        up = both.where("v > u").select("u", "v")
        met = base.lookup(up, low, "u", "n", 2 * edges.count()) if most > HUB else up.join(low.drop("n"), "u")
        large = met.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = base.save(moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        base.drop(edges)
        edges = new
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
