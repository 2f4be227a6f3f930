"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm import base

#: Words of the size measure.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Sources up to which their table is broadcast, after counting them.
SOURCES = 50_000
#: Cells of the drawn hash, in each of which a source's words are summed.
CELLS = 4096


def source_targets(sized: DataFrame, *, source: str = "source", size: str = "size", weights=WEIGHTS, most: float = 3.0) -> DataFrame:
    """Per source: ``source_size``, ``weight``, ``target``.

    Sources in code-point order, null last, get the ``weights`` in turn. Targets share the total size by weight; one that would pass
    ``most`` times its source's size stops there and the excess is reshared by weight among the others. In order of
    size/weight the stopped sources come first, so one running sum finds the level at which sharing stops.
    The windows run over the table of sources alone.
    """
    totals = sized.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    order = [(F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(W.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward)
    led = totals.withColumn("weight", weight).withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= most * F.col("source_size"))
    share = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return led.select("source", "source_size", "weight", F.least(most * F.col("source_size"), share * F.col("weight")).alias("target"))


def drawn(key, seed: str):
    """A uniform cell 0 to ``CELLS`` - 1 from the MD5 of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.floor(F.conv(digits, 16, 10).cast("double") / float(16**13) * CELLS).cast("int")


def source_cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` plus ``rate`` and ``cut``: a document's extra copy is taken if its cell is below the cut.

    The draws of a source share one cut. It lies where the words below it come nearest to what the source's fraction asks for (the lowest of equals): near the
    fraction itself, and off it by as much as the draws of this source happen to be. Windows run over the at most ``CELLS`` sums of a source.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = targets.withColumn("rate", rate).withColumn("wanted", (F.col("rate") - F.floor("rate")) * F.col("source_size"))
    cells = sized.groupBy("source", "cell").agg(F.sum("size").cast("long").alias("words"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("cell"))
    ends = cells.withColumn("upto", upto).select(F.col("source").alias("_source"), (F.col("cell") + 1).alias("end"), "upto")
    met = ends.join(base.small(rated.select("source", "wanted"), SOURCES), F.col("_source").eqNullSafe(F.col("source")))
    best = met.groupBy("source").agg(F.min(F.struct(F.abs(F.col("upto") - F.col("wanted")).alias("off"), F.col("end"))).alias("best"))
    best = best.select(F.col("source").alias("_source"), "best")
    cut = F.when(F.col("best.off") < F.col("wanted"), F.col("best.end")).otherwise(0)
    return rated.join(best, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("cut", F.coalesce(cut, F.lit(0))).drop("_source", "best", "wanted")


def plan_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: float = 3.0, seed: str = "mix") -> DataFrame:
    """Adds ``size`` (words), ``source_size``, ``target``, ``rate`` and ``copies`` to each document.

    rate = target / source_size; a document is taken floor(rate) times and once more by a draw for the fraction rate - floor(rate):
    the hash of seed and key, taken below a cut that all documents of the source share (``source_cuts``). So reruns agree, no document is taken
    more than ``most`` times, and a source's words are off its target by half a cell's words at most: those of a document, or of 1/``CELLS`` of the source.
    Null texts have size 0; null keys draw as the key "null"; rows with one key draw alike. Columns of ``docs`` with these names are
    replaced. A source without words has rate 0. Nothing is shuffled but a row per task, source and cell, and the sources' table
    is broadcast once it is counted to be small (else joined by shuffle).
    """
    added = ("size", "source_size", "target", "rate", "copies")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(f"`{source}`").alias("source"), drawn(F.col(f"`{key}`"), seed).alias("cell"), size.alias("size"))
    sized = base.save(sized.groupBy("source", "cell").agg(F.sum("size").cast("long").alias("size")), "cells")
    targets = base.save(source_targets(sized, weights=weights, most=most), "targets")
    cuts = base.save(source_cuts(sized, targets), "cuts")
    side = base.small(cuts.select(F.col("source").alias("_source"), "source_size", "target", "rate", "cut"), SOURCES)
    joined = docs.withColumn("size", size).join(side, F.col(f"`{source}`").eqNullSafe(F.col("_source")), "left").drop("_source")
    copies = F.floor("rate") + F.when(drawn(F.col(f"`{key}`"), seed) < F.col("cut"), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop("cut")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each document ``copies`` times, numbered by ``copy`` from 1; options as in ``plan_copies``."""
    planned = plan_copies(docs, **options)
    return planned.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
