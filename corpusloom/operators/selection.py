"""Ranking, sampling and dealing out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as texts
from corpusloom.sources.readers import indexed


def attested(counts: DataFrame, group: str, label: str, n: str, least: int = 50, share: float = 0.4) -> DataFrame:
    """(group, label, n, share): labels that a group really holds, by number and share; undetermined ones never."""
    shared = counts.withColumn("share", F.col(n) / F.sum(n).over(W.partitionBy(group)))
    return shared.where(~F.startswith(F.col(label), F.lit("und")) & (F.col(n) >= least) & (F.col("share") >= share))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; the filter reaches the window as a group limit."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def pick_with_caps(df: DataFrame, group: str, speaker: str, text: str, order: list[str], caps: tuple[int | None, ...] = (4, 8, 25, None), enough: int = 25, most: int = 60) -> DataFrame:
    """Rows picked of each group in order, with ``rank`` and the ``cap`` that was needed.

    A row is skipped if its folded text is picked already or its speaker has ``cap`` rows; ``most`` rows end a scan. The first cap that gives
    ``enough`` rows counts, else the last. The scan runs down a sorted partition and holds, per cap, what it has picked: at most ``most`` rows
    a group, whatever the group's size.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("rank", T.IntegerType()), T.StructField("cap", T.IntegerType())])
    names = df.columns

    def scan(frames):
        last, picked = None, None

        def finish():
            for cap, state in picked.items():
                if len(state["rows"]) >= enough:
                    break
            out = pd.DataFrame(state["rows"], columns=names)
            return out.assign(rank=range(1, len(out) + 1), cap=cap)[schema.names]

        for frame in frames:
            keys = frame["_key"].to_numpy()
            for row, key, g, s in zip(frame[names].itertuples(index=False, name=None), keys, frame[group], frame[speaker], strict=True):
                if last is None or g != last:
                    if picked is not None:
                        yield finish()
                    last, picked = g, {c: {"rows": [], "texts": set(), "speakers": {}} for c in caps}
                for cap, state in picked.items():
                    if len(state["rows"]) < most and key not in state["texts"] and (cap is None or state["speakers"].get(s, 0) < cap):
                        state["rows"].append(row)
                        state["texts"].add(key)
                        state["speakers"][s] = state["speakers"].get(s, 0) + 1
        if picked is not None:
            yield finish()

    sort = [F.col(o[1:]).desc() if o.startswith("-") else F.col(o) for o in order]
    keyed = df.where(F.col(group).isNotNull()).withColumn("_key", F.coalesce(texts.dedup_key(F.col(text)), F.lit("")))
    near = top(top(keyed, [group, speaker, "_key"], sort, 1, "_first"), [group, speaker], sort, most, "_near").drop("_first", "_near")
    return near.repartition(group).sortWithinPartitions(F.col(group), *sort).mapInPandas(scan, schema)


def complete_groups(df: DataFrame, group: str, order: list[Column], size: int, groups: int, weight: str) -> DataFrame:
    """The first ``size`` rows of groups that have as many, of the ``groups`` lightest such groups."""
    ranked = top(df, [group], order, size)
    whole = ranked.groupBy(group).agg(F.count("*").alias("_n"), F.min(weight).alias("_w")).where(F.col("_n") == size)
    return ranked.join(whole.orderBy("_w", group).limit(groups).select(group), group, "left_semi")


def hash_sample(df: DataFrame, keys: list[str], ident: str, k: int, seed: str = "0") -> DataFrame:
    """``k`` rows of each key, in order of a seeded hash: a sample that reruns agree on."""
    h = F.sha1(F.concat_ws(":", F.lit(seed), F.col(ident).cast("string")))
    return top(df.withColumn("_h", h), keys, [F.col("_h"), F.col(ident)], k).drop("_h")


def cap_per_file(df: DataFrame, file: str, label: str, position: str, cap: int) -> DataFrame:
    return top(df, [file, label], [F.col(position)], cap).drop("rank")


def renumbered(df: DataFrame, group: str, cluster: str, name: str = "spk") -> DataFrame:
    """``name``00, 01, ... for each group's clusters by falling size, the smaller old name first of equals."""
    sizes = df.groupBy(group, cluster).agg(F.count("*").alias("_n"))
    place = F.row_number().over(W.partitionBy(group).orderBy(F.desc("_n"), cluster)) - 1
    return df.join(sizes.select(group, cluster, F.format_string(name + "%02d", place).alias(name)), [group, cluster])


def snake(df: DataFrame, size: str, ident: str, workers: int) -> DataFrame:
    """Adds ``worker``: files by falling size, dealt forth and back. Ranges are ranked apart; no one task sorts all."""
    ranked = indexed(df.withColumn("_order", F.struct(F.negative(size).alias("s"), F.col(ident).alias("i"))), "_order")
    lap, place = F.floor(F.col("row") / workers), F.col("row") % workers
    return ranked.withColumn("worker", F.when(lap % 2 == 0, place).otherwise(workers - 1 - place).cast("int")).select(*df.columns, "worker")


def near_equal_chunks(df: DataFrame, order: str, chunks: int) -> DataFrame:
    """Adds ``chunk``: consecutive chunks, the first ones having one row more where it doesn't divide. Rows are ranked in ranges, apart."""
    total = df.agg(F.count("*").alias("_all"))
    ranked = indexed(df, order).crossJoin(F.broadcast(total))  # one row
    size, longer = F.floor(F.col("_all") / chunks), F.col("_all") % chunks
    in_longer = F.col("row") < longer * (size + 1)
    chunk = F.when(in_longer, F.floor(F.col("row") / (size + 1))).otherwise(longer + F.floor((F.col("row") - longer * (size + 1)) / F.greatest(size, F.lit(1))))
    return ranked.withColumn("chunk", chunk.cast("int")).select(*df.columns, "chunk")


def linspace_bounds(n: int, workers: int) -> list[tuple[int, int]]:
    """Bounds of ``workers`` slices of ``n`` rows, truncated from even steps; the last ends with the rows."""
    cut = [int(i * (n / workers)) for i in range(workers)] + [n]
    return list(zip(cut[:-1], cut[1:], strict=True))


def waves(df: DataFrame, name: str, count: int) -> DataFrame:
    """Adds ``wave``: sorted names in ``count`` equal runs. Runs over the list of names alone."""
    place = F.row_number().over(W.orderBy(name)) - 1
    step = F.greatest(F.lit(1), F.ceil(F.count("*").over(W.partitionBy()) / count))
    return df.withColumn("wave", F.floor(place / step).cast("int"))


def budget_round_robin(files: DataFrame, folder: str, order: str, size: str, budget: int) -> DataFrame:
    """Adds ``depth`` and ``taken``: a file a folder in turn, one that doesn't fit is skipped for good; the first round that takes nothing ends it.

    Rounds that fit whole are found by a running sum over the rounds' sizes and taken as they are, and files larger than what is then left are out. The fold
    runs over the others alone, in order, with a number as its state.
    """
    ranked = files.withColumn("depth", F.row_number().over(W.partitionBy(folder).orderBy(order)) - 1)
    rounds = ranked.groupBy("depth").agg(F.sum(size).alias("_size"))
    upto = rounds.withColumn("_upto", F.sum("_size").over(W.orderBy("depth")))
    whole = upto.where(F.col("_upto") <= budget).agg(F.coalesce(F.max("depth"), F.lit(-1)).alias("_last"), F.coalesce(F.max("_upto"), F.lit(0)).alias("_used"))
    told = ranked.crossJoin(F.broadcast(whole))  # one row
    fitting = F.col(size) <= budget - F.col("_used")
    schema = T.StructType([*ranked.schema.fields, T.StructField("taken", T.BooleanType())])

    def fold(frames):
        total, depth, took, over = None, 0, True, False
        for frame in frames:
            if total is None and len(frame):
                total, depth = frame["_used"].iloc[0], frame["_last"].iloc[0]
            taken = []
            for d, n in zip(frame["depth"], frame[size], strict=True):
                if d != depth:
                    over, depth, took = over or not took or d > depth + 1, d, False
                fits = not over and total + n <= budget
                total, took = (total + n, True) if fits else (total, took)
                taken.append(fits)
            yield frame.assign(taken=taken)[schema.names]

    folded = told.where((F.col("depth") > F.col("_last")) & fitting).repartition(1).sortWithinPartitions("depth", folder).mapInPandas(fold, schema)
    settled = told.where((F.col("depth") <= F.col("_last")) | ~F.coalesce(fitting, F.lit(False))).withColumn("taken", F.col("depth") <= F.col("_last"))
    return settled.select(*schema.names).unionByName(folded)
