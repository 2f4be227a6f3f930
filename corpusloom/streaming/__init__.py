"""Structured Streaming: windows over events, incremental jobs, stateful sessions and packing.

Every aggregation also runs on a batch frame, with the same result over the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream over a folder of parquet files; a file's rows come once, ``files`` of them a batch at most (the back-pressure)."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def _timed(df: DataFrame, time: str, delay: str) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, delay) if df.isStreaming else df


def _sums(value: str):
    return F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), F.round(F.max(value), 6).alias("most")


def tumbling(df: DataFrame, keys: list[str], time: str = "ts", value: str = "value", size: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(keys, start, n, total, most) per window of ``size``; rows later than ``delay`` are dropped by a stream."""
    out = _timed(df, time, delay).groupBy(F.window(time, size), *keys).agg(*_sums(value))
    return out.select(*keys, F.col("window.start").alias("start"), "n", "total", "most")


def sliding(df: DataFrame, keys: list[str], time: str = "ts", value: str = "value", size: str = "1 hour", slide: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    out = _timed(df, time, delay).groupBy(F.window(time, size, slide), *keys).agg(*_sums(value))
    return out.select(*keys, F.col("window.start").alias("start"), "n", "total", "most")


def by_session(df: DataFrame, keys: list[str], time: str = "ts", value: str = "value", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n, total, most) per run of rows less than ``gap`` apart; it ends a gap after its last row."""
    out = _timed(df, time, delay).groupBy(F.session_window(time, gap), *keys).agg(*_sums(value))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total", "most")


def deduplicated(df: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first row of each key; a stream forgets keys after ``delay``."""
    df = _timed(df, time, delay)
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


# --- jobs -----------------------------------------------------------------------------------------------------------------------------------------


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", form: str = "parquet") -> None:
    """All that is there now, then stop: an incremental job that goes on where its checkpoint ends, each input file once."""
    df.writeStream.format(form).outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """``each(batch, number)`` for every micro-batch: pack, ship, free. With ``every`` the query keeps watching and is returned; else it ends with what is there."""
    writer = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if every:
        return writer.trigger(processingTime=every).start()
    writer.trigger(availableNow=True).start().awaitTermination()
    return None


def collected(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """A small stream's output as a table in memory, once all that is there is processed."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def packed(df: DataFrame, key: str, ident: str, length: str, block: int) -> DataFrame:
    """(key, ident, block, offset): greedy packing of documents as they come, in order of ``ident`` within a batch. A key's state is its open
    block's number and fill, so it never grows."""

    def step(key_, frames, state):
        number, filled = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(ident)
        blocks, places = [], []
        for n in rows[length]:
            n = 0 if pd.isna(n) else int(n)
            if filled + n > block and filled:
                number, filled = number + 1, 0
            blocks.append(number)
            places.append(filled)
            filled += n
        state.update((int(number), int(filled)))
        yield pd.DataFrame({key: key_[0], ident: rows[ident].to_numpy(), "block": blocks, "offset": places})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {ident} {kinds[ident]}, block bigint, offset bigint", "number bigint, filled bigint", "append", "NoTimeout")
