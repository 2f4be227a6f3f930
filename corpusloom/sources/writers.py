"""Writers: datasets are folders of parquet files, so there are no indexes to merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources import readers

#: Rows of a metadata shard.
SHARD_ROWS = 40_000


#: Bytes of a file of packed blocks, and what a token of one takes at most over all its columns.
FILE_BYTES, TOKEN_BYTES = 256 << 20, 24


def write_blocks(blocks: DataFrame, path: str, rows: int = 4_096, block: int = 10_240, most: int = FILE_BYTES) -> None:
    """Packed blocks with both hashes of their ids, ``sha1`` and ``hash``, in files of so many rows that hold ``most`` bytes before compression."""
    ids = F.array_join(F.transform("input_ids", lambda t: t.cast("string")), ",")
    hashed = blocks.withColumn("sha1", F.sha1(ids)).withColumn("hash", F.xxhash64("input_ids"))
    hashed.write.option("maxRecordsPerFile", max(1, min(rows, most // (TOKEN_BYTES * block)))).parquet(path)


def reshard(df: DataFrame, path: str, rows: int = SHARD_ROWS) -> bool:
    """Files of at most ``rows`` rows; nothing is done, and False returned, if the folder is complete already."""
    if exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    return True


def write_ordered(df: DataFrame, path: str, insert: dict[str, tuple[int, Column]] | None = None, describe: dict[str, dict] | None = None) -> None:
    """Parquet with new columns at given positions and metadata on columns."""
    names = list(df.columns)
    for name, (at, value) in (insert or {}).items():
        df = df.withColumn(name, value)
        names.insert(at, name)
    df.select(*[F.col(n).alias(n, metadata=describe[n]) if describe and n in describe else F.col(n) for n in names]).write.option("compression", "snappy").parquet(path)


def append_new(df: DataFrame, path: str, on: list[str]) -> int:
    """Append the rows whose keys aren't in the folder yet, as JSON lines; a run that was broken off goes on where it was. Returns their number, counted
    as they are written."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.schema(df.schema).json(path).select(*on).distinct(), on, "left_anti").select(*df.columns)
    written = Observation()
    df.observe(written, F.count("*").alias("n")).write.mode("append").json(path)
    return written.get["n"]


def cached(df: DataFrame, path: str, on: list[str], compute) -> DataFrame:
    """``compute(rows not yet in the folder)`` appended to it, and the whole folder: a cache by key."""
    spark = df.sparkSession
    todo = df.join(spark.read.parquet(path).select(*on), on, "left_anti") if exists(spark, path) else df
    compute(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def write_groups(df: DataFrame, path: str, *groups: str) -> None:
    """A folder for each group."""
    df.write.partitionBy(*groups).parquet(path)


def write_summary(counts: DataFrame, path: str) -> None:
    """Counters as one JSON line."""
    counts.coalesce(1).write.mode("overwrite").json(path)


def concatenate(path: str, *frames: DataFrame) -> None:
    """Datasets one after the other, in one folder."""
    for k, df in enumerate(frames):
        df.write.mode("append" if k else "error").parquet(path)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, all types: what later merges with other shards."""
    return spark.createDataFrame([], schema)


def card_config(groups: DataFrame, name: str, pattern: str = "{}/*.parquet") -> DataFrame:
    """(name, yaml): a dataset card's entry for each group."""
    body = F.format_string("- config_name: %s\n  data_files:\n  - split: train\n    path: " + pattern.replace("{}", "%s"), F.col(name), F.col(name))
    return groups.select(name, body.alias("yaml")).distinct()


def card(entries: DataFrame, name: str, rest: str = "") -> str:
    """The card's head from its entries, in order; text outside the ``configs:`` block stays."""
    lines = [r["yaml"] for r in entries.orderBy(name).collect()]  # one entry a subset
    return "---\nconfigs:\n" + "\n".join(lines) + "\n---\n" + rest


def verified_copy(source: DataFrame, target: DataFrame, name: str, size: str) -> DataFrame:
    """(files, bytes, missing, wrong): whether a copy is whole before it replaces the original."""
    both = source.select(name, F.col(size).alias("_a")).join(target.select(name, F.col(size).alias("_b")), name, "left")
    return both.agg(F.count("*").alias("files"), F.sum("_a").alias("bytes"), F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a") != F.col("_b")).alias("wrong"))


def publish(create: Callable[[], object], upload: Callable[[], object], sleep: Callable[[float], None] | None = None) -> object:
    """A folder's upload by functions of the caller, as no client of a hub is part of this package: ``create()`` in up to 10 attempts with waits of 120 s,
    then ``upload()``, which goes on where it was, in up to 5 with waits of 300 s."""
    readers.retry(create, (120,), 10, sleep)
    return readers.retry(upload, (300,), 5, sleep)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
