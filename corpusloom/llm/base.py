"""Shared plumbing: tables, scratch tables in the cluster's shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import gc
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which the small side of a join may be broadcast, after counting it.
BROADCAST_ROWS = 200_000

_roots: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) without that setting gets a folder of its own; on a cluster one machine's folder would not do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir(f"file:///tmp/corpusloom-{uuid.uuid4().hex}")
            found = context.getCheckpointDir()
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{found.rstrip('/')}/scratch-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at exit the session may be gone
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, lost executors cost nothing before it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Remove a table that ``save`` wrote, once nothing reads it any more."""
    remove(df.sparkSession, df.scratch)


def free_shuffles(spark: SparkSession) -> None:
    """Let shuffle files go that no live plan reads, rather than when the driver next collects its garbage: Python's references, then the JVM's, twice."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows, else ``df`` for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key is heavy if it has more than one in so many rows; so there are fewer heavy keys than this.
HEAVY = 10_000


def lookup(rows: DataFrame, table_: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``rows`` joined with a table of one row a key, ``n`` telling how many of the ``total`` rows have it.

    Heavy keys, at most ``HEAVY`` of them whatever the data, are broadcast, so their rows stay where they are; the others are
    shuffled and none is large.
    """
    heavy, light = table_.where(F.col(n) * HEAVY > total), table_.where(F.col(n) * HEAVY <= total)
    spread = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return spread.unionByName(rest)


#: How a Python worker, which lives through many tasks, gives freed memory back.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "262144", "MALLOC_MMAP_THRESHOLD_": "262144", "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Bytes of an Arrow batch that a Python worker gets, in place of Spark's 64 MB: a worker holds a few copies of it.
BATCH_BYTES = 4 << 20


def sized(rows: DataFrame, key: str, n: str = "n", least: int = 1) -> DataFrame:
    """``rows`` plus ``n``, the number of rows of their key; keys with fewer than ``least`` go. No key's rows are gathered."""
    counts = save(rows.groupBy(key).agg(F.count("*").alias(n)).where(F.col(n) >= least), "sizes")
    return lookup(rows, counts, key, n, counts.agg(F.sum(n)).first()[0] or 0)


def reachable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it; clusters without such a path take it by ``--py-files``.

    Batches for them are bounded by ``BATCH_BYTES`` if the session has Spark's default.
    """
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, None) == str(64 << 20) + "b":
        spark.conf.set(size, f"{BATCH_BYTES}b")
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    for key, value in WORKER_MEMORY.items():
        env.setdefault(key, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def append_columns(df: DataFrame, fields, start) -> DataFrame:
    """``df`` plus ``fields``, which Arrow batches are mapped to in Python; one pass, no shuffle.

    ``start()`` runs once a task and returns a function from a record batch to one Arrow array per field.
    A column of ``df`` with the name of a new one is replaced.
    """
    import pyarrow as pa
    from pyspark.sql.types import StructType

    taken = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    schema = StructType([*kept, *fields])
    names, held = schema.names, [f.name for f in kept]
    reachable(df.sparkSession)

    def run(batches):
        work = start()
        for batch in batches:
            made = work(batch)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in held), *made], names=names)

    return df.mapInArrow(run, schema)


def sorted_groups(batches, key: str, columns: list[str], rows: int = 4096):
    """From batches sorted by ``key``: (keys, [columns]) of whole groups, of about ``rows`` rows or one larger group.

    Numbers come as numpy arrays, binaries as lists.
    """
    import numpy as np
    import pyarrow as pa

    def made(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        out = [table.column(c) for c in columns]
        return table.column(key).to_numpy(), [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in out]

    held, last = [], None
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            keys = part.column(part.schema.get_field_index(key)).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if held and keys[0] != last and not cut:
                yield made(held)
                held = []
            if cut:
                held.append(part.slice(0, cut))
                yield made(held)
                held = []
            held.append(part.slice(cut))
            last = keys[-1]
    if held:
        yield made(held)
