"""Readers: Spark's own where it has one, else binary files and Arrow batches."""

from __future__ import annotations

import fnmatch
import io
import json
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, merge: bool = False) -> DataFrame:
    """Whole tables or some columns; only those are read. ``merge``: columns of all files, null where a file lacks one."""
    df = spark.read.option("mergeSchema", merge).parquet(*paths)
    return df.select(*columns) if columns else df


def with_fallbacks(df: DataFrame, columns: dict[str, list[str]], required: tuple[str, ...] = ()) -> DataFrame:
    """Each column from the first present one of its list that isn't null; null if none is present. Without a required one the
    frame is empty, as a file without it is skipped."""
    have = set(df.columns)
    out = df.withColumns({name: F.coalesce(*[F.col(c) for c in names if c in have]) if have & set(names) else F.lit(None).cast("string") for name, names in columns.items()})
    return out if have.issuperset(required) else out.limit(0)


def subset(path: Column) -> Column:
    """A file's parent folder."""
    return F.element_at(F.split(path, "/"), -2)


def with_subset(df: DataFrame) -> DataFrame:
    return df.withColumn("subset", subset(F.col("_metadata.file_path")))


def head(df: DataFrame, n: int, order: str) -> tuple[DataFrame, DataFrame]:
    """(the first rows in order, one row with the number of all): each task keeps ``n`` rows, and counting reads footers where the source can."""
    return df.orderBy(order).limit(n), row_counts(df)


def first_per_file(df: DataFrame, file: str, position: str, value: str) -> DataFrame:
    """(file, value): of each file's first row."""
    return df.groupBy(file).agg(F.min_by(value, position).alias(value))


def row_counts(df: DataFrame, file: str | None = None) -> DataFrame:
    """Rows, or rows of each file; counting reads footers alone where the source can."""
    return df.groupBy(file).agg(F.count("*").alias("rows")) if file else df.agg(F.count("*").alias("rows"))


def indexed(df: DataFrame, order: str) -> DataFrame:
    """Adds ``row``, a position from 0 for random access: ranges are ranked apart and shifted by the rows before them, so no one task sorts all.
    Nulls come first, as one range; rows that are equal in ``order`` follow each other in no stated order."""
    ranged = df.repartitionByRange(F.col(order)).withColumn("_p", F.when(F.col(order).isNull(), -1).otherwise(F.spark_partition_id()))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min(order).alias("_low"))
    by_low = W.orderBy(F.col("_low").asc_nulls_first())  # a row a partition
    before = counts.select("_low", (F.sum("_n").over(by_low) - F.col("_n")).alias("_before"), F.lead("_low").over(by_low).alias("_high"))
    inside = (F.col(order) >= F.col("_low")) & (F.col("_high").isNull() | (F.col(order) < F.col("_high")))
    joined = df.join(F.broadcast(before), inside | (F.col(order).isNull() & F.col("_low").isNull()))
    place = F.row_number().over(W.partitionBy("_low").orderBy(order)) - 1
    return joined.withColumn("row", F.col("_before") + place).drop("_low", "_before", "_high")


def matching(df: DataFrame, name: str, patterns: list[str]) -> DataFrame:
    """Rows whose name fits one of the shell patterns; on a partition column this prunes files."""
    return df.where(F.col(name).rlike("|".join(f"(?:{fnmatch.translate(p).replace(chr(92) + 'z', chr(92) + 'Z')})" for p in patterns)) if patterns else F.lit(True))


def json_arrays(spark: SparkSession, path: str, kind: str = "array<int>") -> DataFrame:
    """(path, tokens): a file with one JSON array each; null where it isn't one."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", kind).alias("tokens"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; those that aren't are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_folder(spark: SparkSession, path: str, schema: str | None = None, pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """One JSON value a file, plus ``source`` from its path."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("source", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def audio_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = (".wav", ".mp3", ".flac"), done: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(path, length) of audio files below a folder that aren't done; the first ``limit`` by path if given. Contents aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    df = df.where(F.lower("path").rlike("(" + "|".join(re.escape(e) for e in extensions) + ")$"))
    left = df if done is None else df.join(done.select("path"), "path", "left_anti")
    return left if limit is None else left.orderBy("path").limit(limit)


# --- archives ----------------------------------------------------------------------------------------------------------------------------------

#: Bytes and rows of a batch of members; one member that is longer is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 256


def opened(address: str):
    """A file of any storage that Arrow knows (local, S3, GCS, HDFS), opened for reads at any place."""
    from pyarrow import fs

    if address.startswith("file:"):
        address = "/" + address[5:].lstrip("/")
    if address.startswith("/"):
        return fs.LocalFileSystem().open_input_file(address)
    store, path = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", address))
    return store.open_input_file(path)


def read_range(address: str, offset: int, size: int) -> bytes:
    """Up to ``size`` bytes of a file from ``offset`` on."""
    with opened(address) as f:
        f.seek(offset)
        return f.read(size)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, length) of the files that a glob names; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "length")


class _Ranges(io.RawIOBase):
    """A file of known length over a function that reads ranges of it."""

    def __init__(self, fetch: Callable[[str, int, int], bytes], name: str, length: int):
        self.fetch, self.address, self.length, self.at = fetch, name, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.at, io.SEEK_END: self.length}[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        size = max(0, min(len(buffer), self.length - self.at))
        data = self.fetch(self.address, self.at, size) if size else b""
        buffer[: len(data)] = data
        self.at += len(data)
        return len(data)


def zip_directory(archives: DataFrame, fetch: Callable[[str, int, int], bytes] = read_range) -> DataFrame:
    """(archive, member, offset, compressed, size) of every member of the zip archives (archive, length): the central directories alone are read.
    A broken archive has no members and costs itself alone."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("compressed", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for name, length in zip(batch.column("archive").to_pylist(), batch.column("length").to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BufferedReader(_Ranges(fetch, name, length), 1 << 16)) as z:
                        found = [(name, i.filename, i.header_offset, i.compress_size, i.file_size) for i in z.infolist() if not i.is_dir()]
                except (zipfile.BadZipFile, EOFError, OSError):
                    found = []
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + 10_000]), schema, strict=True)], schema=schema)

    return archives.select("archive", "length").mapInArrow(run, "archive string, member string, offset bigint, compressed bigint, size bigint")


def zip_members(spark: SparkSession, path: str, wanted: DataFrame | None = None, fetch: Callable[[str, int, int], bytes] = read_range) -> DataFrame:
    """(archive, member, content) of the zip archives that a glob names; of ``wanted`` members, (member) or (archive, member), if given: only their
    ranges are read. Members that can't be read are left out, as broken archives are; ``missing_members`` counts what wasn't found."""
    listed = zip_directory(archives(spark, path), fetch)
    if wanted is not None:
        listed = listed.join(wanted, wanted.columns, "left_semi")
    return range_members(spark, listed, fetch).where(F.col("error").isNull()).drop("error")


def missing_members(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """One row: (wanted, missing), the members asked for and those of them that ``found`` doesn't have."""
    seen = found.select(*wanted.columns).distinct().withColumn("_seen", F.lit(True))
    return wanted.distinct().join(seen, wanted.columns, "left").agg(F.count("*").alias("wanted"), F.count_if(F.col("_seen").isNull()).alias("missing"))


def _batched(rows, schema):
    """Record batches of bounded bytes from an iterator of dicts with a ``content``."""
    import pyarrow as pa

    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row["content"] or b"")
        if held >= BATCH_BYTES or len(part) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, held = [], 0
    if part:
        yield pa.RecordBatch.from_pylist(part, schema)


def tar_members(spark: SparkSession, path: str, wanted: DataFrame | None = None, flat: bool = True) -> DataFrame:
    """(archive, member, content) of tar archives, compressed or not; names without folders if ``flat``. With ``wanted`` members, (member) or (archive,
    member), a first pass lists names and a second one reads those alone. Archives are streams: a task holds a member, not the archive; of a broken one the
    members before the damage count."""

    def walk(name: str, keep: set[str] | None, content: bool):
        try:
            with opened(name) as f, tarfile.open(fileobj=f, mode="r|*") as t:
                for m in t:
                    told = m.name.rpartition("/")[2] if flat else m.name
                    if m.isfile() and (keep is None or told in keep):
                        yield {"archive": name, "member": told, "content": t.extractfile(m).read() if content else None}
        except (tarfile.TarError, EOFError, zlib.error, OSError):
            return

    def reading(content: bool, chosen: bool):
        def run(batches):
            import pyarrow as pa

            schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary())])
            for batch in batches:
                names = batch.column("archive").to_pylist()
                keeps = [set(k) for k in batch.column("members").to_pylist()] if chosen else [None] * len(names)
                for name, keep in zip(names, keeps, strict=True):
                    yield from _batched(walk(name, keep, content), schema)

        return run

    kind, files = "archive string, member string, content binary", archives(spark, path).select("archive")
    if wanted is None:
        return files.mapInArrow(reading(True, False), kind)
    named = files.mapInArrow(reading(False, False), kind).select("archive", "member").join(wanted, wanted.columns, "left_semi")
    return named.groupBy("archive").agg(F.collect_set("member").alias("members")).mapInArrow(reading(True, True), kind)


def samples_of(members: DataFrame) -> DataFrame:
    """Tar members of one sample side by side: (archive, key, parts), parts by extension."""
    key, ext = F.regexp_extract("member", r"^([^.]*)\.", 1), F.regexp_extract("member", r"^[^.]*\.(.*)$", 1)
    return members.groupBy("archive", key.alias("key")).agg(F.map_from_entries(F.collect_list(F.struct(ext, "content"))).alias("parts"))


#: Signatures and methods of the zip format (fixed values).
LOCAL_HEADER, STORED, DEFLATED = b"PK\x03\x04", 0, 8


def zip_member(blob: bytes, compressed: int, size: int) -> bytes:
    """A member from a byte range that begins at its local header; both sizes, from the central directory, are checked."""
    if blob[:4] != LOCAL_HEADER:
        raise ValueError("no local header here")
    method = struct.unpack_from("<H", blob, 8)[0]
    name, extra = struct.unpack_from("<HH", blob, 26)
    data = blob[30 + name + extra :][:compressed]
    if len(data) != compressed:
        raise ValueError("the range is too short")
    if method not in (STORED, DEFLATED):
        raise ValueError(f"method {method} isn't supported")
    out = zlib.decompress(data, -15) if method == DEFLATED else data
    if len(out) != size:
        raise ValueError("the member has another size")
    return out


def range_members(spark: SparkSession, ranges: DataFrame, fetch: Callable[[str, int, int], bytes] = read_range) -> DataFrame:
    """(archive, member, content, error) of members named by (archive, member, offset, compressed, size), as ``zip_directory`` lists them;
    ``fetch(archive, offset, bytes)`` reads a range from wherever archives are. A failure is told in its row."""

    def read(r: dict) -> bytes:
        guess = 30 + len(r["member"].encode()) + 512 + r["compressed"]
        blob = fetch(r["archive"], r["offset"], guess)
        if len(blob) >= 30:
            need = 30 + sum(struct.unpack_from("<HH", blob, 26)) + r["compressed"]
            blob = blob if len(blob) >= need else fetch(r["archive"], r["offset"], need)  # long extra fields
        return zip_member(blob, r["compressed"], r["size"])

    def run(batches):
        import pyarrow as pa

        def told(r: dict) -> dict:
            try:
                return {"archive": r["archive"], "member": r["member"], "content": read(r), "error": None}
            except (ValueError, OSError, zlib.error, struct.error) as e:
                return {"archive": r["archive"], "member": r["member"], "content": None, "error": str(e)}

        schema = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])
        for batch in batches:
            yield from _batched((told(r) for r in batch.to_pylist()), schema)

    return ranges.mapInArrow(run, "archive string, member string, content binary, error string")


# --- token tensors -------------------------------------------------------------------------------------------------------------------------------

#: Storage classes of saved tensors, as struct formats (fixed values).
STORAGES = {"ByteStorage": "B", "CharStorage": "b", "ShortStorage": "h", "IntStorage": "i", "LongStorage": "q"}


def tensor_codes(raw: bytes, key: str = "codes") -> list[int]:
    """The integers of a saved tensor, or of that under ``key`` of a saved dict, flattened: a zip with a pickle and raw storages. The pickle may name
    nothing but tensors of whole numbers; anything else raises ``ValueError``."""
    import pickle

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        where = next((n for n in z.namelist() if n.endswith("/data.pkl") or n == "data.pkl"), None)
        if where is None:
            raise ValueError("no saved tensor")
        root = where[: -len("data.pkl")]

        def tensor(storage, offset, size, stride, *_):
            out = [offset]
            for n, step in zip(size, stride, strict=True):
                out = [i + k * step for i in out for k in range(n)]
            return [storage[i] for i in out]

        class Reader(pickle.Unpickler):
            def find_class(self, module, name):
                if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
                    return tensor
                if module == "torch" and name in STORAGES:
                    return STORAGES[name]
                if (module, name) == ("collections", "OrderedDict"):
                    return dict
                raise ValueError(f"{module}.{name} isn't part of a tensor of whole numbers")

            def persistent_load(self, told):
                _, kind, name, _, n = told
                return struct.unpack(f"<{n}{kind}", z.read(f"{root}data/{name}"))

        found = Reader(io.BytesIO(z.read(where))).load()
    return found[key] if isinstance(found, dict) else found


def tensors(df: DataFrame, content: str = "content", name: str = "tokens", key: str = "codes") -> DataFrame:
    """Adds the whole numbers of each saved tensor; null for files that hold none."""

    @F.pandas_udf("array<bigint>")
    def read(files: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return None if raw is None else tensor_codes(bytes(raw), key)
            except Exception:  # noqa: BLE001 - a pickle may fail in any way; the row says so by its null
                return None

        return files.map(one)

    return df.withColumn(name, read(F.col(content)))


# --- audio headers -------------------------------------------------------------------------------------------------------------------------------


def wav_header(head: bytes) -> tuple[int, int] | None:
    """(frames, rate) from a RIFF header; None if it is none."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, align, rate = 12, 0, 0
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head):
            rate, align = struct.unpack_from("<I", head, at + 12)[0], struct.unpack_from("<H", head, at + 20)[0]
        if name == b"data":
            return (size // align, rate) if align else None
        at += 8 + size + size % 2
    return None


def probe_wav(df: DataFrame, content: str = "content", head: int = 4096) -> DataFrame:
    """Adds ``frames`` and ``rate`` from the first bytes of each file; null where they tell nothing. Only these bytes go to Python."""
    @F.pandas_udf("struct<frames: bigint, rate: int>")
    def probe(heads: pd.Series) -> pd.DataFrame:
        found = [(None, None) if h is None else wav_header(bytes(h)) or (None, None) for h in heads]
        return pd.DataFrame(found, columns=["frames", "rate"]).astype({"frames": "Int64", "rate": "Int32"})

    return df.withColumn("_p", probe(F.substring(F.col(content), 1, head))).withColumn("frames", F.col("_p.frames")).withColumn("rate", F.col("_p.rate")).drop("_p")


# --- addresses -------------------------------------------------------------------------------------------------------------------------------------


def resolve(source: str, hub: str = "https://hub.example") -> tuple[str, dict[str, str]]:
    """("hub", repo, revision and path), ("url", ...) or ("local", ...) of an address; a listing of a folder raises."""
    m = re.match(rf"(?:hf://datasets/|{re.escape(hub)}/datasets/)([^/]+/[^/]+)/(?:(?:resolve|blob)/([^/]+)/)?(.+)$", source)
    if m:
        if m[3].startswith("tree/"):
            raise ValueError("a folder's listing isn't a file")
        return "hub", {"repo": m[1], "revision": m[2] or "main", "path": m[3]}
    if source.startswith(("hf://", hub)):
        raise ValueError(f"not the address of a dataset's file: {source}")
    return ("url", {"url": source}) if re.match(r"https?://", source) else ("local", {"path": source})


def retry(call: Callable[[], object], waits: tuple[float, ...] = (30, 60, 90, 120), attempts: int = 10, sleep: Callable[[float], None] | None = None) -> object:
    """``call()``, again after each failure with growing waits; the last failure is raised."""
    import time

    for k in range(attempts):
        try:
            return call()
        except Exception:
            if k + 1 == attempts:
                raise
            (sleep or time.sleep)(waits[min(k, len(waits) - 1)])
    raise ValueError("no attempts")


def parse_json(text: str) -> object:
    """A JSON value, or None."""
    try:
        return json.loads(text)
    except ValueError:
        return None
