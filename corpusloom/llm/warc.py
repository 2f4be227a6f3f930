"""WARC archives: a writer of revisit-aware records and a sequential reader that verifies them.

Every record is a gzip member of its own. The reader inflates a stream piece by piece, frames records by Content-Length and checks the block and
payload digests, holding one record and one piece at a time.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import base

#: Compressed bytes after which a task goes on in a new archive; bytes that the reader takes from a stream at once.
ARCHIVE_BYTES, PIECE = 64 << 20, 1 << 16
#: Groups of equal payloads up to which the decisions are broadcast, after counting them.
GROUPS = 200_000
#: Fixed values of the format.
VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:corpusloom:page:"

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType()), T.StructField("valid", T.BooleanType()),
])


def store_of(uri: str):
    """(file system, path) of a URI as executors open it from Python: local, HDFS, S3 or GCS paths."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


class WarcError(ValueError):
    """A stream that isn't framed as WARC."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit has the HTTP head alone as its block; the digest is that of the payload it stands for."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if uri is not None:
        head.append(("WARC-Target-URI", "".join(uri.split("\r")).replace("\n", "")))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def members(stream) -> Iterator[bytes]:
    """The inflated gzip members of a stream, one after the other; a stream that ends inside one raises."""
    rest = b""
    while True:
        data = rest or stream.read(PIECE)
        if not data:
            return
        inflate, out = zlib.decompressobj(31), []
        try:
            while True:
                out.append(inflate.decompress(data))
                if inflate.eof:
                    break
                data = stream.read(PIECE)
                if not data:
                    raise WarcError("the stream ends inside a gzip member")
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from e
        rest = inflate.unused_data
        yield b"".join(out)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of a record; framing by Content-Length."""
    head, mark, body = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise WarcError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
    try:
        size = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise WarcError("no Content-Length") from e
    if len(body) < size or body[size : size + 4] != b"\r\n\r\n":
        raise WarcError("Content-Length doesn't frame the record")
    return fields, body[:size]


def read(stream) -> Iterator[dict]:
    """The records of a stream. ``valid``: the block digest holds, and for a response the payload digest as well."""
    bare = lambda x: x.removeprefix("<").removesuffix(">") if x is not None else None
    for raw in members(stream):
        fields, block = parse(raw)
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        _, _, payload = block.partition(b"\r\n\r\n")
        told = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        valid = fields.get("warc-block-digest", "").removeprefix("sha1:") == digest(block) and (kind == "revisit" or digest(payload) == told)
        whole = payload if kind == "response" else None
        yield {
            "record_id": bare(fields.get("warc-record-id")), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "payload_digest": told,
            "refers_to": bare(fields.get("warc-refers-to")), "payload_bytes": len(payload) if kind == "response" else None, "payload": whole, "valid": valid,
        }


def write_archives(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row into ``.warc.gz`` archives under ``folder`` (a URI that executors can write) and return their table: path, records, bytes.

    The payload is the html in UTF-8, null being empty. Of records with equal payloads of ``least_bytes`` or more the one with the largest
    key is a response and the others revisit it (rows that repeat this key are all responses); all others are responses. A null key is smaller
    than any other and written as "null". Only (digest, key) are shuffled, combined first; a payload never is.

    An archive's name holds an id of its own, so a task that is run again writes new files; the table, itself written once, names those of
    the attempts that counted.
    """
    if folder.startswith("file:/") and not folder.startswith("file:///"):
        folder = "file:///" + folder.removeprefix("file:").lstrip("/")
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{url}`").alias("url"), body.alias("html"))
    sizes = rows.select("key", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("size"))
    groups = sizes.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("key").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null")
    groups = base.save(groups.select(F.col("sha").alias("_sha"), F.col("size").alias("_size"), "kept"), "payloads")
    marked = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    joined = marked.join(base.small(groups, GROUPS), (F.col("sha") == F.col("_sha")) & (F.octet_length("html") == F.col("_size")), "left")
    joined = joined.select("key", "url", "html", "sha", F.when(~F.col("kept").eqNullSafe(F.col("key")), F.col("kept")).alias("refers"))

    def write(batches):
        import pyarrow as pa

        out, told = None, []

        def close():
            nonlocal out
            if out:
                out.close()
                out = None

        def name(k):
            return RECORD_ID + ("null" if k is None else str(k))

        for batch in batches:
            for row in batch.to_pylist():
                payload = row["html"].encode()
                to = row["refers"]
                raw = record("response" if to is None else "revisit", name(row["key"]), row["url"], payload, base64.b32encode(bytes.fromhex(row["sha"])).decode(), None if to is None else name(to))
                if out is None:
                    store, path = store_of(folder)
                    store.create_dir(path, recursive=True)
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{path}/{file}", compression=None)
                    told.append([f"{folder}/{file}", 0, 0])
                out.write(raw)
                told[-1][1] += 1
                told[-1][2] += len(raw)
                if told[-1][2] >= archive_bytes:
                    close()
        close()
        if told:
            yield pa.RecordBatch.from_arrays([pa.array([t[0] for t in told]), pa.array([t[1] for t in told], pa.int64()), pa.array([t[2] for t in told], pa.int64())], names=["path", "records", "bytes"])

    base.reachable(pages.sparkSession)
    return base.save(joined.mapInArrow(write, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """The records of the archives named in column ``path``, one task an archive where there are as many; streams are read sequentially.

    A broken archive raises, a wrong digest makes ``valid`` false. Without ``payloads`` they are verified but not returned. No
    path and an empty archive give no record; other columns don't matter.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("valid", pa.bool_())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = store_of(path)
                with store.open_input_stream(place, compression=None) as stream:
                    held, size = [], 0
                    for r in read(stream):
                        size += len(r["payload"] or b"")
                        held.append(r if payloads else r | {"payload": None})
                        if len(held) >= 1000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, kind)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, kind)

    base.reachable(archives.sparkSession)
    named = archives.where("path is not null").select("path")
    n = max(1, min(named.count(), 20_000))
    return named.repartition(n, "path").mapInArrow(run, RECORD)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the payload bytes of the response it refers to; ``valid`` then needs that response, valid and with the same digest.

    Responses that share an id (rows that repeat a key) count once. Only headers are joined, payloads stay out.
    """
    heads = records.drop("payload")
    seen = heads.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("_bytes"), F.min("valid").alias("_valid"))
    again = heads.where("record_type = 'revisit'").join(seen, ["refers_to", "payload_digest"], "left")
    again = again.withColumns({"payload_bytes": F.col("_bytes"), "valid": F.col("valid") & F.coalesce("_valid", F.lit(False))}).drop("_bytes", "_valid")
    return heads.where("record_type = 'response'").unionByName(again)
