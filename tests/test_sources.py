import io
import json
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom import streaming
from corpusloom.functions import registry
from corpusloom.session import reachable
from corpusloom.sources import readers, writers


def wav(frames, rate=8000, extra=b""):
    data = b"\0\0" * frames
    body = b"WAVE" + extra + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_archives(spark, tmp_path):
    reachable(spark)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/1.json", "[1]")
        z.writestr("x/2.json", "[2]")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    got = readers.zip_members(spark, f"{tmp_path}/*.zip")
    assert sorted(r["member"] for r in got.collect()) == ["x/1.json", "x/2.json"]
    wanted = spark.createDataFrame([("x/2.json",)], "member string")
    assert [bytes(r["content"]) for r in readers.zip_members(spark, f"{tmp_path}/*.zip", wanted).collect()] == [b"[2]"]
    asked = spark.createDataFrame([("x/2.json",), ("x/9.json",)], "member string")
    assert readers.missing_members(asked, readers.zip_members(spark, f"{tmp_path}/*.zip", asked)).first().asDict() == {"wanted": 2, "missing": 1}
    read = []

    def fetch(archive, offset, size):
        read.append((offset, size))
        return readers.read_range(archive, offset, size)

    with zipfile.ZipFile(io.BufferedReader(readers._Ranges(fetch, f"{tmp_path}/a.zip", (tmp_path / "a.zip").stat().st_size), 64)) as z:
        assert z.namelist() == ["x/1.json", "x/2.json"] and read
    with tarfile.open(tmp_path / "b.tar.gz", "w:gz") as t:
        for name in ("d/k1.txt", "d/k1.wav", "d/k2.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    samples = readers.samples_of(readers.tar_members(spark, f"{tmp_path}/*.tar.gz"))
    assert {r["key"]: sorted(r["parts"]) for r in samples.collect()} == {"k1": ["txt", "wav"], "k2": ["txt"]}
    (tmp_path / "cut.tar.gz").write_bytes((tmp_path / "b.tar.gz").read_bytes()[:40])
    one = readers.tar_members(spark, f"{tmp_path}/*.tar.gz", spark.createDataFrame([("k2.txt",), ("gone",)], "member string"))
    assert [(r["member"], bytes(r["content"])) for r in one.collect()] == [("k2.txt", b"hi")]
    assert readers.tar_members(spark, f"{tmp_path}/b.tar.gz", flat=False).where("member = 'd/k1.wav'").count() == 1


def saved_tensor(values, root="x/"):
    """A saved ``{"codes": IntTensor[1, 1, n]}``, written by hand."""
    n = len(values)
    text = lambda s: b"X" + struct.pack("<I", len(s)) + s.encode()
    number = lambda i: b"J" + struct.pack("<i", i)
    storage = b"(" + text("storage") + b"ctorch\nIntStorage\n" + text("0") + text("cpu") + number(n) + b"tQ"
    shape = b"(" + number(1) + number(1) + number(n) + b"t"
    tensor = b"ctorch._utils\n_rebuild_tensor_v2\n(" + storage + number(0) + shape + b"(" + number(n) + number(n) + number(1) + b"t" + b"\x89" + b"ccollections\nOrderedDict\n)R" + b"tR"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(f"{root}data.pkl", b"\x80\x02}" + text("codes") + tensor + b"s.")
        z.writestr(f"{root}data/0", struct.pack(f"<{n}i", *values))
    return out.getvalue()


def test_saved_tensors(spark):
    assert readers.tensor_codes(saved_tensor([5, 6, 70000])) == [5, 6, 70000]
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("x/data.pkl", b"cos\nsystem\n(X\x04\x00\x00\x00exittR.")
    with pytest.raises(ValueError):
        readers.tensor_codes(bad.getvalue())
    df = spark.createDataFrame([(1, saved_tensor([1, 2])), (2, b"noise"), (3, None), (4, saved_tensor([]))], "i int, content binary")
    assert [r["tokens"] for r in readers.tensors(df).orderBy("i").collect()] == [[1, 2], None, None, []]


def test_member_ranges(spark, tmp_path):
    path = tmp_path / "r.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", "hello " * 50)
    info = zipfile.ZipFile(path).getinfo("m")
    raw = path.read_bytes()[info.header_offset :]
    assert readers.zip_member(raw, info.compress_size, info.file_size) == b"hello " * 50
    with pytest.raises(ValueError):
        readers.zip_member(raw, info.compress_size, 3)
    with pytest.raises((ValueError, zlib.error)):
        readers.zip_member(raw[:40], info.compress_size, info.file_size)
    ranges = spark.createDataFrame([(str(path), "m", info.header_offset, info.compress_size, info.file_size), (str(path), "bad", 7, 3, 3)], "archive string, member string, offset bigint, compressed bigint, size bigint")

    def fetch(archive, offset, size):
        with open(archive, "rb") as f:
            f.seek(offset)
            return f.read(size)

    got = {r["member"]: r for r in readers.range_members(spark, ranges, fetch).collect()}
    assert bytes(got["m"]["content"]) == b"hello " * 50 and got["bad"]["error"]


def test_audio_headers(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(8000))
    (tmp_path / "b.wav").write_bytes(b"noise")
    assert readers.wav_header(wav(5, 16000, b"LIST" + struct.pack("<I", 4) + b"abcd")) == (5, 16000)
    df = readers.probe_wav(spark.read.format("binaryFile").load(f"{tmp_path}/*.wav"))
    assert sorted((r["path"][-5:], r["frames"], r["rate"]) for r in df.collect()) == [("a.wav", 8000, 8000), ("b.wav", None, None)]
    done = spark.read.format("binaryFile").load(f"{tmp_path}/a.wav").select("path")
    assert [r["path"][-5:] for r in readers.audio_files(spark, str(tmp_path), done=done).collect()] == ["b.wav"]
    assert [r["path"][-5:] for r in readers.audio_files(spark, str(tmp_path), limit=1).collect()] == ["a.wav"]


def test_json(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.json").write_text("[1, 2]")
    (tmp_path / "t" / "2.json").write_text("nothing")
    assert sorted(str(r["tokens"]) for r in readers.json_arrays(spark, f"{tmp_path}/t").collect()) == ["None", "[1, 2]"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert readers.json_lines(spark, f"{tmp_path}/l.jsonl", "a int").agg(F.sum("a")).first()[0] == 3
    (tmp_path / "src9").mkdir()
    (tmp_path / "src9" / "x.json").write_text(json.dumps({"b": 5}))
    assert readers.json_folder(spark, f"{tmp_path}/src9", "b int").first().asDict() == {"b": 5, "source": "src9"}


def test_tables(spark, tmp_path):
    df = spark.range(100).withColumn("name", F.concat(F.lit("n"), (F.col("id") % 4).cast("string")))
    assert [r["row"] for r in readers.indexed(df, "id").orderBy("id").collect()] == list(range(100))
    holes = spark.createDataFrame([(None,), (3,), (None,), (1,), (3,)], "id int")
    assert sorted((r["id"] or 0, r["row"]) for r in readers.indexed(holes, "id").collect()) == [(0, 0), (0, 1), (1, 2), (3, 3), (3, 4)]
    first, total = readers.head(df, 3, "id")
    assert [r["id"] for r in first.orderBy("id").collect()] == [0, 1, 2] and total.first()["rows"] == 100
    assert readers.matching(df, "name", ["n[01]"]).count() == 50
    assert readers.with_fallbacks(df, {"text": ["nope", "name"], "gone": ["x"]}).first()["text"].startswith("n")
    assert readers.with_fallbacks(df, {}, ("audio",)).count() == 0
    assert {tuple(r) for r in readers.first_per_file(df, "name", "id", "id").collect()} == {(f"n{i}", i) for i in range(4)}
    assert writers.reshard(df, f"{tmp_path}/s", 30) and not writers.reshard(df, f"{tmp_path}/s", 30)
    assert writers.append_new(df.where("id < 10"), f"{tmp_path}/j", ["id"]) == 10
    assert writers.append_new(df.where("id < 15"), f"{tmp_path}/j", ["id"]) == 5
    blocks = spark.createDataFrame([([1, 2],), ([1, 2],), ([3],)], "input_ids array<int>")
    writers.write_blocks(blocks.coalesce(1), f"{tmp_path}/blocks", block=10, most=500)
    written = spark.read.parquet(f"{tmp_path}/blocks")
    assert written.select("sha1", "hash").distinct().count() == 2 and written.select("_metadata.file_path").distinct().count() == 2
    writers.write_groups(df, f"{tmp_path}/g", "name")
    assert spark.read.parquet(f"{tmp_path}/g").where("name = 'n1'").count() == 25
    writers.write_ordered(df, f"{tmp_path}/o", {"twice": (1, F.col("id") * 2)}, {"twice": {"note": "x"}})
    assert spark.read.parquet(f"{tmp_path}/o").columns == ["id", "twice", "name"]
    assert writers.verified_copy(df, df.where("id > 0"), "id", "id").first()["missing"] == 1
    assert "config_name: n0" in writers.card(writers.card_config(df, "name"), "name")
    assert writers.empty(spark, "a int").count() == 0


def test_caches_and_concatenation(spark, tmp_path):
    df, calls = spark.range(10).withColumn("v", F.col("id") * 2), []

    def compute(todo):
        calls.append(sorted(r["id"] for r in todo.collect()))
        return todo

    assert writers.cached(df.where("id < 4"), f"{tmp_path}/c", ["id"], compute).count() == 4
    assert writers.cached(df, f"{tmp_path}/c", ["id"], compute).count() == 10
    assert calls == [[0, 1, 2, 3], [4, 5, 6, 7, 8, 9]]
    writers.concatenate(f"{tmp_path}/all", df, df.where("id > 7"))
    assert spark.read.parquet(f"{tmp_path}/all").count() == 12
    writers.write_summary(df.agg(F.count("*").alias("n")), f"{tmp_path}/summary")
    assert spark.read.json(f"{tmp_path}/summary").first()["n"] == 10


def test_extension_points(spark):
    reachable(spark)
    assert registry.tasks("all") == ("tts", "stt", "mel") and registry.tasks("tts") == ("tts",)
    longer = registry.model_column(lambda: 5, lambda model, batch: batch + model, "bigint")
    assert [r[0] for r in spark.range(3).select(longer(F.col("id"))).collect()] == [5, 6, 7]
    assert spark.createDataFrame([("a b c",), (None,)], "t string").select(registry.word_tokens(F.col("t"), 2)).collect() == [(5,), (2,)]
    registry.register(spark)
    assert spark.sql("SELECT dominant_script('abc') AS s, normalize_text('hello  there my friend') AS t").first()["s"] == "LATIN"


def test_addresses():
    assert readers.resolve("https://hub.example/datasets/u/d/resolve/v1/a/b.parquet") == ("hub", {"repo": "u/d", "revision": "v1", "path": "a/b.parquet"})
    assert readers.resolve("hf://datasets/u/d/a.parquet")[1]["revision"] == "main"
    assert readers.resolve("https://else.example/x")[0] == "url" and readers.resolve("/x/y")[0] == "local"
    with pytest.raises(ValueError):
        readers.resolve("https://hub.example/datasets/u/d/tree/main")
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert readers.retry(fails, sleep=waits.append) == 7 and waits == [30, 60]
    calls.clear(), waits.clear()
    assert writers.publish(lambda: None, fails, sleep=waits.append) == 7 and waits == [300, 300]


# --- streams ----------------------------------------------------------------------------------------------------------------------------


@pytest.fixture
def folder(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events")
    return tmp_path


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "by_session"])
def test_stream_equals_batch(spark, folder, kind):
    f = getattr(streaming, kind)
    batch = f(spark.read.parquet(f"{folder}/events"), ["event_type"])
    got = streaming.collected(f(streaming.events(spark, f"{folder}/events", 1), ["event_type"], delay="60 days"), f"m_{kind}", f"{folder}/c_{kind}", "complete" if kind != "by_session" else "append")
    if kind == "by_session":
        assert got.join(batch, batch.columns, "left_anti").count() == 0  # what is final before the watermark
    else:
        assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_incremental(spark, folder):
    reachable(spark)
    for _ in range(2):
        streaming.run_available(streaming.events(spark, f"{folder}/events"), f"{folder}/out", f"{folder}/ck")
    n = spark.read.parquet(f"{folder}/events").count()
    assert spark.read.parquet(f"{folder}/out").count() == n
    seen = []
    streaming.run_batches(streaming.events(spark, f"{folder}/events", 1), lambda df, k: seen.append(df.count()), f"{folder}/ck2")
    assert len(seen) == 3 and sum(seen) == n
    docs = spark.range(50).select((F.col("id") % 2).alias("k"), "id", F.lit(3).cast("long").alias("n"))
    docs.write.parquet(f"{folder}/docs")
    packed = streaming.packed(streaming.events(spark, f"{folder}/docs"), "k", "id", "n", 10)
    got = streaming.collected(packed, "packed", f"{folder}/ck3")
    assert got.groupBy("k", "block").count().agg(F.max("count")).first()[0] == 3 and got.count() == 50
