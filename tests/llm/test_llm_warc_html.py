import base64
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import base, htmltext, warc


def test_records_round_trip():
    raw = warc.record("response", "urn:x:1", "http://a/b\r\nEvil: 1", b"<p>\r\n\r\nhi</p>", warc.digest(b"<p>\r\n\r\nhi</p>"), None)
    raw += warc.record("revisit", "urn:x:2", None, b"ignored", warc.digest(b"<p>\r\n\r\nhi</p>"), "urn:x:1")
    a, b = warc.read(io.BytesIO(raw))
    assert (a["record_type"], a["payload"], a["valid"], a["target_uri"]) == ("response", b"<p>\r\n\r\nhi</p>", True, "http://a/bEvil: 1")
    assert (b["record_type"], b["refers_to"], b["payload"], b["valid"]) == ("revisit", "urn:x:1", None, True)


def test_one_gzip_member_a_record():
    raw = b"".join(warc.record("response", f"urn:x:{i}", "u", b"x" * i, warc.digest(b"x" * i), None) for i in range(300))
    sizes = [len(r["payload"]) for r in warc.read(io.BytesIO(raw))]
    assert sizes == list(range(300))
    first = zlib.decompressobj(31)
    first.decompress(raw)
    assert first.eof and first.unused_data


def test_damage_is_seen():
    good = warc.record("response", "urn:x:1", "u", b"payload", warc.digest(b"payload"), None)
    assert not next(warc.read(io.BytesIO(warc.record("response", "urn:x:1", "u", b"payload", warc.digest(b"other"), None))))["valid"]
    for bad in (good[:-9], b"not gzip at all", good + b"tail"):
        with pytest.raises(warc.WarcError):
            list(warc.read(io.BytesIO(bad)))
    short = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(warc.WarcError):
        list(warc.read(io.BytesIO(short.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx\r\n\r\n") + short.flush())))


@pytest.mark.parametrize("archive_bytes", [1 << 20, 500])
def test_archives(spark, archive_bytes):
    big = "".join(chr(97 + i % 26) for i in range(300_000))
    rows = [(1, "u1", "same"), (2, "u2", "same"), (5, None, "same"), (3, "u3", None), (4, "u4", ""), (6, "u6", "é" * 10), (7, "u7", big), (None, "u8", "same"), (6, "u6", "é" * 10)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    archives = warc.write_archives(pages, base.scratch_path(spark, "warc"), archive_bytes=archive_bytes)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    records = warc.read_archives(archives)
    assert records.where("not valid").count() == 0
    got = {}
    for r in warc.resolve_revisits(records).collect():
        got.setdefault(r["record_id"].rpartition(":")[2], []).append((r["record_type"], r["payload_bytes"], r["refers_to"] and r["refers_to"].rpartition(":")[2], r["payload_digest"], r["valid"]))

    def told(kind, text, to=None):
        b = text.encode()
        return (kind, len(b), to, base64.b32encode(hashlib.sha1(b).digest()).decode(), True)

    assert got == {
        "1": [told("revisit", "same", "5")], "2": [told("revisit", "same", "5")], "5": [told("response", "same")], "null": [told("revisit", "same", "5")],
        "3": [told("revisit", "", "4")], "4": [told("response", "")], "6": [told("response", "é" * 10)] * 2, "7": [told("response", big)],
    }
    payload = records.where("record_id like '%:7'").first()["payload"]
    assert bytes(payload).decode() == big


def test_small_payloads_are_not_revisited(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(pages, base.scratch_path(spark, "warc"), least_bytes=5), payloads=False)
    kinds = {r["record_id"][-1]: (r["record_type"], r["payload"]) for r in records.collect()}
    assert {k: v for k, (v, _) in kinds.items()} == {"1": "response", "2": "response", "3": "revisit", "4": "response"}
    assert all(p is None for _, p in kinds.values())
    assert warc.read_archives(warc.write_archives(pages.limit(0), base.scratch_path(spark, "warc"))).count() == 0


# --- pages ----------------------------------------------------------------------------------------------------------------------------


def text(page):
    return htmltext.default_field().main_text(page)


def test_held_out_accuracy():
    field, wrong, n = htmltext.default_field(), 0, 0
    for page, labels in htmltext.labelled_pages(250, seed=99):
        blocks = htmltext.leaf_blocks(page)
        assert len(blocks) == len(labels)
        wrong += sum(a != b for a, b in zip(field.decode(blocks), labels))
        n += len(labels)
    assert wrong / n < 0.01


def brute_path(field, blocks):
    """The best labels by trying all."""
    import itertools

    best = max(itertools.product((0, 1), repeat=len(blocks)), key=lambda ys: sum(field.moves[a, b] for a, b in zip((0, *ys), ys)) + sum(field.favour(x) for x, y in zip(blocks, ys) if y))
    return list(best)


def test_viterbi_is_the_best_path():
    field = htmltext.default_field()
    for page, _ in htmltext.labelled_pages(40, seed=5):
        blocks = htmltext.leaf_blocks(page)[:11]
        assert field.decode(blocks) == brute_path(field, blocks)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><div class="cookie-notice">We use cookies. <a href=x>Accept</a></div>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><article><h1>Head&amp;line</h1><p>One&nbsp;two   <b>thr</b>ee.<br>Four &lt;five&gt;
<p>Six, <a href="x">seven</a> eight.</p><aside class="related"><a href=r>Read more</a></aside><p>Ok.</p><section class="comments"><p>First! Nice post.</p><p>I agree with it.</p></section></article>
<form class="newsletter"><p>Sign up now.</p></form><footer>&copy; 2024 Someone. All rights reserved.</footer></body>"""


def test_page_parts():
    assert text(PAGE) == "Head&line One two three. Four <five> Six, seven eight. Ok."


@pytest.mark.parametrize("page, expected", [
    ("", ""), ("   ", ""), ("<script>x</script>", ""), ("<article>a<b>b</b>c</article>", "abc"), ("<article><p>x<!-- <p>y</p> -->z</p></article>", "xz"),
    ("<article><p>a < b and c > d</p></article>", "a < b and c > d"), ("<article><p title='x>y'>q</p></article>", "q"), ("<article><p>open", "open"),
    ("<article><p>a</p><style>p{}</style><p>b&#233;&eacute;</p>", "a béé"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
])
def test_small_pages(page, expected):
    assert text(page) == expected


def test_long_pages_stay_whole():
    body = "".join(f"<p>word{i} and more.</p>" for i in range(20_000))
    assert text(f"<article>{body}</article>") == " ".join(f"word{i} and more." for i in range(20_000))
    assert text("<article><p>" + "<" * 50_000).count("<") == 50_000


def test_nested_pages_take_memory_and_time_by_length():
    import time
    import tracemalloc

    pages = ["<div class='a b'>" * 60_000 + "<p>Deep text.", "<article>" + "<b><i>" * 100_000 + "x" + "</u></section>" * 50_000, "<li><b>" * 100_000 + "<li>y"]
    for page in pages:
        tracemalloc.start()
        began = time.perf_counter()
        blocks = htmltext.leaf_blocks(page)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert blocks and htmltext.default_field().decode(blocks) and peak < 300e6 and time.perf_counter() - began < 60


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (1, "u", PAGE, "old")], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract(df).collect()), key=str)
    assert got == [(1, text(PAGE), len(text(PAGE)))] * 2 + [(2, "", 0)]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_articles_of_the_tables():
    """The text of every page's article element, found by pattern."""
    import html
    import re

    import duckdb

    def article(page):
        body = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in re.split(r"</?(?:p|br|h1)>", body)]
        return " ".join(p for p in parts if p)

    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        assert text(page) == article(page)
