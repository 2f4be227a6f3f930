"""Benchmark decontamination: a broadcast set of normalised test windows, scanned for in every text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import base, kernel

#: Bytes of benchmark text whose windows are broadcast at once, about six times as many in an index; a larger benchmark is scanned for in blocks of this size.
BLOCK_BYTES = 8 << 20
#: Blocks that one plan scans for before its rows are written.
BLOCKS_AT_ONCE = 4

RANGE = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def _packed(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, lower-cased, a space after each, and where each begins: a run of words is one slice of them."""
    size = w.end - w.start
    begin = np.append(0, np.cumsum(size + 1))
    out = np.full(begin[-1], 32, np.uint8)
    at = np.ones(int(size.sum()), np.int64)
    if len(size):
        at[0] = w.start[0]
        at[np.cumsum(size)[:-1]] = w.start[1:] - w.end[:-1] + 1
        at = np.cumsum(at)
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    out[inside] = w.codes[at] - 1
    return out, begin


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Which slices of ``size`` bytes at ``at`` in ``a`` and at ``bt`` in ``b`` are equal."""
    out = np.empty(len(at), bool)
    upto = np.append(0, np.cumsum(size))
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, side="right")) - 1)
        step = np.arange(upto[j] - upto[i]) - np.repeat(upto[i:j] - upto[i], size[i:j])
        differs = a[np.repeat(at[i:j], size[i:j]) + step] != b[np.repeat(bt[i:j], size[i:j]) + step]
        out[i:j] = np.add.reduceat(differs, upto[i:j] - upto[i], dtype=np.int64) == 0
        i = j
    return out


class WindowSet:
    """Windows of ``n`` words (an item of fewer words is one window), by length and hash, with the items that hold them.

    Windows are slices of one buffer, the items' words. Two windows of one hash are in layers of their own.
    """

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        items = sorted(items, key=lambda x: x[0].encode())
        self.items = list(dict.fromkeys(x[0] for x in items))
        number = {x: i for i, x in enumerate(self.items)}
        data, found, size_so_far = [np.empty(0, np.uint8)], {}, 0
        for first, texts in kernel.chunks([x[1] for x in items]):
            w = kernel.Words(texts, kernel.ALNUM)
            packed, begin = _packed(w)
            hashes, item = w.hashes(), np.array([number[x[0]] for x in items[first : first + len(texts)]], np.int32)
            for size in {n, *w.count[(w.count > 0) & (w.count < n)].tolist()}:
                at, h = w.runs(size, hashes)
                if size < n:
                    whole = w.count[w.doc[at]] == size
                    at, h = at[whole], h[whole]
                found.setdefault(size, []).append((h, begin[at] + size_so_far, (begin[at + size] - begin[at]).astype(np.int32), item[w.doc[at]]))
            data.append(packed)
            size_so_far += len(packed)
        self.data, self.layers = np.concatenate(data), []
        for size in sorted(found):
            h, start, span, item = (np.concatenate(x) for x in zip(*found.pop(size), strict=True))
            while len(h):
                order = np.argsort(h, kind="stable")
                h, start, span, item = h[order], start[order], span[order], item[order]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                key = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                lead = first[key]
                same = span == span[lead]
                same[same] = _same(self.data, start[lead[same]], self.data, start[same], span[same])
                window, owner = np.divmod(np.unique(key[same] * np.int64(len(self.items)) + item[same]), len(self.items))
                edge = np.searchsorted(window, np.arange(len(first) + 1))
                self.layers.append((size, h[first], start[first], span[first], edge, owner.astype(np.int32)))
                h, start, span, item = h[~same], start[~same], span[~same], item[~same]

    def scan(self, w: kernel.Words) -> list[tuple[list[list[int]], list[str]]]:
        """For each text: the word ranges [first, last] that windows cover, merged, and the items in order."""
        hashes = w.hashes()
        cover = np.zeros(len(hashes) + 1, np.int32)
        owned, packed = [], None
        for size, keys, start, span, edge, owner in self.layers:
            at, h = w.runs(size, hashes)
            if not len(at):
                continue
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            same = keys[place] == h
            at, place = at[same], place[same]
            if not len(at):
                continue
            packed = packed or _packed(w)
            data, begin = packed
            same = begin[at + size] - begin[at] == span[place]
            at, place = at[same], place[same]
            same = _same(data, begin[at], self.data, start[place], span[place])
            at, place = at[same], place[same]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + size, -1)
            doc, window = np.divmod(np.unique(w.doc[at] * np.int64(len(keys)) + place), len(keys))
            each = edge[window + 1] - edge[window]
            upto = np.cumsum(each) - each
            owned.append(np.repeat(doc, each) * np.int64(len(self.items)) + owner[np.repeat(edge[window] - upto, each) + np.arange(each.sum())])
        out: list[tuple[list[list[int]], list[str]]] = [([], []) for _ in w.texts]
        if owned:
            for d, i in zip(*(x.tolist() for x in np.divmod(np.unique(np.concatenate(owned)), len(self.items))), strict=True):
                out[d][1].append(self.items[i])
            inside = np.cumsum(cover[:-1]) > 0
            fresh = inside & (~np.roll(inside, 1) | (np.arange(len(inside)) == 0) | (np.append(-1, w.doc[:-1]) != w.doc))
            starts = np.flatnonzero(fresh)
            run = np.cumsum(fresh) - 1
            lengths = np.bincount(run[inside], minlength=len(starts))
            for s, k in zip(starts, lengths, strict=True):
                d = w.doc[s]
                out[d][0].append([int(s - w.first[d]), int(s - w.first[d] + k - 1)])
        return out


def merge_ranges(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 13, percent: int = 5, cut: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark the words of each document that lie in an occurrence of a benchmark window.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A window is ``n`` consecutive
    words of an item; an item of fewer words is one window. Hash hits are verified against the words themselves.

    Adds ``n_words``, ``hit_ranges`` (word ranges [first, last], merged), ``n_hit``, ``item_ids`` (sorted strings),
    ``n_items`` and ``contaminated`` (n_hit > 0 and n_hit at least ``percent`` per cent of n_words); a column of ``docs``
    with such a name is replaced. With ``cut``, ``text`` loses the hit words as ``remove_spans`` has it, in the same pass. Null and empty texts have no words and are clean. A null item id counts as the item
    "null", an item with a null text has no windows, repeated rows are marked alike, empty tables give empty or clean results.

    The benchmark's size is measured first. Up to ``block_bytes`` of it are broadcast; more is scanned for block by block,
    ranges and items being merged, so no size of benchmark is too large for an executor.
    """
    spark = docs.sparkSession
    tests = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"), F.col(f"`{item_text}`").alias("t")).where("t is not null")
    size = tests.agg(F.sum(F.octet_length("t") + F.octet_length("item") + 16)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("hit_ranges", RANGE), T.StructField("item_ids", T.ArrayType(T.StringType()))]
    for b in range(blocks):
        part = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item", "t"), F.lit(blocks)) == b)
        got = part.toArrow()
        shared = spark.sparkContext.broadcast(WindowSet(list(zip(got.column("item").to_pylist(), kernel.as_bytes(got.column("t")), strict=True)), n))
        last = cut and b + 1 == blocks
        docs = base.append_columns(docs, [*fields, *([T.StructField(text, T.StringType())] if last else [])], _scanner(shared, text, merge=b > 0, cut=last))
        if b % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1 and b + 1 < blocks:
            docs = base.save(docs, "decontaminate")
    hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    return docs.withColumns({"n_hit": hit, "n_items": F.size("item_ids").cast("long")}).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent))


def _without(w: kernel.Words, k: int, ranges) -> str:
    """Text ``k`` of the chunk without the words of the ranges."""
    body, keep, at = w.texts[k], [], 0
    for a, z in ranges:
        keep.append(body[at : w.start[w.first[k] + a] - w.begin[k]])
        at = w.end[w.first[k] + z] - w.begin[k]
    return b"".join([*keep, body[at:]]).decode()


def _scanner(shared, text: str, merge: bool, cut: bool = False):
    def start():
        import pyarrow as pa

        windows: WindowSet = shared.value
        kinds = [pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.list_(pa.string())]

        def work(batch):
            counts, ranges, items, kept = [], [], [], []
            before = list(zip(batch.column("hit_ranges").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)) if merge else []
            for at, texts in kernel.chunks(kernel.as_bytes(batch.column(text))):
                w = kernel.Words(texts, kernel.ALNUM)
                counts += w.count.tolist()
                for k, (r, s) in enumerate(windows.scan(w)):
                    if merge:
                        r = merge_ranges(r + [[x["first"], x["last"]] for x in before[at + k][0]])
                        s = sorted({*s, *before[at + k][1]}, key=str.encode)
                    ranges.append(r)
                    items.append(s)
                    if cut:
                        kept.append(_without(w, k, r) if batch.column(text)[at + k].is_valid else None)
            structs = [[{"first": a, "last": z} for a, z in r] for r in ranges]
            return [pa.array(counts, kinds[0]), pa.array(structs, kinds[1]), pa.array(items, kinds[2]), *([pa.array(kept, pa.string())] if cut else [])]

        return work

    return start


def remove_spans(found: DataFrame, *, text: str = "text") -> DataFrame:
    """Cut the hit words out of ``text``, with what stands between words of one range; null stays null."""

    def start():
        import pyarrow as pa

        def work(batch):
            out = []
            for at, texts in kernel.chunks(kernel.as_bytes(batch.column(text))):
                w = kernel.Words(texts, kernel.ALNUM)
                for k in range(len(texts)):
                    ranges = [(r["first"], r["last"]) for r in batch.column("hit_ranges")[at + k].as_py() or []]
                    out.append(_without(w, k, ranges) if batch.column(text)[at + k].is_valid else None)
            return [pa.array(out, pa.string())]

        return work

    return base.append_columns(found, [T.StructField(text, T.StringType())], start)
