"""Line dedup by windows: repeated runs of lines are found by the hashes of their shortest windows and deleted where they are later.

A unit is a line, or a sentence of a line. From each unit on, and up to each unit, there is one shortest window of consecutive units with ``least``
words. A unit lies in a repeated run of ``least`` words or more if and only if one of these windows around it repeats: whatever of such a run can go without
losing the unit or falling below ``least`` leaves a window. So each window meets its own first occurrence, whatever else its units occur in.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import base, kernel

#: Words that a run has at least to be a passage.
LEAST = 30

RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


class Units:
    """The units of a chunk of texts that have words: ``first`` word, ``words``, ``hash``, ``doc``, byte ``start`` in ``data``."""

    def __init__(self, texts: list[bytes], sentences: bool = True):
        w = kernel.Words(texts, kernel.SPACED)
        self.w = w
        ends = np.flatnonzero(w.data == 10)
        if sentences:
            stop = w.data[w.end - 1] if len(w.end) else np.empty(0, np.uint8)
            ends = np.union1d(ends, w.end[(stop == 46) | (stop == 33) | (stop == 63)])
        ends = np.union1d(ends, w.begin[1:] - 1)
        unit = np.searchsorted(ends, w.start, side="right")
        self.first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.empty(0, np.int64)
        last = np.append(self.first[1:], len(w.start)) if len(unit) else np.empty(0, np.int64)
        self.words = last - self.first
        up, down = kernel.powers(len(w.start) + 1)
        total = np.zeros(len(w.start) + 1, np.uint64)
        np.cumsum(w.hashes() * up[: len(w.start)], out=total[1:])
        self.hash = kernel.mix((total[last] - total[self.first]) * down[self.first] ^ self.words.astype(np.uint64))
        self.doc = w.doc[self.first]
        self.start = w.start[self.first]
        self.cut = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def windows(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, last, hash) of the shortest windows of ``least`` words or more that begin at a unit, and of those that end at one, each once."""
        n = len(self.first)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        upto = np.append(0, np.cumsum(self.words))
        end = np.searchsorted(upto, upto[:-1] + least)
        i = np.flatnonzero(end <= self.cut[self.doc + 1])
        begin = np.searchsorted(upto, upto[1:] - least, side="right") - 1
        j = np.flatnonzero(begin >= self.cut[self.doc])
        first, end = np.append(i, begin[j]), np.append(end[i], j + 1)
        first, end = np.divmod(np.unique(first * (n + 1) + end), n + 1)
        up, down = kernel.powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * up[:n], out=total[1:])
        return first, end - 1, kernel.mix((total[end] - total[first]) * down[first] ^ (end - first).astype(np.uint64))


def _windows(keyed: DataFrame, least: int, sentences: bool) -> DataFrame:
    """(k1, k2, windows): per text its windows' hashes and first and last units; texts without windows are left out."""
    kind = T.StructType([T.StructField("h", T.LongType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])

    def start():
        import pyarrow as pa

        def work(batch):
            size, parts = [np.zeros(1, np.int64)], [(np.empty(0, np.int64),) * 3]
            for _, texts in kernel.chunks(kernel.as_bytes(batch.column("_text"))):
                u = Units(texts, sentences)
                first, last, h = u.windows(least)
                doc = u.doc[first]
                parts.append((h.view(np.int64), first - u.cut[doc], last - u.cut[doc]))
                size.append(np.bincount(doc, minlength=len(texts)))
            h, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
            rows = pa.StructArray.from_arrays([pa.array(h, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], names=["h", "first", "last"])
            return [pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(size)).astype(np.int32)), rows)]

        return work

    return base.append_columns(keyed, [T.StructField("windows", T.ArrayType(kind))], start).drop("_text").where(F.size("windows") > 0)


def repeated_ranges(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, sentences: bool = True) -> DataFrame:
    """(k1, k2, ranges): of each text, the ranges of units whose windows repeat an earlier place; k1 is the key (null: the greatest), k2 the text's hash.

    They cover every run of ``least`` words or more that occurs at any earlier place, in order of key, text hash and place. One row a window
    is shuffled, minima are combined before it, and a window that very many texts hold meets in no one task.
    """
    keyed = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(2**63 - 1)).alias("k1"), F.xxhash64(f"`{text}`").alias("k2"), F.col(f"`{text}`").alias("_text")).where("_text is not null")
    windows = base.save(_windows(keyed, least, sentences), "windows")
    rows = windows.select("k1", "k2", F.explode("windows").alias("w")).select("k1", "k2", "w.*")
    earliest = base.save(rows.groupBy("h").agg(F.min(F.struct("k1", "k2", "first")).alias("earliest"), F.count("*").alias("n")).where("n > 1"), "repeated")
    total = windows.agg(F.sum(F.size("windows"))).first()[0] or 0
    later = base.lookup(rows, earliest, "h", "n", total).where(F.struct("k1", "k2", "first") > F.col("earliest"))
    found = later.groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    def start():
        import pyarrow as pa

        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

        def work(batch):
            return [pa.array([merged(r.values.field("first").to_numpy(), r.values.field("last").to_numpy()) for r in batch.column("ranges")], kind)]

        return work

    return base.append_columns(found, [T.StructField("ranges", RANGES)], start)


def merged(first: np.ndarray, last: np.ndarray) -> list[dict[str, int]]:
    """Ranges that overlap or touch as one, ascending."""
    order = np.argsort(first, kind="stable")
    first, upto = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.append(True, first[1:] > upto[:-1] + 1))
    return [{"first": int(a), "last": int(b)} for a, b in zip(first[new], upto[np.append(new[1:], len(first)) - 1], strict=True)]


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, sentences: bool = True) -> DataFrame:
    """``docs`` with repeated runs cut out of ``text``, plus ``removed_units`` and ``removed_words``; columns with these names are replaced.

    Texts are cut into units at line ends and, with ``sentences``, after words that end in . ! or ?; units compare by their words, A-Z
    lower-cased. A run of units with ``least`` words or more that repeats an earlier place is deleted, be it in an earlier document or
    earlier in its own; the first occurrence of any unit always stays. What stays is unchanged, save that white space at the end of a cut text goes. Null
    keys come last in order, null texts stay null, texts of fewer words than ``least`` stay whole, repeated rows are one document and are cut
    alike, empty tables stay empty.
    """
    taken = {"removed_units", "removed_words"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in taken])
    found = base.save(repeated_ranges(docs, key=key, text=text, least=least, sentences=sentences), "ranges")
    k1, k2 = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(2**63 - 1)), F.xxhash64(f"`{text}`")
    side = base.small(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("ranges").alias("_ranges")))
    joined = docs.join(side, (k1 == F.col("_k1")) & (k2 == F.col("_k2")), "left").drop("_k1", "_k2")
    fields = [T.StructField(text, T.StringType()), T.StructField("removed_units", T.LongType()), T.StructField("removed_words", T.LongType())]

    def start():
        import pyarrow as pa

        def work(batch):
            column, ranges = batch.column(text), batch.column("_ranges")
            out, units, words = column.to_pylist(), [0] * len(column), [0] * len(column)
            for i in np.flatnonzero(ranges.is_valid().to_numpy(zero_copy_only=False)):
                body = out[i].encode()
                u = Units([body], sentences)
                gone = np.zeros(len(u.first), bool)
                for r in ranges[int(i)].as_py():
                    gone[r["first"] : r["last"] + 1] = True
                edge = np.append(u.start, len(body))
                parts = [body[: edge[0]], *(body[edge[k] : edge[k + 1]] for k in np.flatnonzero(~gone))]
                out[i] = b"".join(parts).decode().rstrip()
                units[i], words[i] = int(gone.sum()), int(u.words[gone].sum())
            return [pa.array(out, pa.string()), pa.array(units, pa.int64()), pa.array(words, pa.int64())]

        return work

    order = [c for c in docs.columns]
    return base.append_columns(joined, fields, start).select(*[F.col(f"`{c}`") for c in order], "removed_units", "removed_words")
