"""LM scoring by cross-entropy difference: matched target and background bigram models over one vocabulary.

Both models have the same vocabulary, every word of the corpus, the same order and smoothing. A word's loss is -ln p(word | word before); a document's score
is the mean of target loss minus background loss over its words, so a low score means "like the target".

The models grow with the corpus, so they are never in one place. Texts are taken in batches. Each counts its words and pairs of words and sends the counts, dealt out
to parts by hash, as arrays: one row a batch and part. A part adds up what it gets and sends each batch what the others have of the batch's own entries, in the order in
which they came. So a batch is scored with the counts of the whole corpus, though it holds those alone that its texts need.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import base, kernel

#: Bytes of text that are counted and scored together (a longer text is a batch of its own).
BATCH = 8 << 20
#: Bytes of corpus whose entries one part adds up; beyond MOST_PARTS parts they grow up to the second number, then their number does.
PART, MOST_PARTS = (4 << 20, 64 << 20), 4096
#: Weight, in words, of the unigram model in the bigram model (Dirichlet smoothing).
PRIOR = 50.0
#: The history of a text's first word; no word has its key but by chance.
BEGIN = np.uint64(0x8B1A5C3D2E4F6071)


def pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return kernel.mix(before * np.uint64(kernel.BASE) + word)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, row by row, as the planes of those of their bytes that the largest needs, lowest first; that number of planes comes before them."""
    x = x.reshape(-1)
    k = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([k]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes()


def unpacked(raw: bytes, width: int = 1) -> np.ndarray:
    """The numbers, in rows of ``width`` if that isn't 1."""
    rows = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((rows.shape[1], 8), np.uint8)
    out[:, : raw[0]] = rows.T
    out = out.view("<i8").reshape(-1)
    return out if width == 1 else out.reshape(-1, width)


def by_part(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of entries by part, and where each part begins and ends in it."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


class Batch:
    """Words of a batch: ``keys`` of its distinct words, the commonest first after BEGIN; ``ids`` of its words; ``counts`` of words of each text."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.keys, self.ids, self.counts = keys, ids, counts

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> Batch:
        keys, ids, n = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(1, len(keys) + 1)
        return cls(np.append(BEGIN, keys[order]), rank[ids], counts)

    @functools.cached_property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    @functools.cached_property
    def before(self) -> np.ndarray:
        out = np.empty(len(self.ids), np.int64)
        out[1:] = self.ids[:-1]
        out[(np.cumsum(self.counts) - self.counts)[self.counts > 0]] = 0
        return out

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, second word) of each distinct pair, and the pair that each word ends."""
        pairs, which = np.unique(self.before * len(self.keys) + self.ids, return_inverse=True)
        return *np.divmod(pairs, len(self.keys)), which

    def pair_keys(self) -> np.ndarray:
        first, second, _ = self.pairs
        return pair_keys(self.keys[first], self.keys[second])

    def tally(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts in all texts and in target texts: of words as words and as histories, and of pairs."""
        aim = target[self.doc].astype(float)
        count = lambda x, n: np.stack([np.bincount(x, minlength=n), np.bincount(x, weights=aim, minlength=n).astype(np.int64)], axis=1)
        return np.hstack([count(self.ids, len(self.keys)), count(self.before, len(self.keys))]), count(self.pairs[2], len(self.pairs[0]))

    def losses(self, words: np.ndarray, pairs: np.ndarray, total: np.ndarray, vocabulary: int, prior: float) -> np.ndarray:
        """(2, texts): sums of the losses in background and target; ``words`` has (b, t) as word and (b, t) as history, ``pairs`` (b, t)."""
        first, second, which = self.pairs
        out = []
        for k in (0, 1):
            unigram = (words[:, k] + 1) / (total[k] + vocabulary + 1)
            each = -np.log((pairs[:, k] + prior * unigram[second]) / (words[first, 2 + k] + prior))
            out.append(np.bincount(self.doc, weights=each[which], minlength=len(self.counts)))
        return np.array(out)


def _head(counts: bytes, tokens: bytes, keys: bytes) -> Batch:
    return Batch(np.frombuffer(keys, np.uint64), unpacked(tokens), unpacked(counts))


def _batches(docs: DataFrame, batch_bytes: int) -> DataFrame:
    """(batch, ids, target, counts, tokens, keys) from (key, text, target): a row a batch, with its texts' keys, marks and numbers of words, its words in order as
    numbers, and the keys of those numbers."""
    schema = T._parse_datatype_string(f"batch long, ids array<{docs.schema['key'].dataType.simpleString()}>, target binary, counts binary, tokens binary, keys binary")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def row(ids, hashes, counts, target):
            nonlocal number
            number += 1
            counts, ids = np.concatenate(counts), pa.concat_arrays(ids)
            b = Batch.of(np.concatenate(hashes), counts)
            raw = [np.concatenate(target).tobytes(), packed(counts), packed(b.ids), b.keys.tobytes()]
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), lists, *(pa.array([x], pa.binary()) for x in raw)], names=schema.names)

        held, size = ([], [], [], []), 0
        for batch in batches:
            key, target = batch.column("key"), batch.column("target").to_numpy(zero_copy_only=False).astype(np.uint8)
            for at, texts in kernel.chunks(kernel.as_bytes(batch.column("text"))):
                w = kernel.Words(texts, kernel.ALNUM)
                for part, x in zip(held, (key.slice(at, len(texts)), w.hashes(), w.count, target[at : at + len(texts)]), strict=True):
                    part.append(x)
                size += len(w.data)
                if size >= batch_bytes:
                    yield row(*held)
                    held, size = ([], [], [], []), 0
        if size:
            yield row(*held)

    base.reachable(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def _counted(heads: DataFrame, parts: int) -> DataFrame:
    """(batch, part, words, word_counts, pairs, pair_counts): the keys and counts of a batch's entries in each part."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                b = _head(*(batch.column(c)[i].as_py() for c in ("counts", "tokens", "keys")))
                words, pairs = b.tally(np.frombuffer(batch.column("target")[i].as_py(), np.uint8))
                keys = b.pair_keys()
                (wo, wc), (po, pc) = by_part(b.keys, parts), by_part(keys, parts)
                some = np.flatnonzero((np.diff(wc) > 0) | (np.diff(pc) > 0))
                cut = lambda x, order, edge, pack: pa.array([pack(x[order[edge[p] : edge[p + 1]]]) for p in some], pa.binary())  # noqa: E731, B023
                entries = [cut(b.keys, wo, wc, np.ndarray.tobytes), cut(words, wo, wc, packed), cut(keys, po, pc, np.ndarray.tobytes), cut(pairs, po, pc, packed)]
                number = pa.array(np.full(len(some), batch.column("batch")[i].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([number, pa.array(some, pa.int32()), *entries], names=["batch", "part", "words", "word_counts", "pairs", "pair_counts"])

    base.reachable(heads.sparkSession)
    return heads.mapInArrow(run, "batch long, part int, words binary, word_counts binary, pairs binary, pair_counts binary")


def _summed(counted: DataFrame, parts: int) -> DataFrame:
    """(batch, part, words, pairs, vocabulary, b, t): the sums over all other batches for a batch's own entries, nought for most; one row a part has its distinct words
    and words in all."""

    def sums(raw: list[bytes], counts: list[bytes], width: int) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, where = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
        each = np.concatenate([unpacked(c, width) for c in counts])
        total = np.stack([np.bincount(where, weights=each[:, k], minlength=len(keys)).astype(np.int64) for k in range(width)], axis=1)
        edge = np.cumsum([len(x) // 8 for x in raw])[:-1]
        return total, np.split(total[where] - each, edge)

    def run(batches):
        import pyarrow as pa

        for part, (batch, words, word_counts, pairs, pair_counts) in base.sorted_groups(batches, "part", ["batch", "words", "word_counts", "pairs", "pair_counts"]):
            cut = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
            for x, y in zip(np.append(0, cut), cut, strict=False):
                total, own = sums(words[x:y], word_counts[x:y], 4)
                _, own_pairs = sums(pairs[x:y], pair_counts[x:y], 2)
                first = np.arange(y - x) == 0
                told = [np.where(first, v, 0) for v in (int((total[:, 0] > 0).sum()), int(total[:, 0].sum()), int(total[:, 1].sum()))]
                columns = [pa.array(batch[x:y], pa.int64()), pa.array(part[x:y], pa.int32()), *(pa.array([packed(v) for v in c], pa.binary()) for c in (own, own_pairs)), *(pa.array(v, pa.int64()) for v in told)]
                yield pa.RecordBatch.from_arrays(columns, names=["batch", "part", "words", "pairs", "vocabulary", "b", "t"])

    return counted.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "batch long, part int, words binary, pairs binary, vocabulary long, b long, t long")


def _scored(heads: DataFrame, summed: DataFrame, parts: int, total: np.ndarray, vocabulary: int, prior: float) -> DataFrame:
    """(key, n_words, target_loss, background_loss, score) of each text, batch by batch."""
    kind = heads.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_words", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("target_loss", "background_loss", "score"))])

    def run(batches):
        import pyarrow as pa

        def result(head, words, pairs):
            ids, target, *told = head
            b = _head(*told)
            told = b.tally(np.frombuffer(target, np.uint8))
            for out, k, raw in zip(told, (b.keys, b.pair_keys()), (words, pairs), strict=True):
                out[by_part(k, parts)[0]] += np.concatenate([unpacked(x, out.shape[1]) for x in raw])
            none, by = b.counts == 0, np.maximum(b.counts, 1)
            back, aim = b.losses(*told, total, vocabulary, prior) / by
            return pa.RecordBatch.from_arrays([ids, pa.array(b.counts), *(pa.array(x, pa.float64(), mask=none) for x in (aim, back, aim - back))], names=schema.names)

        head, words, pairs = None, [], []
        for batch in batches:
            for i, part in enumerate(batch.column("part").to_pylist()):
                if part < 0:
                    if head:
                        yield result(head, words, pairs)
                    words, pairs = [], []
                    head = (batch.column("ids")[i].values, *(batch.column(c)[i].as_py() for c in ("target", "counts", "tokens", "keys")))
                else:
                    words.append(batch.column("words")[i].as_py())
                    pairs.append(batch.column("pairs")[i].as_py())
        if head:
            yield result(head, words, pairs)

    rows = heads.withColumn("part", F.lit(-1)).unionByName(summed.select("batch", "part", "words", "pairs"), allowMissingColumns=True)
    return rows.repartition("batch").sortWithinPartitions("batch", "part").mapInArrow(run, schema)


def cross_entropy_difference(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", prior: float = PRIOR, batch_bytes: int = BATCH) -> DataFrame:
    """(``key``, ``n_words``, ``target_loss``, ``background_loss``, ``score``), one row a document: means per word, and their difference.

    The target corpus are the documents whose key is in ``target``, the background all of them; both models hold every word and pair of the corpus,
    none is cut off at any size. Null keys are in no target, repeated keys of ``target`` count once, repeated rows of ``docs`` are counted and scored each.
    Texts that are null or without words have 0 words and null losses. With an empty target its model is uniform. Empty tables give empty results;
    other columns don't matter.
    """
    marks = target.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("_key")).distinct().withColumn("target", F.lit(True))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(-(-size // PART[0]), MOST_PARTS), -(-size // PART[1]))
    marked = rows.join(base.small(marks), F.col("key") == F.col("_key"), "left").select("key", "text", F.coalesce("target", F.lit(False)).alias("target"))
    heads = base.save(_batches(marked, batch_bytes), "batches")
    summed = base.save(_summed(_counted(heads, parts), parts), "sums")
    base.free_shuffles(docs.sparkSession)  # that of the entries is the largest file there is
    vocabulary, *total = (x or 0 for x in summed.agg(F.sum("vocabulary"), F.sum("b"), F.sum("t")).first())
    return _scored(heads, summed, parts, np.array(total, float), vocabulary, prior).withColumnRenamed("key", key)
