"""Toxicity by multiple-instance learning: sentences get scores, noisy-or makes them a document's, document labels train them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import base, kernel

#: Labelled rows that training takes at most, of each label, and bytes of their texts in all.
MOST_ROWS = {1: 3000, 0: 5000}
MOST_BYTES = 24 << 20
#: Bytes of word beginnings that are features beside the whole word: stems that take endings.
PREFIXES = (3, 4, 5, 6)
BITS = 20
#: Rows of the training sample in which a feature must occur.
LEAST_ROWS = 4
#: Standard deviations by which its share of label-1 rows must exceed that of label-0 rows. By three-fold cross-validation inside the rows that may be learned from
#: (check_s, mean log loss at 2.5, 3.5, 4.5, 5.5, 6.5: 0.090, 0.035, 0.017, 0.016, 0.016; errors at 0.3: 220, 46, 11, 8, 16).
LEAST_Z = 5.5
EPOCHS, RATE, L1 = 80, 0.3, 2e-3
#: Probability of label 1 without any evidence.
LEAK = 0.005


def sentence_ids(w: kernel.Words) -> np.ndarray:
    """For each word the number of its sentence in the chunk: sentences end at line ends, at .!? before white space and with the text."""
    data = w.data
    after = np.append(data[1:], 32)
    blank = (after == 32) | ((after >= 9) & (after <= 13))
    ends = np.flatnonzero((data == 10) | (((data == 46) | (data == 33) | (data == 63)) & blank))
    ends = np.union1d(ends, w.begin[1:] - 1)
    return np.searchsorted(ends, w.start)


def features(w: kernel.Words) -> np.ndarray:
    """(kinds, words) hashed features: the whole word, and its beginnings where it is longer; -1 where there is none."""
    n = w.end - w.start
    out = np.full((1 + len(PREFIXES), len(n)), -1, np.int64)
    shift = np.uint64(64 - BITS)
    out[0] = (w.hashes() >> shift).astype(np.int64)
    for k, size in enumerate(PREFIXES, 1):
        at = np.flatnonzero(n > size)
        out[k, at] = (kernel.mix(w.hash_between(w.start[at], w.start[at] + size) ^ np.uint64(k)) >> shift).astype(np.int64)
    return out


class Model:
    """Weights of the hashed features (the last is always 0, for none) and the bias of a sentence."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    def sentences(self, w: kernel.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, logit) of each sentence that has words; minus infinity where none of its features has a weight."""
        ids = sentence_ids(w)
        if not len(ids):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        each = self.weights[features(w)]
        told = np.add.reduceat((each != 0).any(axis=0).astype(np.int64), first) > 0
        return w.doc[first], first, np.where(told, self.bias + np.add.reduceat(each.sum(axis=0, dtype=np.float64), first), -np.inf)

    def scores(self, texts: list[bytes]) -> list[float]:
        """Noisy-or over sentences and the leak, which is all that a text without evidence, or without words, has. So length alone is none."""
        out: list[float] = []
        for _, part in kernel.chunks(texts):
            doc, _, z = self.sentences(kernel.Words(part, kernel.ALNUM))
            clean = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(part)) - np.log1p(-LEAK)
            out += (-np.expm1(-clean)).tolist()
        return out

    def offending(self, text: bytes, least: float) -> list[tuple[int, int, float]]:
        """(first byte, end byte, score) of the sentences, from first to last word, that score ``least`` at least."""
        w = kernel.Words([text], kernel.ALNUM)
        _, first, z = self.sentences(w)
        if not len(first):
            return []
        p = 1 / (1 + np.exp(-z))
        last = np.append(first[1:], len(w.start)) - 1
        return [(int(w.start[a]), int(w.end[b]), float(s)) for a, b, s in zip(first, last, p, strict=True) if s >= least]


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Proximal Adagrad on the log-likelihood of document labels under noisy-or; deterministic."""
    if not len(texts) or not len(np.unique(labels)) > 1:
        rate = float(np.average(labels, weights=weights)) if len(texts) else 0.0
        return Model(np.zeros((1 << BITS) + 1), np.log(max(rate, 1e-3) / (1 - min(rate, 0.999))))  # no evidence either way
    positive = labels == 1
    rows, ones = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for at, part in kernel.chunks(texts):  # first pass: in how many rows of each label a feature occurs
        w = kernel.Words(part, kernel.ALNUM)
        f = features(w)
        keep = f >= 0
        pair = np.unique(f[keep] * len(part) + np.broadcast_to(w.doc, f.shape)[keep])
        marked = positive[at + pair % len(part)]
        rows += np.bincount(pair // len(part), minlength=1 << BITS)
        ones += np.bincount(pair[marked] // len(part), minlength=1 << BITS)
    n1 = int(positive.sum())
    n0 = len(texts) - n1
    mean = rows / len(texts)
    with np.errstate(divide="ignore", invalid="ignore"):
        z = (ones / n1 - (rows - ones) / n0) / np.sqrt(mean * (1 - mean) * (1 / n1 + 1 / n0))
    known = np.flatnonzero((rows >= LEAST_ROWS) & (z >= LEAST_Z))
    place = np.full((1 << BITS) + 1, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    cols, sents, docs, n_sent = [], [], [], 0
    for at, part in kernel.chunks(texts):  # second pass: the sentences, by known features alone
        w = kernel.Words(part, kernel.ALNUM)
        if not len(w.start):
            continue
        ids = sentence_ids(w)
        firsts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        ids = np.searchsorted(firsts, np.arange(len(ids)), side="right") - 1 + n_sent
        f = place[features(w)]
        keep = f >= 0
        cols.append(f[keep])
        sents.append(np.broadcast_to(ids, f.shape)[keep])
        docs.append(w.doc[firsts] + at)
        n_sent += len(firsts)
    if not n_sent:
        return Model(np.zeros((1 << BITS) + 1), -5.0)
    col, sent, doc = np.concatenate(cols), np.concatenate(sents), np.concatenate(docs)
    told, sent = np.unique(sent, return_inverse=True)  # the sentences with a known feature
    doc, n_sent = doc[told], len(told)
    y, total = labels.astype(float), weights.sum()
    theta, bias = np.zeros(len(known)), -2.0
    g2, b2 = np.full(len(known), 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = bias + np.bincount(sent, weights=theta[col], minlength=n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        clean = np.bincount(doc, weights=np.logaddexp(0, z), minlength=len(texts)) - np.log1p(-LEAK)
        any_ = np.maximum(-np.expm1(-clean), 1e-9)
        pull = weights * np.where(y > 0, -(1 - any_) / any_, 1.0) / total
        g = p * pull[doc]
        grad, gb = np.bincount(col, weights=g[sent], minlength=len(known)), g.sum()
        g2 += grad**2
        b2 += gb**2
        step = RATE / np.sqrt(g2)
        theta -= step * grad
        theta = np.sign(theta) * np.maximum(np.abs(theta) - step * L1 * 0.1, 0)
        bias -= RATE / np.sqrt(b2) * gb
    out = np.zeros((1 << BITS) + 1)
    out[known] = theta
    return Model(out, bias)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows=MOST_ROWS, most_bytes: int = MOST_BYTES) -> Model:
    """Fit a model on a bounded sample of labelled rows: the keys of smallest hash, at most about ``most_rows`` of each label and
    ``most_bytes`` of whole texts; label 0 is weighted back to its share. Rows with a null key, text or label teach nothing;
    a key with several labels counts as its largest. Without both labels the model is the base rate.
    """
    import pyarrow as pa

    marks = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("key")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("y"))
    texts = docs.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("t"))
    seen = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(seen) != {0, 1}:
        n = sum(seen.values())
        return fit([b""] * min(n, 2), np.array([1] * min(n, 2) if 1 in seen else [0] * min(n, 2)), np.ones(min(n, 2)))
    draw = F.pmod(F.xxhash64("key", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = {y: min(1.0, most_rows[y] / seen[y]) for y in seen}
    picked = marks.withColumn("u", draw).where(F.when(F.col("y") == 1, F.col("u") < share[1]).otherwise(F.col("u") < share[0]))
    rows = base.save(texts.join(base.small(picked), "key").where("t is not null").select("t", "y", "u"), "toxicity-sample")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > most_bytes:
        scaled = most_bytes / size
        rows = rows.where(F.when(F.col("y") == 1, F.col("u") < share[1] * scaled).otherwise(F.col("u") < share[0] * scaled))
    got = rows.orderBy("u", "y", F.md5("t")).select("t", "y").toArrow()
    y = np.array(got.column("y").to_pylist(), dtype=int)
    bodies = kernel.as_bytes(got.column("t"))
    del got
    model = fit(bodies, y, np.where(y == 1, 1 / share[1], 1 / share[0]) if len(y) else np.ones(0))
    del bodies
    pa.default_memory_pool().release_unused()  # the driver goes on to other work
    return model


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); columns with these names are replaced.

    Null and empty texts, and others without evidence, score the leak alone. One pass over whole texts, nothing is shuffled; equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        import pyarrow as pa

        m = shared.value

        def work(batch):
            s = m.scores(kernel.as_bytes(batch.column(text)))
            return [pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())]

        return work

    return base.append_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start)


def locate(docs: DataFrame, model: Model, *, text: str = "text", least: float = 0.3) -> DataFrame:
    """Adds ``offending``: the sentences that score ``least`` at least, as text and score; empty for clean, null or empty texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())]))

    def start():
        import pyarrow as pa

        m = shared.value
        to = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

        def work(batch):
            return [pa.array([[{"sentence": t[a:b].decode(errors="replace"), "score": s} for a, b, s in m.offending(t, least)] for t in kernel.as_bytes(batch.column(text))], to)]

        return work

    return base.append_columns(docs, [T.StructField("offending", kind)], start)
