"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction on the sphere; a vector passes it if it lies in the cap around it. Directions are the product of random codes,
one a block of coordinates, so a vector finds all the filters it passes by list-decoding: it sorts its inner products with each block's few
codewords and enumerates the sums above the threshold, without looking at the others. Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import base, graph
from corpusloom.llm.minhash import families

#: Vectors that a filter should pass on average; expected filters that a pair at the threshold shares; turns of the sphere, each with a
#: product code of its own. A single code leaves some directions bare (its few codewords all lie far from them); independent turns don't agree on which.
PER_FILTER, SHARED, TURNS = 192, 18.0, 12
#: Vectors of a filter, or of a family, beyond which it is compared in pairs of blocks of this many.
BLOCK = 1024
#: Directions of a turn up to which they are independent, not products.
SINGLE = 1024
SEED = 20240611


class Sphere:
    """How likely a random direction's inner products with unit vectors of ``dim`` components, times sqrt(dim), reach a threshold; exact."""

    def __init__(self, dim: int):
        self.dim = dim
        if dim > 1:
            self.angles = np.linspace(0, math.pi, 100_001)
            density = np.sin(self.angles) ** (dim - 2)
            area = np.append(0, np.cumsum((density[1:] + density[:-1]) / 2))
            self.caps = area / area[-1]

    def cap(self, height: np.ndarray) -> np.ndarray:
        """Share of the sphere at this height, -1 to 1, or above."""
        if self.dim == 1:
            return np.where(height > 1, 0.0, np.where(height > -1, 0.5, 1.0))
        return np.where(height > 1, 0.0, np.interp(np.arccos(np.clip(height, -1, 1)), self.angles, self.caps))

    def tail(self, t: float) -> float:
        return float(self.cap(np.array(t / math.sqrt(self.dim))))

    def shared_tail(self, t: float, cosine: float) -> float:
        """The same of both of two vectors with this cosine."""
        cosine = min(max(cosine, -1.0), 1.0)
        if self.dim == 1 or cosine == 1:
            return self.tail(t) if cosine > 0 else 0.0
        height = t / math.sqrt(self.dim)
        if height >= 1:
            return 0.0
        angle = np.linspace(0, math.acos(height), 4001)[1:]  # of the direction and the first vector
        middle = (angle + np.append(0, angle[:-1])) / 2
        need = (height - cosine * np.cos(middle)) / (math.sqrt(1 - cosine**2) * np.sin(middle))
        return float(np.sum(np.diff(np.interp(np.append(0, angle), self.angles, self.caps)) * Sphere(self.dim - 1).cap(need)))


class Codes:
    """Product codes for ``n`` vectors of ``dim`` components: caps thin as n grows, their number grows as sharing needs it."""

    def __init__(self, n: int, dim: int, cosine: float, per_filter: int = PER_FILTER, shared: float = SHARED, turns: int = TURNS):
        self.dim, turns = dim, max(turns, 192 // dim)  # the fewer components, the less alike are the halves' shares of a vector
        sphere, best = Sphere(dim), math.inf
        for t in np.arange(0, math.sqrt(dim), 0.05):
            passing, sharing = n * sphere.tail(t), sphere.shared_tail(t, cosine)
            if t and (passing < per_filter or not sharing):
                break
            # comparisons a vector: the filters that it passes times the vectors of each; caps as thin as a pair at the threshold allows
            if (work := shared * passing * max(passing, per_filter) / max(sharing, 1e-12)) < best:
                best, self.threshold, size = work, float(t), shared / turns / max(sharing, 1e-12)
        self.halves = 2 if dim > 3 and size > SINGLE else 1
        self.size = max(2, math.ceil(size ** (1 / self.halves)))
        rng = np.random.default_rng(SEED)
        edges = np.linspace(0, dim, self.halves + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        self.turns = []
        for _ in range(turns):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            words = []
            for part in self.parts:
                w = rng.standard_normal((self.size, part.stop - part.start))
                words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * math.sqrt((part.stop - part.start) / dim))
            self.turns.append((turn, words))

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, filters): the filters that each unit vector passes, those whose inner product times sqrt(dim) reaches the threshold."""
        rows, filters = [], []
        for k, (turn, words) in enumerate(self.turns):
            y = (unit @ turn) * math.sqrt(self.dim)
            first = y[:, self.parts[0]] @ words[0].T
            if self.halves == 1:
                i, f = np.nonzero(first >= self.threshold)
            else:
                second = y[:, self.parts[1]] @ words[1].T
                order = np.argsort(-second, axis=1)
                falling = np.take_along_axis(second, order, axis=1)
                # list decoding: rank by rank of the second code, go on only with those of the first that still exceed the threshold
                i, c = np.nonzero(first + falling[:, :1] >= self.threshold)
                found, rank = [], 0
                while len(i):
                    found.append((i, c * self.size + order[i, rank]))
                    rank += 1
                    if rank == self.size:
                        break
                    on = first[i, c] + falling[i, rank] >= self.threshold
                    i, c = i[on], c[on]
                i = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
                f = np.concatenate([x for _, x in found]) if found else np.empty(0, np.int64)
            rows.append(i)
            filters.append(f + k * self.size**self.halves)
        return np.concatenate(rows), np.concatenate(filters)


def _packed(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the components of valid vectors as little-endian bytes, floats in 4 and others in 8; null where they link with nothing."""
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)

    def start():
        import pyarrow as pa

        def work(batch):
            out = []
            for v in batch.column("_vector").to_pylist():
                a = None if not v or any(x is None for x in v) else np.array(v, "<f4" if single else "<f8")
                out.append(None if a is None or not np.isfinite(a).all() or not a.any() else (a + 0).tobytes())
            return [pa.array(out, pa.binary())]

        return work

    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("_vector"))
    width = F.lit(4 if single else 8)
    return base.append_columns(rows, [T.StructField("v", T.BinaryType())], start).drop("_vector").withColumn("width", width)


def units(raw: list[bytes], width: int) -> np.ndarray:
    """Unit vectors in double precision."""
    m = np.frombuffer(b"".join(raw), f"<f{width}").reshape(len(raw), -1).astype(float)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _compared(nodes: DataFrame, cosine: float, width: int, count: bool) -> DataFrame:
    """In each node, compare all exactly. ``count``: (a, links), the weight of others linked to each; else (a, b), links that connect what is linked.

    A node of a pair of blocks has ``own`` and ``other`` of each row: rows of one block meet only where both are its own.
    """
    columns = ["rep", "v", *(["weight", "own", "other"] if count else [])]

    def run(batches):
        import pyarrow as pa

        for node, (rep, v, *more) in base.sorted_groups(batches, "node", columns, rows=1024):
            cut = np.flatnonzero(np.diff(node)) + 1
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in zip(np.append(0, cut), np.append(cut, len(node)), strict=True):
                m = units(v[x:y], width)
                near = m @ m.T >= cosine
                if count:
                    weight, own, other = (c[x:y] for c in more)
                    np.fill_diagonal(near, False)
                    if (own != other).any():
                        near &= own[:, None] != own[None, :]
                    b.append(near @ weight)
                    a.append(rep[x:y])
                else:
                    first = rep[x:y][families(near)]
                    a.append(rep[x:y][first != rep[x:y]])
                    b.append(first[first != rep[x:y]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    base.reachable(nodes.sparkSession)
    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """A node for each pair of blocks in place of a node of over BLOCK rows (n), with the row's ``own`` block and the ``other``."""
    n = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("node", F.when(n == 1, F.col("node")).otherwise(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))))


def near_duplicates(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, per_filter: int = PER_FILTER, shared: float = SHARED, turns: int = TURNS) -> DataFrame:
    """One row per vector: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked at a cosine of ``cosine`` or more, in double precision; n_links counts the other vectors linked directly,
    component_id is the smallest key reachable, kept marks it. Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, as do those with a null key (null component, kept); vectors of other lengths than another don't link with it.
    Rows that repeat a key count as vectors of their own in n_links. Empty tables give empty results; other columns don't matter.

    Equal vectors are one class with a weight. A pair at the threshold shares ``shared`` filters on average. A filter returns the links that connect
    its vectors, never all pairs; the families they make are then compared whole for n_links. Crowded filters and families are compared in
    pairs of blocks.
    """
    spark = vectors.sparkSession
    packed = base.save(_packed(vectors, key, vector), "vectors")
    width = (packed.select("width").first() or [8])[0]
    classes = base.save(packed.where("v is not null and id is not null").groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")), "classes")
    sizes = classes.groupBy(F.octet_length("v").alias("bytes")).agg(F.count("*").alias("n")).collect()
    codes = spark.sparkContext.broadcast({r["bytes"]: Codes(r["n"], r["bytes"] // width, cosine, per_filter, shared, turns) for r in sizes})

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                raw, rep = part.column("v").to_pylist(), part.column("rep").to_numpy()
                for size in {len(x) for x in raw}:
                    rows = np.array([i for i, x in enumerate(raw) if len(x) == size])
                    i, f = codes.value[size].decode(units([raw[i] for i in rows], width))
                    node = f * 65_537 + size  # lengths apart
                    yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(rep[rows[i]], pa.int64())], names=["node", "rep"])

    base.reachable(spark)
    passed = base.save(classes.select("v", "rep").mapInArrow(decode, "node long, rep long"), "filters")
    nodes = base.sized(passed, "node", least=2).join(classes.select("rep", "v"), "rep")
    families_ = base.save(graph.components(_compared(_blocks(nodes), cosine, width, count=False)), "families")
    sized = base.sized(families_.withColumnRenamed("component", "node"), "node")
    whole = _blocks(sized.withColumnRenamed("id", "rep").join(classes, "rep"))
    links = _compared(whole, cosine, width, count=True).groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    known = classes.join(links, "rep", "left").join(families_.withColumnRenamed("id", "rep"), "rep", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    joined = packed.join(known, "v", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    n_links = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long")
    return joined.select(F.col("id").alias(key), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
