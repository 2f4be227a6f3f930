"""MinHash near-duplicates by a chosen-path set similarity join.

Documents of equal shingle sets are one class. From the root of each of several independent trees, classes branch by selected minwise
tokens: a node picks coordinates of the signature (1/threshold of them on average) and a class goes to the child that its own values
there name. Nodes of few classes stop and are compared exhaustively; of larger ones, first each block is compared with itself and with the node's
pivots. Links of alike sketches make families. A large node that lies in one family is settled, as families are compared on full sets anyway; one
that lies in a family but for few classes compares those with all; only others branch on, each with coordinates of its own. What is still
large at the greatest depth is compared in pairs of blocks. At last every family's full sets are compared, exactly: large families by blocks and pivots
first, then what that leaves apart with all the rest.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import base, graph, kernel

#: Values of a signature; of a sketch, their lowest bytes.
VALUES = 64
#: Classes of a node that are compared exhaustively, of a block of a larger node at the greatest depth, that depth.
SMALL, BLOCK, DEPTH = 48, 256, 4
#: Members that a large node, and a large family, has each of its blocks compared with.
PIVOTS = 2, 4
#: Standard deviations of the sketch's estimate below the threshold at which a pair is still a candidate.
SLACK = 4.0
#: Columns of the incidence matrix that are multiplied at once.
WIDTH = 8192

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**32, VALUES, dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, VALUES, dtype=np.uint32) | np.uint32(1)


def shingle_sets(w: kernel.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, hashes) of the distinct runs of ``n`` words, sorted by both; a text of fewer words has its whole sequence as one."""
    h = w.hashes()
    at, s = w.runs(n, h)
    doc = w.doc[at]
    for size in range(1, n):
        short = np.flatnonzero(w.count == size)
        if len(short):
            at, runs = w.runs(size, h)
            pick = np.isin(w.doc[at], short)
            doc, s = np.append(doc, w.doc[at][pick]), np.append(s, runs[pick])
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    new = np.ones(len(s), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (s[1:] != s[:-1])
    return doc[new], s[new]


def missed(n_trees: int, threshold: float, selections: int) -> float:
    """Probability that a pair at the threshold parts on every path of ``selections`` coordinates, the first of them a root's.

    Mean over how many of the signature's values agree, which all paths share.
    """
    picks, more = int(n_trees / threshold + 1e-9), min(1.0, 1 / threshold - 1)
    total = 0.0
    for k in range(VALUES + 1):
        agree, lost = k / VALUES, 0.0
        for _ in range(selections - 1):
            one = 1 - agree * (1 - lost)
            lost = (1 - more) * one + more * one * one
        total += math.comb(VALUES, k) * threshold**k * (1 - threshold) ** (VALUES - k) * (1 - agree * (1 - lost)) ** picks
    return total


def trees(recall: float, threshold: float, selections: int) -> int:
    """Independent trees for ``recall`` of pairs at the threshold, even those whose nodes are all large up to the last of the selections."""
    least = max(1 - recall, 2 * (1 - threshold) ** VALUES)  # signatures that agree nowhere are beyond any number
    return next(n for n in itertools.count(1) if missed(n, threshold, selections) <= least)


def _signatures(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    fields = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.ArrayType(T.IntegerType())), T.StructField("sketch", T.BinaryType())]

    def start():
        import pyarrow as pa

        def work(batch):
            raw = kernel.as_bytes(batch.column("_text"))
            h1, h2, n = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.int64)
            sig = np.zeros((len(raw), VALUES), np.uint32)
            for at, texts in kernel.chunks(raw):
                doc, s = shingle_sets(kernel.Words(texts, kernel.SPACED), shingle)
                if not len(s):
                    continue
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                rows = doc[first] + at
                n[rows] = np.diff(np.append(first, len(s)))
                h1[rows] = np.add.reduceat(kernel.mix(s ^ np.uint64(0x51ED270B)), first)
                h2[rows] = np.add.reduceat(kernel.mix(s ^ np.uint64(0xA3EC647659359ACD)), first)
                half = (s >> np.uint64(32)).astype(np.uint32)
                for i in range(VALUES):
                    sig[rows, i] = np.minimum.reduceat((half ^ _XOR[i]) * _ODD[i], first)
            values = pa.array(sig.view(np.int32).reshape(-1))
            low = np.ascontiguousarray((sig >> np.uint32(3)).astype(np.uint8))
            return [
                pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n),
                pa.ListArray.from_arrays(pa.array(np.arange(len(raw) + 1, dtype=np.int32) * VALUES), values),
                pa.array([r.tobytes() for r in low], pa.binary()),
            ]

        return work

    return base.append_columns(docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("_text")), fields, start).drop("_text")


def _rooted(classes: DataFrame, n_trees: int, threshold: float) -> DataFrame:
    """(node, rep): the children of all roots. Tree j selects one coordinate, and a second one as often as makes 1/threshold on average."""
    picks, at, owed = [], 0, 0.0
    for j in range(n_trees):
        owed += 1 / threshold
        for _ in range(int(owed)):
            picks.append((j, at % VALUES))
            at += 1
        owed -= int(owed)
    nodes = F.array(*[F.xxhash64(F.lit(j), F.lit(i), F.col("sig")[i]) for j, i in picks])
    return classes.select("rep", F.explode(nodes).alias("node"))


def _branch(rows: DataFrame, threshold: float) -> DataFrame:
    """(node, rep): the children of large nodes; coordinates come from the node's own hash."""
    one = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(VALUES)).cast("int")
    two = F.pmod(F.xxhash64("node", F.lit("second")), F.lit(VALUES)).cast("int")
    more = F.pmod(F.xxhash64("node", F.lit("more")), F.lit(1000)) < round(1000 * (1 / threshold - 1))
    child = lambda i: F.xxhash64("node", i, F.get("sig", i))
    return rows.select("rep", F.explode(F.when(more & (one != two), F.array(child(one), child(two))).otherwise(F.array(child(one)))).alias("node"))


def _lowest(by: str, n: int) -> list[Column]:
    """For each of ``n`` hashes the ``rep`` that is lowest in a group ``by``: its pivots, drawn without ordering the group."""
    return [F.min(F.struct(F.xxhash64("rep", by, F.lit(k)), "rep"))["rep"] for k in range(n)]


def _counted(rows: DataFrame) -> DataFrame:
    """(node, rep, n, pivots) of nodes of two classes or more."""
    return rows.join(rows.groupBy("node").agg(F.count("*").alias("n"), F.array(*_lowest("node", PIVOTS[0])).alias("pivots")).where("n > 1"), "node")


def _blocks(size: str = "n") -> Column:
    return F.ceil(F.col(size) / BLOCK).cast("int")


def with_pivots(rows: DataFrame) -> DataFrame:
    """Each row in one block of its large node, the pivots in all of its blocks: as many rows as before but for the pivots."""
    own = F.array(F.pmod(F.xxhash64("rep"), _blocks()).cast("int"))
    every = F.when(F.array_contains("pivots", F.col("rep")), F.sequence(F.lit(0), _blocks() - 1)).otherwise(own)
    return rows.withColumn("_block", F.explode(every)).withColumn("node", F.xxhash64("node", "_block", F.lit("pivots"))).drop("_block")


def _parted(rows: DataFrame, groups: DataFrame, few: int) -> tuple[DataFrame, DataFrame]:
    """What large nodes still have to compare, ``groups`` (id, component) having those that need no comparison: (nodes, mixed).

    Nodes in one group go. In ``nodes`` are those of which all but ``few`` rows are in one group: that group's rows are dealt out to blocks and the few
    are in all of them. ``mixed`` are the others, as they came.
    """
    owned = rows.join(groups.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    owned = base.save(owned, "owned")
    counts = owned.groupBy("node", "component").agg(F.count("*").alias("m")).groupBy("node").agg(F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("most"))
    counts = counts.select("node", (F.col("all") - F.col("most.m")).alias("rest"), F.col("most.component").alias("_most")).where("rest > 0")
    told = owned.join(counts, "node")
    own = F.array(F.pmod(F.xxhash64("rep"), _blocks()).cast("int"))
    dealt = told.where(F.col("rest") <= few).withColumn("_block", F.explode(F.when(F.col("component") == F.col("_most"), own).otherwise(F.sequence(F.lit(0), _blocks() - 1))))
    nodes = dealt.withColumn("node", F.xxhash64("node", "_block", F.lit("few")))
    return nodes.select(rows.columns), told.where(F.col("rest") > few).select(rows.columns)


def in_blocks(rows: DataFrame, node: str, member: str, size: str, block: int) -> DataFrame:
    """Replace a large node by a node for each pair of its blocks, so each two members meet in one; small nodes stay."""
    blocks = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    other = F.explode(F.when(F.col(size) <= block, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    spread = rows.withColumn("_own", own).withColumn("_other", other)
    met = F.xxhash64(node, F.least("_own", "_other"), F.greatest("_own", "_other"))
    return spread.withColumn(node, F.when(F.col("_other") < 0, F.col(node)).otherwise(met)).drop("_own", "_other")


def families(link: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the first row of its connected component."""
    n = len(link)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            while front.any():
                label[front] = i
                front = link[front].any(axis=0) & (label < 0)
    return label


def _candidates(nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): in each node, links that connect the members whose sketches agree in ``least`` of their values; no more than members."""

    def run(batches):
        import pyarrow as pa

        for node, (rep, sketch) in base.sorted_groups(batches, "node", ["rep", "sketch"]):
            cut = np.flatnonzero(np.diff(node)) + 1
            begin, end = np.append(0, cut), np.append(cut, len(node))
            s = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(sketch), -1)
            two = begin[end - begin == 2]
            hit = two[(s[two] == s[two + 1]).mean(axis=1) >= least] if len(two) else two
            a, b = [rep[hit]], [rep[hit + 1]]
            for x, y in zip(begin, end, strict=True):
                if y - x > 2:
                    part = s[x:y]
                    link = np.stack([(part == row).mean(axis=1) >= least for row in part])
                    label = families(link)
                    a.append(rep[x:y])
                    b.append(rep[x:y][label])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], names=["a", "b"])

    base.reachable(nodes.sparkSession)
    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def _verified(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): in each node, links that connect the members whose full sets are similar: 100 * intersection >= percent * union."""

    def run(batches):
        import pyarrow as pa

        for node, (rep, body) in base.sorted_groups(batches, "node", ["rep", "shingles"]):
            cut = np.flatnonzero(np.diff(node)) + 1
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for x, y in zip(np.append(0, cut), np.append(cut, len(node)), strict=True):
                sets = [np.frombuffer(v, np.uint64) for v in body[x:y]]
                label = families(similar(sets, percent))
                a.append(rep[x:y])
                b.append(rep[x:y][label])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b], pa.int64()), pa.array(b[a != b], pa.int64())], names=["a", "b"])

    base.reachable(nodes.sparkSession)
    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def similar(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sorted sets have 100 * intersection >= percent * union; exact."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        both = np.array([[0, 0], [0, 0]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        shared = np.bincount(column)[column] > 1  # what one set alone holds meets nothing
        row, column = row[shared], column[shared]
        both = np.zeros((len(sets), len(sets)), np.int64)
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
            x, y = np.searchsorted(column, [at, at + WIDTH])
            matrix = np.zeros((len(sets), WIDTH), np.float32)
            matrix[row[x:y], column[x:y] - at] = 1
            both += np.rint(matrix @ matrix.T).astype(np.int64)
    return 100 * both >= percent * (size[:, None] + size[None, :] - both)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, recall: float = 0.9999) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Words are what white space (space, \\t to \\r) parts, A-Z lower-cased; a document's set holds its distinct runs of ``shingle`` words,
    or its whole sequence if it has fewer. Documents with 100 * intersection >= ``percent`` * union are linked, on full sets;
    component_id is the smallest key reachable and kept marks it. Texts that are null or without words have an empty set and link with nothing.
    A null key has a null component and is kept. Rows that repeat a key are one document, so all its texts are in one component, n_shingles being
    each row's own. Empty tables give empty results; other columns don't matter.

    Chosen-path trees find a pair at the threshold with probability ``recall`` at least, even where nodes branch up to the greatest depth.
    Nothing is capped, and a large node or family takes rows in proportion to its size unless many of its members are apart.
    """
    threshold = percent / 100
    least = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / VALUES)
    marked = base.save(_signatures(docs, key, text, shingle), "signatures")
    classes = base.save(marked.where("n > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch")), "classes")

    def linked(parts: list[DataFrame]) -> DataFrame:
        nodes = functools.reduce(DataFrame.union, [p.select("node", "rep") for p in parts])
        return base.save(_candidates(nodes.join(classes.select("rep", "sketch"), "rep"), least), "candidates")

    level = base.save(_counted(_rooted(classes, trees(recall, threshold, DEPTH), threshold)), "nodes")
    large = level.where(F.col("n") > SMALL)
    links = linked([level.where(F.col("n") <= SMALL), with_pivots(large)])
    candidates = base.save(graph.components(links), "families")
    more = []
    for depth in range(1, DEPTH + 1):
        if not large.limit(1).count():
            break
        nodes, mixed = _parted(large, candidates, BLOCK)
        more.append(nodes)
        if depth == DEPTH:
            more.append(in_blocks(mixed, "node", "rep", "n", BLOCK))
            break
        level = base.save(_counted(_branch(mixed.select("node", "rep").join(classes.select("rep", "sig"), "rep"), threshold)), "nodes")
        more.append(level.where(F.col("n") <= SMALL))
        large = level.where(F.col("n") > SMALL)
    if more:
        known = candidates.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        candidates = base.save(graph.components(known.union(linked(more))), "families")
    sized = candidates.select(F.col("id").alias("rep"), F.col("component").alias("node"))
    sized = sized.join(sized.groupBy("node").agg(F.count("*").alias("n"), F.array(*_lowest("node", PIVOTS[1])).alias("pivots")), "node")
    texts = docs.select(F.col(f"`{key}`").cast("long").alias("rep"), F.col(f"`{text}`").alias("_text")).where("_text is not null")
    texts = texts.join(base.small(sized), "rep")

    def start():
        import pyarrow as pa

        def work(batch):
            out = []
            for _, part in kernel.chunks(kernel.as_bytes(batch.column("_text"))):
                doc, s = shingle_sets(kernel.Words(part, kernel.SPACED), shingle)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                out += [s[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            return [pa.array(out, pa.binary())]

        return work

    sets = base.save(base.append_columns(texts, [T.StructField("shingles", T.BinaryType())], start).drop("_text").where(F.octet_length("shingles") > 0), "sets")
    large = sets.where(F.col("n") > BLOCK)
    alike = base.save(_verified(sets.where(F.col("n") <= BLOCK).union(with_pivots(large)), percent), "alike")
    found = base.save(graph.components(alike), "components")
    known = found.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b"))
    again = []
    if large.limit(1).count():
        nodes, mixed = _parted(large.drop("shingles"), found, BLOCK)
        rest = nodes.select("node", "rep").union(in_blocks(mixed, "node", "rep", "n", BLOCK).select("node", "rep")).distinct()
        again.append(_verified(rest.join(large.select("rep", "shingles"), "rep"), percent))
    own = marked.where("n > 0 and id is not null")
    several = own.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("low"), F.max(F.struct("h1", "h2")).alias("high")).where("low <> high").select("id")
    if several.limit(1).count():  # one key, several texts
        again.append(own.join(several, "id").join(classes.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("id").alias("a"), F.col("rep").alias("b")))
    if again:
        found = graph.components(functools.reduce(DataFrame.union, again, known))
    labelled = classes.select("h1", "h2", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    joined = marked.select("id", "h1", "h2", "n").join(labelled, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
