"""Lookups and other joins. Small sides are left to adaptive execution, which broadcasts them when it has measured them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import arrays
from corpusloom.functions import text as texts
from corpusloom.operators import filters

if TYPE_CHECKING:
    import pyarrow as pa


def inner_lookup(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "inner")


def left_lookup(left: DataFrame, right: DataFrame, key: str, value: str, order: str, default: object = None) -> DataFrame:
    """``left`` plus ``value``; of right rows with one key the last in order counts, and misses get ``default``."""
    last = right.groupBy(key).agg(F.max_by(value, order).alias(value))
    out = left.join(last, key, "left")
    return out if default is None else out.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def counted_lookup(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` plus ``value``, null and ``missing`` where there is none."""
    return left.join(right.select(key, value).dropDuplicates([key]), key, "left").withColumn("missing", F.col(value).isNull())


def excluding(df: DataFrame, rejected: DataFrame, *keys: str) -> DataFrame:
    """Rows none of whose ``keys`` is among the values of ``rejected``'s only column."""
    column = rejected.columns[0]
    for k in keys:
        df = df.join(rejected.select(F.col(column).alias(k)), k, "left_anti").select(*df.columns)
    return df


def not_done(df: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return df.join(done, on, "left_anti")


def wanted(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def hard_negatives(mined: DataFrame, verified: DataFrame, on: list[str]) -> DataFrame:
    """What was mined but not verified."""
    return mined.join(verified, on, "left_anti")


#: Rows of a key that one task compares with the key's others.
KEY_ROWS = 2_000


#: Rows that are read before whole groups of them are compared; products of a strip of a block, and pairs that are sent on at once.
GROUP_ROWS, STRIP, SENT_PAIRS = 4_096, 1 << 20, 1 << 18
#: What a matrix product may be off by; pairs that near below the threshold are computed anew.
SLACK = 1e-9


def _starts(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Where groups of equal ``columns`` begin, nulls being equal."""
    import pyarrow.compute as pc

    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        codes = pc.dictionary_encode(rows.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _whole_groups(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where a group of equal ``columns`` does."""
    import pyarrow as pa

    held = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= GROUP_ROWS:
            rows = pa.concat_tables(held)
            last = int(_starts(rows, columns)[-1])
            if last:
                yield rows.slice(0, last)
            held = [rows.slice(last)]
    if sum(t.num_rows for t in held):
        yield pa.concat_tables(held)


def _near(u: np.ndarray, starts: np.ndarray, part: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns of ``u`` within groups whose product is ``least`` at least: of the rows of part ``i`` with those of part ``j``, which come after them, or
    with each other, once, where the two are one."""
    for x, y in zip(starts, np.append(starts[1:], len(part)), strict=True):
        first = x + int(np.count_nonzero(part[x:y] == i[x]))
        alone = i[x] == j[x]
        low = x if alone else first
        step = max(1, STRIP // max(1, y - low))
        for s in range(x, first, step):
            e = min(s + step, first)
            a, b = np.nonzero(u[:, s:e].T @ u[:, low:y] >= least - SLACK)
            a, b = a + s, b + low
            if alone:
                a, b = a[a < b], b[a < b]
            for k in range(0, len(a), SENT_PAIRS):
                yield a[k : k + SENT_PAIRS], b[k : k + SENT_PAIRS]


def _gathered(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same pairs in pieces of ``SENT_PAIRS`` or a little more."""
    held, n = [], 0
    for pair in found:
        held.append(pair)
        n += len(pair[0])
        if n >= SENT_PAIRS:
            yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            held, n = [], 0
    if n:
        yield np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])


def similar_pairs(vectors: DataFrame, keys: list[str], order: str, vector: str, least: float = 0.88, text: str | None = None, least_chars: int = 5) -> DataFrame:
    """(keys, a, b, similarity): pairs within a key whose cosine is ``least`` at least, both ways round; with ``text``, only of different
    texts of ``least_chars`` characters. Null keys are equal; rows without ``order`` have no partners, nor have vectors that are null, zero or hold null or
    non-finite components, nor those of different lengths.

    A key's rows are dealt out into parts of about ``KEY_ROWS`` by hash, and each two parts meet in one task, as does each with itself, so no task has the whole square.
    Parts are compared by matrix products; the cosine of what is near enough, or nearly so, is then summed component by component.
    """
    rows = vectors.where(F.col(order).isNotNull() & F.col(vector).isNotNull())
    rows = rows if text is None else rows.where(F.length(text) >= least_chars)
    parts = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.ceil(F.count("*") / KEY_ROWS).cast("int").alias("_parts"))
    rows = rows.select(*keys, F.col(order).alias("_id"), F.col(vector).alias("_v"), *([F.col(text).alias("_t")] if text else []))
    sized = rows.join(parts, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    sized = sized.withColumn("_part", F.pmod(F.xxhash64("_id", "_v"), F.col("_parts")).cast("int")).withColumn("_met", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    own = [F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)]
    dealt = sized.select(*own, F.size("_v").alias("_d"), F.least("_part", "_met").alias("_i"), F.greatest("_part", "_met").alias("_j"), "_part", "_id", "_v", *(["_t"] if text else []))
    group = [*keys, "_i", "_j"]

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for table in _whole_groups(batches, ["_d", *group]):
            sizes = _starts(table, ["_d"])
            for x, y in zip(sizes, np.append(sizes[1:], table.num_rows), strict=True):
                part = table.slice(x, y - x).combine_chunks()
                m = part.column("_v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
                m = np.ascontiguousarray(m.reshape(y - x, -1).T)
                with np.errstate(all="ignore"):
                    norm = np.zeros(y - x)
                    for c in m:
                        norm += c * c
                    fit = (norm > 0) & (norm < np.inf)
                    part, u = part.filter(pa.array(fit)), m[:, fit] / np.sqrt(norm[fit])
                if part.num_rows == 0:
                    continue
                dealt_as = (part.column(c).to_numpy() for c in ("_part", "_i", "_j"))
                for a, b in _gathered(_near(u, _starts(part, group), *dealt_as, least)):
                    s = np.zeros(len(a))
                    for c in u:
                        s += c[a] * c[b]
                    keep = s >= least
                    if text:
                        told = part.column("_t")
                        keep &= pc.not_equal(told.take(pa.array(a)), told.take(pa.array(b))).to_numpy(zero_copy_only=False).astype(bool)
                    left, right = pa.array(a[keep]), pa.array(b[keep])
                    made = [*(part.column(k).take(left) for k in keys), part.column("_id").take(left), part.column("_id").take(right), pa.chunked_array([s[keep]])]
                    yield from pa.table(made, names=[*(f"_k{i}" for i in range(len(keys))), "a", "b", "similarity"]).combine_chunks().to_batches()

    from pyspark.sql.types import DoubleType, StructField, StructType

    kind = dealt.schema
    fields = [StructField(f"_k{i}", kind[k].dataType) for i, k in enumerate(keys)] + [StructField(c, kind["_id"].dataType) for c in "ab"]
    near = dealt.repartition(*group).sortWithinPartitions("_d", *group, "_part").mapInArrow(run, StructType([*fields, StructField("similarity", DoubleType())])).where("a <> b")
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))
    return near.select(*own, both.alias("p"), "similarity").select(*keys, F.col("p.x").alias("a"), F.col("p.y").alias("b"), "similarity")


def archive_index(files: DataFrame, name: str) -> DataFrame:
    """(folder, audio, tokens): of the zip files that a listing names, each folder's audio archives, its ``-<number>-<number>`` shards among them, and its token
    archive (the last by name); null or empty where there is none."""
    stem = F.regexp_extract(name, r"^(.*)\.zip$", 1)
    told = files.where(F.endswith(name, F.lit(".zip"))).select(F.col(name).alias("_f"), stem.alias("_s"), F.endswith(stem, F.lit(texts.TOKEN_SUFFIX)).alias("_t"))
    folder = F.when(F.col("_t"), F.substring(F.col("_s"), F.lit(1), F.length("_s") - len(texts.TOKEN_SUFFIX))).otherwise(texts.shard_base(F.col("_s")))
    return told.groupBy(folder.alias("folder")).agg(F.array_sort(F.collect_set(F.when(~F.col("_t"), F.col("_f")))).alias("audio"), F.max(F.when(F.col("_t"), F.col("_f"))).alias("tokens"))


def eligible(df: DataFrame, index: DataFrame, path: str, text: str) -> DataFrame:
    """Rows in a folder that has both audio and token archives, with a text long enough to judge its language."""
    whole = index.where((F.size("audio") > 0) & F.col("tokens").isNotNull()).select(F.col("folder").alias("_folder"))
    fit = df.where(filters.enough_text(texts.strip(F.col(text)))).withColumn("_folder", texts.folder(F.col(path)))
    return fit.join(whole, "_folder", "left_semi").select(*df.columns)


def interval_overlap(events: DataFrame, words: DataFrame, file: str, event: str, onset: str, offset: str, start: str, end: str, width: float = 60.0) -> DataFrame:
    """Events plus ``overlap``, the seconds that words of their file cover. Both sides are cut into bins of ``width`` seconds, so the join
    is on equal keys and a long file doesn't meet itself whole."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.greatest(F.floor(F.col(b) / width), F.floor(F.col(a) / width))))
    left = events.select(file, event, onset, offset).withColumn("_bin", bins(onset, offset))
    right = words.select(F.col(file), F.col(start).alias("_s"), F.col(end).alias("_e")).withColumn("_bin", bins("_s", "_e"))
    low, high = F.greatest(F.col(onset), F.col("_s"), F.col("_bin") * width), F.least(F.col(offset), F.col("_e"), (F.col("_bin") + 1) * width)
    shared = left.join(right, [file, "_bin"]).groupBy(file, event).agg(F.sum(F.greatest(F.lit(0.0), high - low)).alias("overlap"))
    return events.join(shared, [file, event], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))


def next_at_or_after(left: DataFrame, right: DataFrame, keys: list[str], at: str, other: str, value: str) -> DataFrame:
    """``left`` plus the ``value`` of the first right row at or after its time (the as-of join forward), null if none: one sort of both sides."""
    a = left.withColumn("_at", F.col(at)).withColumn("_side", F.lit(0)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, F.col(other).alias("_at"), F.lit(1).alias("_side"), F.col(value).alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True)
    ahead = W.partitionBy(*keys).orderBy("_at", "_side").rowsBetween(W.currentRow, W.unboundedFollowing)
    found = both.withColumn(value, F.first("_value", ignorenulls=True).over(ahead)).where("_side = 0")
    return found.drop("_at", "_side", "_value")


def with_retries(df: DataFrame, retries: int) -> DataFrame:
    """Each row once a retry."""
    return df.withColumn("retry", F.explode(F.sequence(F.lit(0), F.lit(retries - 1))))


def cyclic_partner(df: DataFrame, keys: list[str], order: list[Column], text: str) -> DataFrame:
    """Adds ``partner``: the text of the nearest later row, cyclically, that differs from the own; if all are equal, the next row's.

    Runs of equal texts are numbered; the partner is the first text of the next run, the first run following the last. A first run equal to the
    last is skipped for the second one.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    whole = W.partitionBy(*keys)
    rows = df.withColumn("_new", F.when(F.lag(text).over(w).eqNullSafe(F.col(text)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    starts = F.when(F.col("_new") == 1, F.col(text))
    rows = rows.withColumn("_next", F.first(starts, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)))
    rows = rows.withColumn("_first", F.max(F.when((F.col("_run") == 1) & (F.col("_new") == 1), F.col(text))).over(whole))
    rows = rows.withColumn("_second", F.max(F.when((F.col("_run") == 2) & (F.col("_new") == 1), F.col(text))).over(whole))
    wrapped = F.when(F.col("_first") != F.col(text), F.col("_first")).otherwise(F.coalesce("_second", F.col(text)))
    return rows.withColumn("partner", F.coalesce("_next", wrapped)).drop("_new", "_run", "_next", "_first", "_second")


#: Centroids that are fetched and broadcast; where there are more, they are joined.
CENTROIDS = 5_000


def nearest(rows: DataFrame, centroids: DataFrame, key: str, vector: str, centroid: str, center: str, within: list[str] | None = None) -> DataFrame:
    """(key, centroid, similarity): the centroid of greatest cosine, the smallest name of equals.

    Up to ``CENTROIDS`` of them are fetched and broadcast as one array (of each group) and compared within the row, so nothing is shuffled; more are
    joined.
    """
    few = centroids.limit(CENTROIDS + 1).collect()  # once, as they may be dear to compute
    if len(few) <= CENTROIDS:
        centroids = rows.sparkSession.createDataFrame(few, centroids.schema)
        told = F.collect_list(F.struct(F.col(centroid).alias("name"), arrays.unit(F.col(center)).alias("c"))).alias("_all")
        lists = centroids.groupBy(*(within or [])).agg(told)
        met = rows.withColumn("_u", arrays.unit(F.col(vector)))
        met = met.join(F.broadcast(lists), within) if within else met.crossJoin(F.broadcast(lists)).where(F.size("_all") > 0)
        best = F.array_min(F.transform("_all", lambda x: F.struct((-arrays.dot(F.col("_u"), x["c"])).alias("s"), x["name"].alias("name"))))
        return met.select(*(within or []), key, best.alias("_b")).select(*(within or []), key, F.col("_b.name").alias(centroid), (-F.col("_b.s")).alias("similarity"))
    a, b = rows.withColumn("_u", arrays.unit(F.col(vector))), centroids.withColumn("_c", arrays.unit(F.col(center)))
    joined = a.join(b.select(*(within or []), centroid, "_c"), within) if within else a.crossJoin(b.select(centroid, "_c"))
    scored = joined.select(*(within or []), key, centroid, arrays.dot(F.col("_u"), F.col("_c")).alias("similarity"))
    best = scored.groupBy(*(within or []), key).agg(F.min_by(centroid, F.struct(-F.col("similarity"), F.col(centroid))).alias(centroid), F.max("similarity").alias("similarity"))
    return best.select(*(within or []), key, centroid, "similarity")
