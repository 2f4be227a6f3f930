import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import aggregates, cluster, evaluation, filters, joins, mixture, packing, selection, sessions


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


# --- packing -------------------------------------------------------------------------------------------------------------------------


def fold(lengths, block):
    out, number, filled = [], 0, 0
    for n in lengths:
        if filled + n > block and filled:
            number, filled = number + 1, 0
        out.append((number, filled))
        filled += n
    return out


@pytest.mark.parametrize("lengths", [[3, 4, 3, 5], [10], [12, 1], [1, 12, 1], [5, 5, 1], []])
def test_greedy_blocks(spark, lengths):
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate(lengths)], "k string, i int, n bigint")
    expected = [(i, *b) for i, b in enumerate(fold(lengths, 10))]
    assert rows(packing.greedy_blocks(df, ["k"], "i", "n", 10).select("i", "block", "offset")) == expected
    assert rows(packing.greedy_blocks_small(df, ["k"], "i", "n", 10).select("i", "block")) == [(i, b) for i, b, _ in expected]


def test_partitions_do_not_matter(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), "id", (F.xxhash64("id") % 7 + 7).alias("n"))
    one = rows(packing.greedy_blocks(df.repartition(1), ["k"], "id", "n", 20).select("k", "id", "block"))
    assert one == rows(packing.greedy_blocks(df.repartition(9), ["k"], "id", "n", 20).select("k", "id", "block"))


def test_block_layout(spark):
    df = spark.createDataFrame([("k", 0, 2, [5, 6]), ("k", 1, 3, [7, 8, 9])], "k string, i int, n int, ids array<int>").withColumn("block", F.lit(0))
    r = packing.block_layout(df, ["k"], "i", "n", "ids", 10).first()
    assert (r["lengths"], r["position_ids"], r["cu_seq_lens"], r["input_ids"], r["max_length"]) == ([2, 3], [0, 1, 0, 1, 2], [0, 2, 5], [5, 6, 7, 8, 9], 3)
    assert sum(r["lengths"]) == len(r["input_ids"])
    assert packing.fitting(packing.block_layout(df, ["k"], "i", "n", block=2), 2).count() == 0


def test_documents(spark):
    df = spark.createDataFrame([("v", "hi", [1, 2])], "v string, t string, s array<int>")
    d = df.select(
        packing.speak_document(F.col("v"), F.col("t"), F.col("s")).alias("a"), packing.listen_document(F.col("s"), F.lit("en"), F.col("t")).alias("b"),
        packing.generated_tokens(F.lit("x<|speech_start|><|s_1|><|speech_start|><|s_7|><|s_8|>")).alias("c"), packing.balanced_slices(F.array(*map(F.lit, range(5))), 2).alias("d"),
        packing.placeholder_ids(F.array(F.lit(1)), 9, F.lit(650), F.array(F.lit(2))).alias("e"),
    ).first()
    assert d["a"] == "<|im_start|>v: hi<|speech_start|><|s_1|><|s_2|><|im_end|>"
    assert d["b"] == "<|im_start|><|STT|><|s_1|><|s_2|><|en|>hi<|im_end|>"
    assert (d["c"], d["d"], d["e"]) == ([7, 8], [[0, 1], [2, 3], [4]], [1, 9, 9, 2])
    told = packing.expressive_documents(df.withColumns({"d": F.lit("a calm voice"), "c": F.lit("calm")}), "v", "t", "d", "c", "s").orderBy("task").collect()
    assert [r["document"] for r in told] == [
        "<|im_start|>v: hi<|description|>a calm voice<|speech_start|><|s_1|><|s_2|><|im_end|>",
        "<|im_start|>v: hi<|description|>calm<|speech_start|><|s_1|><|s_2|><|im_end|>",
        "<|im_start|><|s_1|><|s_2|><|description|>a calm voice<|im_end|>",
        "<|im_start|><|s_1|><|s_2|><|description_category|>calm<|im_end|>",
    ]


# --- mixtures -------------------------------------------------------------------------------------------------------------------------


def test_mixture_index(spark):
    assert mixture.mixture_index(spark, [100, 40], [1, 1]).count() == 140
    got = mixture.mixture_index(spark, [100, 40], [0.25, 3.0]).groupBy("dataset").agg(F.count("*"), F.max("row"), F.count_distinct("row"))
    (a, b) = rows(got)
    assert a[1] == 25 and a[2] >= 96 and b[1:] == (120, 39, 40)


def test_parse_spec():
    assert mixture.parse_spec("a,b") == [("a", 1.0), ("b", 1.0)]
    assert mixture.parse_spec("a:2.0, b:0.5") == [("a", 2.0), ("b", 0.5)]
    assert mixture.parse_spec("/x/y/tts:1.5,hf://user/set,") == [("/x/y/tts", 1.5), ("hf://user/set", 1.0)]


@pytest.mark.parametrize("weight", [0.1, 0.3, 0.37, 0.999, 1.0, 2.6])
def test_strided(spark, weight):
    n = 97
    count = max(1, round(n * weight))
    expected = sorted(np.floor(np.linspace(0, n, count, endpoint=False)).astype(int).tolist() if count <= n else [i % n for i in range(count)])
    df = spark.range(n).withColumn("k", F.lit(1))
    assert sorted(r["id"] for r in mixture.strided(df, ["k"], "id", weight).collect()) == expected


def test_vocabulary(spark):
    old = spark.createDataFrame([("b", 0), ("a", 1)], "token string, pos bigint")
    new = mixture.append_vocabulary(old, spark.createDataFrame([("d",), ("c",), ("a",), (None,)], "token string"))
    assert rows(new, "pos") == [("b", 0), ("a", 1), ("c", 2), ("d", 3)]
    assert mixture.broken_prefix(old, new).count() == 0


# --- selection ------------------------------------------------------------------------------------------------------------------------


def test_pick_with_caps(spark):
    data = [("g", f"s{i % 3}", f"text {i // 2}", i) for i in range(60)]
    got = rows(selection.pick_with_caps(spark.createDataFrame(data, "g string, s string, t string, i int"), "g", "s", "t", ["i"], (4, 8, None), 20, 22).select("i", "cap"))

    def scan(cap):
        picked, seen, by = [], set(), {}
        for _, s, t, i in data:
            if len(picked) < 22 and t not in seen and (cap is None or by.get(s, 0) < cap):
                picked.append(i)
                seen.add(t)
                by[s] = by.get(s, 0) + 1
        return picked

    cap = next((c for c in (4, 8, None) if len(scan(c)) >= 20), None)
    assert got == [(i, cap) for i in scan(cap)]


def test_budget_round_robin(spark):
    sizes = {"a": [5, 9, 1], "b": [4, 4], "c": [30, 1]}
    df = spark.createDataFrame([(f, i, s) for f, ss in sizes.items() for i, s in enumerate(ss)], "f string, i int, s int")
    total, expected = 0, []
    for depth in itertools.count():
        took = False
        for f in sorted(sizes):
            if depth < len(sizes[f]) and total + sizes[f][depth] <= 15:
                total, took = total + sizes[f][depth], True
                expected.append((f, depth))
        if not took:
            break
    assert rows(selection.budget_round_robin(df, "f", "i", "s", 15).where("taken").select("f", "i")) == sorted(expected)


def test_dealing_out(spark):
    assert selection.linspace_bounds(10, 3) == [(0, 3), (3, 6), (6, 10)]
    files = spark.createDataFrame([(i, 10 - i) for i in range(7)], "i int, s int")
    assert [r["worker"] for r in selection.snake(files, "s", "i", 3).orderBy("i").collect()] == [0, 1, 2, 2, 1, 0, 0]
    assert [r["chunk"] for r in selection.near_equal_chunks(files, "i", 3).orderBy("i").collect()] == [0, 0, 0, 1, 1, 2, 2]
    assert selection.hash_sample(files.withColumn("k", F.lit(1)), ["k"], "i", 3).count() == 3


# --- joins ----------------------------------------------------------------------------------------------------------------------------


def test_cyclic_partner(spark):
    texts = ["a", "a", "b", "c", "a"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, "x"), (2, 1, "x")], "k int, i int, t string")
    got = rows(joins.cyclic_partner(df, ["k"], [F.col("i")], "t").select("k", "i", "partner"))
    assert [p for k, _, p in got if k == 1] == ["b", "b", "c", "a", "b"]
    assert [p for k, _, p in got if k == 2] == ["x", "x"]


def test_lookups(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "k int, v string, o int")
    assert rows(joins.left_lookup(left, right, "k", "v", "o", "")) == [(1, "b"), (2, "")]
    assert rows(joins.excluding(left, spark.createDataFrame([(2,)], "x int"), "k")) == [(1,)]
    pairs = joins.similar_pairs(spark.createDataFrame([(1, 0, [1.0, 0.0], "long a"), (1, 1, [1.0, 0.1], "long b"), (1, 2, [0.0, 1.0], "long c"), (2, 3, [1.0, 0.0], "long d")], "s int, i int, v array<double>, t string"), ["s"], "i", "v", 0.9, "t")
    assert rows(pairs.select("a", "b")) == [(0, 1), (1, 0)]


def test_next_at_or_after(spark):
    a = spark.createDataFrame([(1, 0), (1, 5), (1, 9)], "k int, t int")
    b = spark.createDataFrame([(1, 5, "x"), (1, 7, "y")], "k int, u int, v string")
    assert rows(joins.next_at_or_after(a, b, ["k"], "t", "u", "v").select("t", "v")) == [(0, "x"), (5, "x"), (9, None)]


# --- events ---------------------------------------------------------------------------------------------------------------------------


def brute_sessions(track, enter, peak, least, gap, fps):
    if max(track) < peak:
        return []
    padded = [track[1] if len(track) > 1 else track[0], track[0], *track, track[-1], track[-2] if len(track) > 1 else track[0]]
    smooth = [sorted(padded[i : i + 5])[2] for i in range(len(track))]
    runs, start = [], None
    for i, s in enumerate([*smooth, -1]):
        if s >= enter and start is None:
            start = i
        elif s < enter and start is not None:
            runs.append([start, i])
            start = None
    merged = []
    for a, b in runs:
        if merged and (a - merged[-1][1]) / fps < gap:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [(a / fps, b / fps, max(smooth[a:b])) for a, b in merged if (b - a) / fps >= least and max(smooth[a:b]) >= peak]


def test_sessions(spark):
    rng = np.random.default_rng(3)
    tracks = {k: np.round(np.clip(np.repeat(rng.random(12), 10) + rng.normal(0, 0.1, 120), 0, 1), 3).tolist() for k in range(6)} | {9: [0.7], 10: [0.7, 0.1]}
    df = spark.createDataFrame([(k, i, x) for k, t in tracks.items() for i, x in enumerate(t)], "k int, i int, x double")
    got = rows(sessions.sessions(df, ["k"], "i", "x", 0.4, 0.6, 0.2, 0.3, 10.0).select("k", "onset", "offset", "peak"))
    assert got == [(k, *s) for k in sorted(tracks) for s in brute_sessions(tracks[k], 0.4, 0.6, 0.2, 0.3, 10.0)]


def test_place_tags(spark):
    df = spark.createDataFrame([([(0.0, 1.0, "hello"), (2.0, 3.0, "there")], [(1.2, 1.8, "cough"), (2.1, 2.9, "laughter"), (3.5, 4.0, "sigh")], "en")], "w array<struct<start: double, end: double, text: string>>, e array<struct<onset: double, offset: double, family: string>>, l string")
    r = sessions.place_tags(df, "w", "e", "l").first()
    assert r["tagged_text"] == "hello <|sfx:cough|>Ahem there <|sfx:sigh|>Hah"
    assert r["nv_text"] == "hello [cough] there [laughter] [sigh]"
    assert r["n_placed"] == 2 and [p["overlap"] for p in r["placed"]] == [0.0, 1.0, 0.0]


# --- clusters -------------------------------------------------------------------------------------------------------------------------


def test_constrained_clusters(spark):
    rng = np.random.default_rng(5)
    centers = np.linalg.qr(rng.standard_normal((8, 8)))[0]
    data = [(0, "f" if c < 2 else "m", 100 * c + i, (centers[c] + rng.normal(0, 0.05, 8)).tolist()) for c in range(3) for i in range(6 + c)]
    data.append((0, "f", 999, (centers[0] + 1.2 * centers[5]).tolist()))
    df = spark.createDataFrame(data, "place int, kind string, id int, v array<double>")
    got = {r["id"]: r["spk"] for r in cluster.constrained(df, "place", "kind", "id", "v").collect()}
    assert len({got[i] for i in got}) == 3
    assert got[999] == got[0] and got[200] == "spk00"  # folded into its nearest; the largest cluster is the first


def test_silhouette(spark):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((12, 5))
    c = [0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 3]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    s = []
    for i in range(12):
        own = [j for j in range(12) if c[j] == c[i] and j != i]
        b = min(np.mean([d[i, j] for j in range(12) if c[j] == k]) for k in set(c) - {c[i]})
        s.append(0 if not own else (b - d[i, own].mean()) / max(b, d[i, own].mean()))
    df = spark.createDataFrame([(1, i, c[i], v[i].tolist()) for i in range(12)], "g int, i int, c int, v array<double>")
    assert cluster.silhouette(df, ["g"], "i", "c", "v").first()["silhouette"] == pytest.approx(np.mean(s))


# --- filters and scores ---------------------------------------------------------------------------------------------------------------


def test_funnel(spark):
    df = spark.createDataFrame([("", 1), ("a b c", 2), ("a", 2), (None, 3)], "t string, n int")
    f = filters.funnel(df, ("empty", filters.blank(F.col("t"))), ("wordy", filters.wordier_than(F.col("t"), F.col("n"))))
    assert rows(filters.funnel_counts(f)) == [("empty", 2), ("kept", 1), ("wordy", 1)]
    assert filters.funnel_summary(f, ["empty", "wordy"]).first().asDict() == {"kept": 1, "empty": 2, "wordy": 1}


def test_predicates(spark):
    def holds(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    good = " ".join(f"word{i}" for i in range(25))
    assert holds(filters.acceptable_text(F.lit(good)))
    assert not holds(filters.acceptable_text(F.lit("**" + good)))
    assert not holds(filters.acceptable_text(F.lit(good + " привет")))
    assert not holds(filters.acceptable_text(F.lit("a b c d e " * 5)))
    assert holds(filters.enough_text(F.lit("word " * 10))) and not holds(filters.enough_text(F.lit("x" * 50)))
    assert all(holds(filters.enough_text(F.lit(c * 40))) for c in "漢ཀ豈䷀ก")
    assert holds(filters.duration_between(F.lit(16000))) and not holds(filters.duration_between(F.lit(100)))
    tagged = filters.tag_filter(spark.createDataFrame([("a <|sfx:burping|>Burp b",)], "t string"), "t").first()
    assert tagged["t"] == "a Burp b" and tagged["no_tag_left"]


def test_scores(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 3.0), ("a", 2, 6.0), ("b", 1, 10.0), ("b", 2, None)], "l string, i int, s double")
    fine, by_language, overall = evaluation.nested_means(df, "s", ["l", "i"])
    assert rows(by_language) == [("a", 4.0), ("b", 10.0)] and overall.first()[0] == 7.0 and fine.count() == 3
    adv = evaluation.group_advantage(df.where("s is not null"), "l", "s").orderBy("s").collect()
    assert adv[-1]["advantage"] == 0.0 and adv[0]["advantage"] == pytest.approx((1 - 10 / 3) / (np.std([1, 3, 6], ddof=1) + 1e-8))
    runs = spark.createDataFrame([("x", "ok", 1.0, 5.0), ("y", "ok", None, 2.0), ("z", "failed", 0.1, 0.1)], "r string, st string, dev double, tr double")
    assert rows(evaluation.leaderboard(runs, "r", "st", "dev", "tr").select("r", "metric", "place")) == [("x", 5.0, 2), ("y", 2.0, 1), ("z", None, None)]
    assert "| — | z |" in [r["line"] for r in evaluation.markdown(evaluation.leaderboard(runs, "r", "st", "dev", "tr"), "place", [F.col("r")]).collect()]
    logs = spark.createDataFrame([("x", i, float(i), None if i % 2 else i / 10) for i in range(20)], "r string, i int, l double, d double")
    s = evaluation.run_summaries(logs, "r", "i", "l", {"t": "d"}).first()
    assert (s["final_loss"], s["last_mean_loss"], s["t_final"], s["t_min"], s["t_points"], s["dev_mean"]) == (19.0, 14.5, 1.8, 0.0, 10, 1.8)
    top = spark.range(1).select(*[c.alias(k) for k, c in evaluation.top_two(F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1)), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).items()]).first()
    assert top["label"] == "b" and top["margin"] == pytest.approx(0.5)
    heat = evaluation.heat_map(df, "l", "i", "s", ["1", "2"]).orderBy("l").collect()
    assert heat[0]["mean"] == 4.0 and heat[1]["2"] is None


def test_bins(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)] + [(float("nan"),)], "v double")
    got = dict(aggregates.binned(df, "v", ("low", "mid", "high")).select("v", "label").where("not isnan(v)").collect())
    assert got[0.0] == got[35.0] == "low" and got[36.0] == "mid" and got[100.0] == "high"
    same = aggregates.bin_edges(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 2).first()["edges"]
    assert same == [1.5, 2.0, 2.5]


@pytest.mark.parametrize("n", [0, 1, 2, 101, 1000])
def test_exact_percentiles(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n), 1)  # many ties
    points = (0.0, 0.05, 0.5, 0.95, 1.0)
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(values)] + [(0, None), (1, float("nan"))], "g int, v double")
    (got,) = rows(aggregates.exact_percentiles(df, "v", points))
    assert got[0] == [None] * 5 if n == 0 else np.allclose(got[0], np.quantile(values, points), atol=1e-12)
    grouped = {r["g"]: r["p"] for r in aggregates.exact_percentiles(df, "v", points, ["g"]).collect()}
    assert set(grouped) == set(range(min(n, 3)))
    for g, p in grouped.items():
        assert np.allclose(p, np.quantile(values[g::3], points), atol=1e-12)


def test_similar_pairs_of_a_large_key(spark, monkeypatch):
    monkeypatch.setattr(joins, "KEY_ROWS", 7)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 4))
    keys = [None if i % 2 else 1 for i in range(60)]
    df = spark.createDataFrame([(k, i, [float(x) for x in u]) for i, (k, u) in enumerate(zip(keys, v, strict=True))], "s int, i int, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    expected = {(a, b) for a in range(60) for b in range(60) if a != b and keys[a] == keys[b] and u[a] @ u[b] >= 0.6}
    got = [(r["a"], r["b"]) for r in joins.similar_pairs(df, ["s"], "i", "v", 0.6).collect()]
    assert len(got) == len(expected) and set(got) == expected


def test_similar_pairs_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(joins, "KEY_ROWS", 3)
    monkeypatch.setattr(joins, "STRIP", 4)
    monkeypatch.setattr(joins, "SENT_PAIRS", 2)
    nan, inf = float("nan"), float("inf")
    odd = [[0.0, 0.0], [nan, 1.0], [inf, 1.0], None, [1.0, None], [], [1.0], [2.0], [3.0, 4.0, 0.0], [1.0, 0.0], [0.6, 0.8], [0.0, 1.0], *[[1.0, 1.0]] * 9]
    good = [(i, np.array(v) / np.linalg.norm(v)) for i, v in enumerate(odd) if v and None not in v and np.isfinite(v).all() and any(v)]
    texts = [f"text number {i // 2}" for i in range(len(odd))]
    df = spark.createDataFrame([("s", i, v, t) for i, (v, t) in enumerate(zip(odd, texts, strict=True))] + [("s", None, [1.0, 1.0], "no number")], "s string, i int, v array<float>, t string")
    for text in (None, "t"):
        expected = sorted((a, b) for a, u in good for b, v in good if a != b and len(u) == len(v) and u @ v >= 0.6 - 1e-6 and (text is None or texts[a] != texts[b]))
        assert rows(joins.similar_pairs(df, ["s"], "i", "v", 0.6 - 1e-6, text).select("a", "b")) == expected


def test_similar_pairs_of_many_rows_of_a_key(spark):
    u = np.random.default_rng(3).normal(size=(12_000, 32)).astype(np.float32)
    df = spark.createDataFrame([(i, 1, v) for i, v in enumerate(u.tolist())], "i int, s int, v array<float>")
    u = u.astype(float) / np.linalg.norm(u.astype(float), axis=1, keepdims=True)
    a, b = np.nonzero(u @ u.T >= 0.6)
    began = time.perf_counter()
    got = {(r["a"], r["b"]): r["similarity"] for r in joins.similar_pairs(df, ["s"], "i", "v", 0.6).collect()}
    assert time.perf_counter() - began < 60  # 72 million cosines; row by row in expressions they take minutes
    assert got.keys() == {(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True) if x != y}
    assert all(abs(s - u[x] @ u[y]) < 1e-12 for (x, y), s in got.items())


def test_sums_in_order(spark):
    rng = np.random.default_rng(5)
    data = [(int(k), i, float(x) if i % 7 else None) for i, (k, x) in enumerate(zip(rng.integers(0, 5, 900), rng.normal(size=900) * 10.0 ** rng.integers(-8, 8, 900), strict=True))] + [(9, 1000, None), (None, 1001, 1.5)]
    df = spark.createDataFrame(data, "k int, i int, x double").repartition(13, F.xxhash64("i"))
    expected = []
    for k in [None, *range(5), 9]:
        values = [x for j, _, x in data if j == k and x is not None]
        s = 0.0
        for x in values:
            s += x
        expected.append((k, s if values else None, s / len(values) if values else None))
    assert rows(aggregates.in_order(df, ["k"], ["i"], s=F.sum("x"), m=F.avg("x")), "k") == expected


def test_archives_of_folders(spark):
    files = spark.createDataFrame([("a-0-1.zip",), ("a-1-1.zip",), ("a_neucodec.zip",), ("b.zip",), ("c_neucodec.zip",), ("README.md",), (None,)], "f string")
    index = joins.archive_index(files, "f")
    assert rows(index, "folder") == [("a", ["a-0-1.zip", "a-1-1.zip"], "a_neucodec.zip"), ("b", ["b.zip"], None), ("c", [], "c_neucodec.zip")]
    long = "five words that are long enough to tell a language by"
    df = spark.createDataFrame([(1, "a/x.mp3", long), (2, "a/x.mp3", "short"), (3, "b/x.mp3", long), (4, "c/x.mp3", long), (5, "none.mp3", long), (6, None, None)], "i int, p string, t string")
    assert rows(joins.eligible(df, index, "p", "t").select("i")) == [(1,)]


def test_token_funnel(spark):
    data = [(None, "a", 1.0, 9), (100, "a", 2.0, 0), (100, "a", 2.0, None), (10, "a", 0.2, 9), (60, "w " * 61, 1.2, 9), (60, "a", None, 9), (60, "a", 9.0, 9), (60, "a", 1.2, 9)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, n int, t string, s double, b int")
    steps = filters.token_funnel(F.col("n"), F.col("t"), F.col("s"), audio_bytes=F.col("b"))
    got = [r["reason"] for r in filters.funnel(df, *steps).orderBy("i").collect()]
    assert got == ["no_member", "empty_audio", "empty_audio", "token_length", "wordy", "unreadable", "length_mismatch", "kept"]


@pytest.mark.parametrize("seed", range(12))
def test_average_linkage_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 40))
    u = rng.normal(size=(n, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    if seed % 3 == 0:
        u = np.repeat(u, 2, axis=0)
    groups = [[i] for i in range(len(u))]
    apart = lambda a, b: np.mean([1 - u[i] @ u[j] for i in a for j in b])
    while len(groups) > 1:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: apart(groups[p[0]], groups[p[1]]))
        if not apart(groups[a], groups[b]) < 0.4:
            break
        groups[a] = sorted(groups[a] + groups.pop(b))
    got = cluster.average_linkage(u, 0.4)
    expected = np.zeros(len(u), int)
    for k, g in enumerate(sorted(groups)):
        expected[g] = k
    assert got.tolist() == expected.tolist()
