import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import capjoin, graph, linededup, minhash


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(3, 3), (5, 4), (4, 5), (9, 7), (7, 5)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    nodes = {x for ab in links if ab[0] != ab[1] for x in ab}
    assert {r["id"]: r["component"] for r in graph.components(df).collect()} == components(nodes, [(a, b) for a, b in links if a != b])


@pytest.mark.parametrize("hub", [graph.HUB, 3])
def test_components_random(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, i) for i in range(400, 440)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components({x for ab in links if ab[0] != ab[1] for x in ab}, links)


# --- near-duplicate documents ---------------------------------------------------------------------------------------------------------


def shingles(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def family_texts(seed, families=12, size=14):
    """Families of edited copies, at every similarity; exact copies; a line that all share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    texts = []
    for _ in range(families):
        base = [word() for _ in range(rng.choice([3, 20, 60, 120]))]
        for k in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12)) if k else 0):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w) + ("\nthe one line that all of them share here" if rng.random() < 0.5 else ""))
    return texts + texts[:9] + ["", "  ", None, "one", "one", "ONE", "two words"]


@pytest.mark.parametrize("small, block, depth", [(48, 256, 5), (4, 8, 2), (2, 4, 1)])
def test_near_duplicates(spark, monkeypatch, small, block, depth):
    for name, value in (("SMALL", small), ("BLOCK", block), ("DEPTH", depth)):
        monkeypatch.setattr(minhash, name, value)
    texts = family_texts(5)
    sets = [shingles(t, 4) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = components(range(len(texts)), links)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, component_id string")
    got = minhash.near_duplicates(df, shingle=4).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["n_shingles"] == len(sets[r["doc_id"]])
        assert r["component_id"] == expected[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (8, "a b c d e f"), (9, None)]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, None, True), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True)], key=str)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_of_one_key_with_several_texts(spark):
    rows = [(3, "a b c d e f"), (5, "a b c d e f"), (5, "g h i j k l"), (9, "g h i j k l"), (2, "m n o p q r"), (9, "s t u v w x"), (4, "s t u v w x")]
    got = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(3, 3), (5, 3), (5, 3), (9, 3), (2, 2), (9, 3), (4, 3)])


def test_similar_is_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(1, 60)).astype(np.uint64)) for _ in range(30)]
    got = minhash.similar(sets, 60)
    for i, j in itertools.product(range(30), repeat=2):
        a, b = set(sets[i].tolist()), set(sets[j].tolist())
        assert got[i, j] == (100 * len(a & b) >= 60 * len(a | b))


# --- embeddings -----------------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((300, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    c = rng.uniform(0.85, 0.99, (300, 1))
    clump = x[0] + rng.normal(0, 0.01, (80, 64))
    m = np.vstack([x, c * x + np.sqrt(1 - c * c) * y, clump, x[5:9], 3 * x[9:10]]).astype(np.float32)
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    expected = components(range(len(m)), np.argwhere(g).tolist())
    bad = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0] * 63 + [None], [float("inf")] * 64, [1.0, 0.0]]
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(5000 + i, b) for i, b in enumerate(bad)] + [(None, m[0].tolist())]
    got = capjoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
        elif r["vec_id"] >= 5000:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
        else:
            assert (r["n_links"], r["component_id"]) == (g[r["vec_id"]].sum(), expected[r["vec_id"]])
    assert capjoin.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_crowded_filters_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(capjoin, "BLOCK", 16)
    rng = np.random.default_rng(9)
    m = np.vstack([rng.standard_normal(64) + rng.normal(0, 0.3, (60, 64)) for _ in range(3)])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    g = u @ u.T >= 0.9
    np.fill_diagonal(g, False)
    got = {r["vec_id"]: r["n_links"] for r in capjoin.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")).collect()}
    assert got == {i: int(g[i].sum()) for i in range(len(m))}


def test_recall_at_the_threshold():
    rng = np.random.default_rng(10)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((2000, 64))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    m = np.vstack([x, 0.9 * x + math_sqrt(0.19) * y])
    rows, filters = capjoin.Codes(len(m), 64, 0.9).decode(m)
    sets = [set() for _ in m]
    for i, f in zip(rows.tolist(), filters.tolist()):
        sets[i].add(f)
    assert sum(bool(sets[i] & sets[i + 2000]) for i in range(2000)) >= 1996


def math_sqrt(v):
    return float(np.sqrt(v))


# --- lines ----------------------------------------------------------------------------------------------------------------------------


def make_lines(seed):
    rng = random.Random(seed)
    sentence = lambda: " ".join("".join(rng.choices("abcdefghij", k=3)) for _ in range(rng.randint(2, 14))).capitalize() + rng.choice([".", "!", ". "])
    passages = [" ".join(sentence() for _ in range(rng.randint(4, 9))) for _ in range(6)]
    docs = []
    for _ in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.2 else " ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 6))]
        docs.append("\n".join(parts))
    return docs + docs[:5] + ["", None, "Short.", "Rep it now. " * 30]


def plain_units(text):
    """The units of a text as lists of words: lines, cut after words that end in . ! or ?"""
    out = []
    for line in re.split("\n", text or ""):
        unit = []
        for word in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line)):
            unit.append(word)
            if word[-1] in ".!?":
                out.append(tuple(unit))
                unit = []
        if unit:
            out.append(tuple(unit))
    return out


def repeats(texts, least=30):
    """For each text which of its units lie in a run of ``least`` words that stands at any earlier place, every pair of places being compared."""
    docs = [plain_units(t) for t in texts]
    gone = [[False] * len(d) for d in docs]
    at = {}
    for i, d in enumerate(docs):
        for k, unit in enumerate(d):
            for j, m in at.get(unit, []):
                n = 0
                while k + n < len(d) and m + n < len(docs[j]) and d[k + n] == docs[j][m + n]:
                    n += 1
                if sum(map(len, d[k : k + n])) >= least:
                    gone[i][k : k + n] = [True] * n
            at.setdefault(unit, []).append((i, k))
    return [(sum(g), sum(len(u) for u, x in zip(d, g) if x)) for d, g in zip(docs, gone)]


def test_repeats_against_brute_force(spark):
    passage = ["Twenty words that stand in the first document among other words and are the longest sentence of the passage that follows.", "These are fifteen more words that complete the passage of thirty five words in all."]
    assert [len(x.split()) for x in passage] == [21, 15]
    texts = make_lines(3) + [f"Something else is here. {passage[0]} And another thing.", *(f"Number {k} begins so. {passage[0]} {passage[1]} And ends so {k}." for k in range(2))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.remove_repeats(df, least=30).collect()}
    expected = repeats(texts)
    assert [(got[i]["removed_units"], got[i]["removed_words"]) for i in range(len(texts))] == expected
    assert all(got[i]["text"] == t for i, t in enumerate(texts) if not expected[i][0])
    assert got[len(texts) - 1]["text"] == "Number 1 begins so. And ends so 1."


def test_first_occurrences_survive(spark):
    """A unit's first occurrence is never deleted."""
    texts = make_lines(11)
    units = [linededup.Units([t.encode()]) for t in texts if t]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = linededup.remove_repeats(df).where("text is not null").collect()
    left = set().union(*[set(linededup.Units([r["text"].encode()]).hash.tolist()) for r in kept])
    assert set().union(*[set(u.hash.tolist()) for u in units]) == left


def test_lines_edges(spark):
    p = " ".join(f"w{i}" for i in range(60)) + "."
    rows = [(None, p, 1), (4, p, 2), (4, p, 3), (5, "Own words here.\n" + p + "\nAnd an end.", 4)]
    got = linededup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, removed_units int")).collect()
    by = {(r["doc_id"], r["text"]) for r in got}
    assert by == {(None, ""), (4, p), (5, "Own words here.\nAnd an end.")} and len(got) == 4
    assert linededup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_earlier_run(spark):
    """Against all runs of enough words at all earlier places, units standing in many contexts."""
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n)) + "."
    pool = [words(rng.choice([5, 10, 12, 20, 35])) for _ in range(12)]
    alone, passage = pool[0], [words(12), words(20), words(12), words(10)]
    texts = [" ".join([words(15), passage[1], words(14)]), *(" ".join([words(13), *passage, words(16)]) for _ in range(2))]
    long = words(35)
    texts += [f"{long} {words(14)}", f"{long} {alone} {words(13)}", f"{words(20)} {long} {alone} {words(15)}"]
    texts += [" ".join(rng.choice(pool) if rng.random() < 0.7 else words(rng.randint(2, 14)) for _ in range(rng.randint(1, 12))) for _ in range(60)]
    got = {r["doc_id"]: r for r in linededup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = set()
    for i, t in enumerate(texts):
        u = linededup.Units([t.encode()])
        gone = np.zeros(len(u.hash), bool)
        for a in range(len(gone)):
            runs = {b: tuple(u.hash[a:b].tolist()) for b in range(a + 1, len(gone) + 1) if u.words[a:b].sum() >= 30}
            for b, run in runs.items():
                gone[a:b] |= run in seen
            seen.update(runs.values())
        assert (got[i]["removed_units"], got[i]["removed_words"]) == (gone.sum(), u.words[gone].sum())
    assert got[2]["removed_words"] == 54 and got[5]["removed_units"] == 2


@pytest.mark.parametrize(("n", "dim"), [(80_000, 64), (4_800_000, 64), (1_000_000, 8), (1_000_000, 4), (1_000_000, 2), (1000, 1)])
def test_shared_filters_at_any_size(n, dim):
    """Pairs at the threshold share as many filters as promised, however many vectors there are."""
    rng = np.random.default_rng(12)
    x = rng.standard_normal((1000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1000, dim))
    if dim > 1:
        y -= (y * x).sum(axis=1, keepdims=True) * x
        y /= np.linalg.norm(y, axis=1, keepdims=True)
    rows, filters = capjoin.Codes(n, dim, 0.9).decode(np.vstack([x, 0.9 * x + math_sqrt(0.19) * y if dim > 1 else x]))
    sets = [set() for _ in range(2000)]
    for i, f in zip(rows.tolist(), filters.tolist()):
        sets[i].add(f)
    shared = [len(sets[i] & sets[i + 1000]) for i in range(1000)]
    assert np.mean(shared) >= 17 and sum(map(bool, shared)) >= 998


def test_trees_reach_the_recall_at_the_greatest_depth():
    """Simulated branching of pairs at the threshold down to the last selection."""
    rng, pairs, threshold = np.random.default_rng(13), 40_000, 0.8
    picks = int(minhash.trees(0.9999, threshold, minhash.DEPTH) / threshold)
    agree = rng.binomial(minhash.VALUES, threshold, pairs) / minhash.VALUES
    alive = rng.binomial(picks, agree)
    for _ in range(minhash.DEPTH - 1):
        alive = rng.binomial(alive + rng.binomial(alive, 1 / threshold - 1), agree)
    assert (alive == 0).sum() <= 12
