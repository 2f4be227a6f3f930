import random

import numpy as np
import pytest

from corpusloom.llm import decontaminate, mixing


def waterfill(sizes, weights, most):
    """Targets by repeated sharing."""
    total, open_, out = float(sum(sizes.values())), dict(weights), {}
    while open_:
        share = total / sum(open_.values())
        over = [s for s in open_ if share * open_[s] > most * sizes[s]]
        if not over:
            out |= {s: share * w for s, w in open_.items()}
            break
        for s in over:
            out[s] = most * sizes[s]
            total -= out[s]
            del open_[s]
    return out


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


@pytest.mark.parametrize("counts", [[100, 1, 1], [1, 1, 100], [5, 5, 5, 5, 5, 5, 5], [3, 200, 1, 50], [7]])
def test_targets(spark, counts):
    names = [f"s{i}" for i in range(len(counts))]
    rows = [(i * 1000 + j, n, "a b c") for i, (n, k) in enumerate(zip(names, counts)) for j in range(k)]
    got = {r["source"]: r["target"] for r in mixing.plan_copies(docs_of(spark, rows)).select("source", "target").distinct().collect()}
    sizes = {n: 3 * k for n, k in zip(names, counts)}
    expected = waterfill(sizes, {n: (5.0, 2.0, 1.0)[i % 3] for i, n in enumerate(names)}, 3.0)
    assert got == pytest.approx(expected)


def test_copies(spark):
    rng = random.Random(0)
    rows = [(i, f"s{i % 3}", "w " * rng.randint(1, 9)) for i in range(3000)] + [(9999, None, None), (None, "s0", "x"), (5, "s5", "")]
    planned = mixing.plan_copies(docs_of(spark, rows)).collect()
    again = {r["doc_id"]: r["copies"] for r in mixing.plan_copies(docs_of(spark, rows).repartition(7)).collect()}
    taken = {}
    for r in planned:
        assert r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) and r["copies"] <= 3
        assert again[r["doc_id"]] == r["copies"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["size"] * r["copies"]
    for r in planned:
        if r["source"] in ("s0", "s1", "s2"):
            assert abs(taken[r["source"]] - r["target"]) <= 2 * 9
    mixed = mixing.mix(docs_of(spark, rows))
    assert mixed.count() == sum(r["copies"] for r in planned)
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_sources_of_the_tables_come_near_their_targets(spark):
    from corpusloom.llm import queries

    rows = queries.op2_mixing(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= max(0.05 * r["max(target)"], r["max(size)"])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "x y", "mine", 7)], "doc_id long, source string, text string, target string, Size int")
    r = mixing.plan_copies(df).first()
    assert r["size"] == 2 and r["target"] == 2.0 and r["copies"] == 1


# --- decontamination ------------------------------------------------------------------------------------------------------------------


def brute(text, items, n):
    import re

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        for i in range(max(1, len(b) - n + 1) if b else 0):
            win = b[i : i + n]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "é", "d1", "E"]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 5, 9])))) for i in range(12)] + [("null", "b-c b"), ("9", "a,A  a")]
    texts = [", ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "...", "b C;b\nd1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tests = spark.createDataFrame([(None if i == "null" else int(i), t) for i, t in items] + [(77, None)], "item_id long, text string")
    got = decontaminate.find_contamination(docs, tests, n=4, block_bytes=block_bytes).collect()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == brute(texts[r["doc_id"]], items, 4), texts[r["doc_id"]]
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])


def test_spans_are_cut(spark):
    docs = spark.createDataFrame([(1, "Keep this. One TWO, three four! And that."), (2, None), (3, "clean  text ")], "doc_id long, text string")
    tests = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    for cut in (decontaminate.remove_spans(decontaminate.find_contamination(docs, tests, n=3)), decontaminate.find_contamination(docs, tests, n=3, cut=True)):
        assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "Keep this. ! And that.", 2: None, 3: "clean  text "}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 3)], "doc_id long, text string, n_hit int")
    none = spark.createDataFrame([], "item_id long, text string")
    r = decontaminate.find_contamination(docs, none).first()
    assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (2, 0, 0, False)
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    from corpusloom.llm import kernel

    monkeypatch.setattr(kernel, "mix", lambda h: h & np.uint64(3))  # four hashes for all windows
    items = [("b", b"one two three four"), ("a", b"two three four five six"), ("c", b"three four"), ("b", b"nine one two three")]
    w = kernel.Words([b"zero one two three four five", b"three four", b"six five", b""], kernel.ALNUM)
    got = decontaminate.WindowSet(items, 3).scan(w)
    assert got == [([[1, 5]], ["a", "b", "c"]), ([[0, 1]], ["c"]), ([], []), ([], [])]


def test_index_of_a_large_benchmark_is_bounded():
    import resource
    import time

    rng = np.random.default_rng(3)
    words = np.array(["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)])
    items = [(str(k), " ".join(rng.choice(words, 400)).encode()) for k in range(1600)]
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    index = decontaminate.WindowSet(items, 13)
    assert sum(len(x[1]) for x in index.layers) > 600_000
    assert time.perf_counter() - began < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
