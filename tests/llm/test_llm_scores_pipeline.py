import math
import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import linededup, lmscore, minhash, queries, toxicity

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# --- language models ------------------------------------------------------------------------------------------------------------------


def brute_scores(texts, target, prior):
    import re

    docs = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    out = []
    models = []
    for chosen in (range(len(docs)), target):
        uni, bi, hist = Counter(), Counter(), Counter()
        for i in chosen:
            for a, b in zip([None, *docs[i]], docs[i]):
                uni[b] += 1
                bi[a, b] += 1
                hist[a] += 1
        models.append((uni, bi, hist))
    vocabulary = set(models[0][0])
    for d in docs:
        loss = [0.0, 0.0]
        for k, (uni, bi, hist) in enumerate(models):
            n = sum(uni.values())
            for a, b in zip([None, *d], d):
                p = (uni[b] + 1) / (n + len(vocabulary) + 1)
                loss[k] -= math.log((bi[a, b] + prior * p) / (hist[a] + prior))
        out.append((len(d), *(x / len(d) if d else None for x in (loss[1], loss[0]))))
    return out


def test_scores_against_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c", "d", "e1"], k=rng.randint(0, 30))) for _ in range(60)] + [None, "", "..."]
    target = [i for i in range(60) if i % 4 == 0]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    keys = spark.createDataFrame([(i,) for i in target] + [(target[0],), (None,), (777,)], "doc_id long")
    got = {r["doc_id"]: r for r in lmscore.cross_entropy_difference(df, keys).collect()}
    for i, (n, t, b) in enumerate(brute_scores(texts, target, lmscore.PRIOR)):
        assert got[i]["n_words"] == n
        if n:
            assert (got[i]["target_loss"], got[i]["background_loss"]) == pytest.approx((t, b))
            assert got[i]["score"] == pytest.approx(t - b)
        else:
            assert got[i]["score"] is None


@pytest.mark.parametrize("batch_bytes", [1, 300, 1 << 24])
def test_scores_do_not_depend_on_batches(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(lmscore, "PART", (100, 64 << 20))
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "b", "Ab", "\u00e9t\u00e9", "d9"], k=rng.randint(0, 30))) for _ in range(90)] + [None, ""]
    target = [i for i in range(90) if i % 3 == 0]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "id string, body string").repartition(3)
    got = {r["id"]: r for r in lmscore.cross_entropy_difference(df, df.where(F.substring("id", 2, 9).cast("int") % 3 == 0), key="id", text="body", batch_bytes=batch_bytes).collect()}
    assert len(got) == len(texts)
    for i, (n, t, b) in enumerate(brute_scores(texts, target, lmscore.PRIOR)):
        row = got[f"k{i}"]
        assert row["n_words"] == n and (not n or (row["target_loss"], row["background_loss"]) == pytest.approx((t, b)))


def test_scores_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (None, "a c")], "doc_id long, text string")
    assert lmscore.cross_entropy_difference(df.limit(0), df).count() == 0
    rows = lmscore.cross_entropy_difference(df, df.limit(0)).collect()
    assert len(rows) == 2 and all(r["target_loss"] == pytest.approx(math.log(4)) for r in rows)


# --- toxicity -------------------------------------------------------------------------------------------------------------------------


def toxic_texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 6)))
    texts, labels = [], []
    for i in range(n):
        sentences = [" ".join(word() for _ in range(8)) for _ in range(rng.randint(1, 12))]
        y = i % 5 == 0
        if y:
            k = rng.randrange(len(sentences))
            sentences[k] += rng.choice([" zonk", f" grum{word()}"])
        texts.append(". ".join(sentences) + ".")
        labels.append(int(y))
    return texts, labels


def test_toxicity(spark):
    texts, y = toxic_texts(1, 800)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "zonk"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y) if i % 4] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(800) if i % 4 == 0]
    hits = [(got[i]["predicted"], y[i]) for i in held]
    assert sum(p == v for p, v in hits) >= 0.98 * len(hits)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[900]["score"] == got[901]["score"] < 0.3
    found = toxicity.locate(spark.createDataFrame([(1, "Fine words. You zonk you. All good."), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [s["sentence"] for s in found[0]["offending"]] == ["You zonk you"] and found[1]["offending"] == []


def plain_fit(texts, labels, weights):
    """Training word by word: (weight of each feature, bias), features being words and their beginnings."""
    import re

    def features(word):
        return [word, *(f"{word[:n]}*" for n in toxicity.PREFIXES if len(word) > n)]

    docs = [[[f for w in re.findall("[0-9a-z]+", s) for f in features(w)] for s in re.split(r"[.!?]\s|\n", t.lower())] for t in texts]
    ones, zeros = sum(labels), len(labels) - sum(labels)
    holds = {}
    for d, y in zip(docs, labels):
        for f in {f for s in d for f in s}:
            holds.setdefault(f, []).append(y)
    theta = {}
    for f, ys in holds.items():
        p = len(ys) / len(docs)
        spread = math.sqrt(p * (1 - p) * (1 / ones + 1 / zeros))
        if len(ys) >= toxicity.LEAST_ROWS and spread and (sum(ys) / ones - (len(ys) - sum(ys)) / zeros) / spread >= toxicity.LEAST_Z:
            theta[f] = 0.0
    docs = [[[f for f in s if f in theta] for s in d] for d in docs]
    bias, g2, b2, total = -2.0, dict.fromkeys(theta, 1e-8), 1e-8, sum(weights)
    for _ in range(toxicity.EPOCHS):
        grad, gb = dict.fromkeys(theta, 0.0), 0.0
        for d, y, w in zip(docs, labels, weights):
            p = [1 / (1 + math.exp(-(bias + sum(theta[f] for f in s)))) for s in d if s]
            toxic = max(1 - (1 - toxicity.LEAK) * math.prod(1 - x for x in p), 1e-9)
            pull = w / total * (-(1 - toxic) / toxic if y else 1.0)
            for x, s in zip(p, [s for s in d if s]):
                gb += x * pull
                for f in s:
                    grad[f] += x * pull
        for f in theta:
            g2[f] += grad[f] ** 2
            step = toxicity.RATE / math.sqrt(g2[f])
            moved = theta[f] - step * grad[f]
            theta[f] = math.copysign(max(abs(moved) - step * toxicity.L1 * 0.1, 0), moved)
        b2 += gb**2
        bias -= toxicity.RATE / math.sqrt(b2) * gb
    return theta, bias


def test_training_against_brute_force():
    texts, y = toxic_texts(6, 120)
    weights = np.array([1.0 if v else 2.5 for v in y])
    model = toxicity.fit([t.encode() for t in texts], np.array(y), weights)
    theta, bias = plain_fit(texts, y, weights.tolist())
    assert model.bias == pytest.approx(bias) and len(theta) > 1
    assert sorted(model.weights[model.weights != 0].tolist()) == pytest.approx(sorted(v for v in theta.values() if v), rel=1e-4)


def test_noisy_or_is_exact():
    texts, y = toxic_texts(2, 300)
    model = toxicity.fit([t.encode() for t in texts], np.array(y), np.ones(300))
    body = texts[0].encode()
    sentences = model.offending(body, 0.0)
    assert model.scores([body])[0] == pytest.approx(1 - (1 - toxicity.LEAK) * math.prod(1 - s for _, _, s in sentences))
    assert len(sentences) == texts[0].count(".")


def test_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}


# --- queries --------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    told = con.sql(queries.ORACLE_SQL[name])
    key = lambda columns, rows: sorted(tuple(repr(r[columns.index(c)]) for c in sorted(columns)) for r in rows)
    assert sorted(df.columns) == sorted(told.columns)
    assert key(df.columns, [tuple(r) for r in df.collect()]) == key(told.columns, told.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_queries_keep_every_row(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    source = "pages" if "page_id" in df.columns else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    have = spark.read.parquet(f"{DATA}/{source}.parquet").select(key)
    assert df.select(key).exceptAll(have).count() == 0 == have.exceptAll(df.select(key)).count()


# --- the pipeline ---------------------------------------------------------------------------------------------------------------------


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijkl", k=5)) + ("." if i % 9 == 8 else "") for i in range(n)) + "."


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("planted"))
    rng = random.Random(0)
    docs, labels = [], []
    for i in range(300):
        toxic = i % 6 == 0 and i < 240
        body = passage(i, 80) + (" You zonkface." if toxic else "")
        docs.append((i, body, "en", f"s{i % 3}", len(body)))
        if i < 240:
            labels.append((i, 1, int(toxic)))
    shared, bench = passage(7001, 70), passage(7002, 30)
    near = passage(7003, 400).split()
    for i in range(300, 306):  # a passage that documents share
        docs.append((i, f"{passage(i, 40)}\n{shared}\n{passage(i + 50, 40)}", "en", "s0", 0))
    for i in range(306, 309):  # near copies: an edit every eight words leaves no run of lines to delete, the copies lie apart
        w = list(near)
        w[(i - 306) * 50 + 20] = "edited"
        docs.append((i, " ".join(w), "en", "s1", 0))
    docs.append((309, passage(309, 20) + " " + bench + " " + passage(310, 20), "en", "s2", 0))
    docs.append((310, passage(311, 900) + "\n" + bench, "en", "s2", 0))
    docs += [(320, None, "en", "s1", None), (321, "", None, None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert rng
    return root, {"toxic": [d[0] for d in docs if d[1] and "zonkface" in d[1]], "shared": shared, "bench": bench}


def test_pipeline_stages(spark, planted):
    import corpus_pipeline
    from corpusloom.llm import base

    root, told = planted
    docs = spark.read.parquet(f"{root}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(base.save(stage(spark, kept[-1], root), name.replace(" ", "-")))
    for df in kept[1:-1]:
        assert df.columns == columns
    ids = [{r["doc_id"] for r in df.select("doc_id").collect()} for df in kept]
    # toxicity: what carries the word goes, what doesn't stays
    assert ids[0] - ids[1] == set(told["toxic"])
    # line dedup: the shared passage stays once, n_chars follows
    texts = {r["doc_id"]: r for r in kept[2].collect()}
    assert [i for i in range(300, 306) if told["shared"] in texts[i]["text"]] == [300]
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else None) for r in texts.values())
    assert 320 in texts and 321 in texts
    # near-dedup: the stage equals the operator on its own input
    gone = {r["doc_id"] for r in minhash.near_duplicates(kept[2], shingle=5).where("not kept").collect()}
    assert ids[2] - ids[3] == gone
    # decontamination: the contaminated document goes, the long one loses the passage
    assert 309 not in ids[4] and 310 in ids[4]
    assert told["bench"] not in {r["doc_id"]: r["text"] for r in kept[4].collect()}[310]
    # mixing: whole documents, as often as planned
    assert set(columns) <= set(kept[5].columns) and ids[5] <= ids[4]
    assert kept[5].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_columns_of_their_own_survive(spark, planted):
    import corpus_pipeline

    root, _ = planted
    docs = spark.read.parquet(f"{root}/documents.parquet").where("doc_id > 298").withColumns({c: F.lit(f"own {c}") for c in ("score", "Removed_Words", "n_hit", "component_id", "rep", "hashes")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns
        assert {(r["score"], r["Removed_Words"], r["n_hit"], r["rep"]) for r in out.collect()} == {("own score", "own Removed_Words", "own n_hit", "own rep")}


def test_near_copies_alone(spark, planted):
    import corpus_pipeline

    root, _ = planted
    docs = spark.read.parquet(f"{root}/documents.parquet").where("doc_id between 300 and 310")
    left = {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, root).collect()}
    assert left & {306, 307, 308} == {306}
    assert linededup.remove_repeats(docs).where("doc_id = 300 and removed_units > 0").count() == 0


def test_pipeline_runs_on_empty_tables(spark, planted, tmp_path):
    import corpus_pipeline

    root, _ = planted
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{root}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_without_the_subpackage(tmp_path):
    """Without the llm folders and the pipeline the entry module still has the other queries."""
    import shutil

    for name in ("corpusloom", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "corpusloom" / "llm")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True)
    n, sql, llm = out.stdout.split()
    assert int(n) > 50 and int(sql) > 50 and llm == "False"
