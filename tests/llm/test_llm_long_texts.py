"""Texts of over a megabyte, far beyond a chunk of the kernel, and columns that bear the operators' own names."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import capjoin, decontaminate, linededup, lmscore, minhash, mixing, tokens, toxicity


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklm", k=6)) for _ in range(150_000)]
    body = " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))
    edited = body.replace(words[75_000], "changed")
    rows = [(1, body), (2, edited), (3, body), (4, "short text of its own, nothing more"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("n", "rep", "node", "h1", "id", "k1", "hashes", "weight", "Score", "copies", "n_tokens")}).withColumn("source", F.lit("s")), words


def test_minhash(spark, long_docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(long_docs[0]).collect()}
    assert got[1] == (len({tuple(long_docs[1][i : i + 5]) for i in range(150_000 - 4)}), 1) and got[2][1] == got[3][1] == 1
    assert got[4] == (3, 4) and got[5] == (0, 5)


def test_lines(long_docs):
    got = {r["doc_id"]: r for r in linededup.remove_repeats(long_docs[0]).collect()}
    assert got[1]["removed_words"] == 0 and got[3]["text"] == ""
    assert len(got[2]["text"].split()) == 11 and "changed" in got[2]["text"]


def test_decontamination(spark, long_docs):
    items = spark.createDataFrame([(1, " ".join(long_docs[1][140_000:140_040]))], "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["contaminated"]) for r in decontaminate.find_contamination(long_docs[0], items).collect()}
    assert got[1] == got[2] == (150_000, 40, False) and got[5] == (0, 0, False)


def test_scores(spark, long_docs):
    docs = long_docs[0]
    labels = spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 5
    got = {r["doc_id"]: r["n_words"] for r in lmscore.cross_entropy_difference(docs, labels.select("doc_id")).collect()}
    assert got == {1: 150_000, 2: 150_000, 3: 150_000, 4: 7, 5: 0}
    assert {r["doc_id"]: r["size"] for r in mixing.plan_copies(docs).collect()}[1] == 150_000


def test_tokens(long_docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = long_docs[0].where("doc_id in (1, 5)")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, path).collect()}
    whole = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, path, huge=10**9).collect()}
    assert got == whole and got[1] > 150_000


def test_vectors_beside_other_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.99, 0.1, 0.0]), (3, [0.0, 1.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in capjoin.near_duplicates(df.withColumns({c: F.lit(1) for c in ("id", "v", "rep", "node", "n_links")})).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3)}
