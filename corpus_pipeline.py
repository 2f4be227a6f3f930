"""The corpus pipeline: five of the operators in a row over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept and returns the columns of ``documents``; the last adds those of the mix.
Part of the subpackage ``corpusloom.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import base, decontaminate, linededup, minhash, mixing, toxicity


def _like(docs: DataFrame, made: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` being counted anew where there is one."""
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*[F.col(f"`{c}`") for c in docs.columns])


def _aside(docs: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of their own that bear the names of what an operator adds under other names, and the way back."""
    renamed = {f"_own{k}": c for k, c in enumerate(docs.columns) if c.lower() in added}
    return docs.withColumnsRenamed({c: k for k, c in renamed.items()}), renamed


def _back(made: DataFrame, renamed: dict[str, str]) -> DataFrame:
    return made.drop(*renamed.values()).withColumnsRenamed(renamed)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the model, trained on the labels, scores 0.3 or more; null and empty texts stay."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = toxicity.train(docs, base.table(spark, sf_dir, "labels").where(~held_out))
    apart, own = _aside(docs, "score", "predicted")
    return _back(toxicity.score(apart, model).where("predicted = 0"), own).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of passages are cut out; a document goes if nothing but repeats was in it."""
    apart, own = _aside(docs, "removed_units", "removed_words")
    cut = linededup.remove_repeats(apart)
    return _like(docs, _back(cut.where("removed_units = 0 or text <> ''"), own))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document of the smallest id stays; rows that repeat it stay with it."""
    gone = base.save(minhash.near_duplicates(docs, shingle=5, percent=80).where("not kept").select("doc_id"), "near-duplicates")
    return docs.join(base.small(gone.distinct()), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others, words that lie in benchmark windows are cut out."""
    apart, own = _aside(docs, "n_words", "hit_ranges", "item_ids", "n_hit", "n_items", "contaminated")
    found = decontaminate.find_contamination(apart, base.table(spark, sf_dir, "benchmark"), cut=True)
    return _like(docs, _back(found.where("not contaminated"), own))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate has it."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near-dedup", dedup_near),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
]

#: Learned scores and randomised joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = base.save(docs, name.replace(" ", "-"))
    return docs
