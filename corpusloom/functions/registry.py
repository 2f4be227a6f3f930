"""Extension points: models as columns, functions by name in SQL, tasks by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import normalizer

#: Tasks of a packing run (fixed values).
TASKS = {"all": ("tts", "stt", "mel"), "token": ("tts", "stt")}


def tasks(name: str) -> tuple[str, ...]:
    """The tasks of a group's name, or the one task itself."""
    return TASKS.get(name, (name,))


def model_column(load: Callable[[], object], predict: Callable[[object, pd.Series], pd.Series], kind: str) -> Callable[[Column], Column]:
    """A function from a column to predictions: ``load()`` runs once in each task, ``predict(model, batch)`` a batch at a time."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield predict(model, batch)

    return run


def word_tokens(c: Column, overhead: int = 0) -> Column:
    """The stand-in for a tokenizer: words and the template's overhead. Any function from a column to a count may take its place."""
    from corpusloom.functions import text

    return text.word_count(c).cast("long") + overhead


def register(spark: SparkSession) -> None:
    """``normalize_text`` and ``dominant_script`` by name in SQL."""

    @F.pandas_udf("string")
    def normalize_text(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalizer.normalize(None if pd.isna(t) else t))

    @F.pandas_udf("string")
    def dominant_script(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "UNKNOWN" if pd.isna(t) else normalizer.dominant_script(t))

    for f in (normalize_text, dominant_script):
        spark.udf.register(f.__name__, f)


#: Parts of the names of parameters that aren't hidden matrices (fixed values).
OUTER_PARTS = ("embed", "wte", "wpe", "lm_head", "head", "output")


def parameter_group(name: Column, dimensions: Column) -> Column:
    """Which optimizer takes a parameter: hidden matrices go to "matrix", embeddings, heads, norms and biases to "rest"."""
    outer = F.lit(False)
    for part in OUTER_PARTS:
        outer = outer | F.contains(F.lower(name), F.lit(part))
    return F.when((dimensions == 2) & ~outer, "matrix").otherwise("rest")
