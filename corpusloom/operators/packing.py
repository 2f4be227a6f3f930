"""Documents as prompts, and their packing into blocks of a fixed number of tokens."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import arrays

#: Tokens of a block.
BLOCK = 10_240

# --- documents -------------------------------------------------------------------------------------------------------------------------


def speech(tokens: Column) -> Column:
    """Speech tokens as special strings."""
    return F.array_join(F.transform(tokens, lambda t: F.concat(F.lit("<|s_"), t.cast("string"), F.lit("|>"))), "")


def speak_prompt(voice: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), voice, F.lit(": "), text, F.lit("<|speech_start|>"))


def speak_document(voice: Column, text: Column, tokens: Column) -> Column:
    return F.concat(speak_prompt(voice, text), speech(tokens), F.lit("<|im_end|>"))


def listen_document(tokens: Column, language: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|><|STT|>"), speech(tokens), F.lit("<|"), language, F.lit("|>"), text, F.lit("<|im_end|>"))


def placeholder_ids(prefix: Column, placeholder: int, samples: Column, tail: Column) -> Column:
    """A document whose audio stands as one placeholder a position."""
    return F.concat(prefix, F.array_repeat(F.lit(placeholder), arrays.positions(samples).cast("int")), tail)


def pair_document(voice_text: Column, voice_tokens: Column, text: Column, tokens: Column) -> Column:
    """Reference and target, back to back."""
    part = lambda t, s: F.concat(F.lit("<|im_start|>"), t, F.lit("<|speech_start|>"), speech(s), F.lit("<|im_end|>"))
    return F.concat(part(voice_text, voice_tokens), part(text, tokens))


def conversion_prompt(voice_text: Column, voice_tokens: Column, text: Column, tokens: Column, seed: int = 2) -> Column:
    """The pair without its end, begun with the target's first ``seed`` tokens."""
    head = F.concat(F.lit("<|im_start|>"), voice_text, F.lit("<|speech_start|>"), speech(voice_tokens), F.lit("<|im_end|>"))
    return F.concat(head, F.lit("<|im_start|>"), text, F.lit("<|speech_start|>"), speech(F.slice(tokens, 1, seed)))


def expressive_documents(df: DataFrame, speaker: str, text: str, description: str, category: str, tokens: str) -> DataFrame:
    """Four prompts of each row: the speaker's text in the manner of either description, and the speech described as either."""
    said, voiced = F.concat(F.col(speaker), F.lit(": "), F.col(text)), speech(F.col(tokens))
    turn = lambda *parts: F.concat(F.lit("<|im_start|>"), *parts, F.lit("<|im_end|>"))
    say = lambda d: turn(said, F.lit("<|description|>"), F.col(d), F.lit("<|speech_start|>"), voiced)
    prompts = [say(description), say(category), turn(voiced, F.lit("<|description|>"), F.col(description)), turn(voiced, F.lit("<|description_category|>"), F.col(category))]
    return df.select("*", F.posexplode(F.array(*prompts)).alias("task", "document"))


def generated_tokens(output: Column) -> Column:
    """The speech tokens after the last start mark."""
    return F.transform(F.regexp_extract_all(F.substring_index(output, "<|speech_start|>", -1), F.lit(r"<\|s_(\d+)\|>"), F.lit(1)), lambda x: x.cast("int"))


def attribute_prompt(fields: dict[str, Column], fluency: Column, text: Column, tasks: tuple[str, ...]) -> Column:
    """A prompt that lists attributes and the transcript, then numbered tasks."""
    lines = [F.lit("based on audio attributes,"), F.concat(F.lit("fluency timestamp: "), fluency)]
    lines += [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("unknown"))) for k, v in fields.items()]
    lines += [F.concat(F.lit("transcript: "), text), F.lit(""), *[F.lit(f"{i}. {t}" if i else t) for i, t in enumerate(tasks)]]
    return F.concat_ws("\n", *lines)


def chat(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, n_turns, document): a conversation's turns in order. One row gathers one conversation's turns."""
    said = F.struct(F.col(order), F.concat(F.lit("<|im_start|>"), F.col(role), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("<|im_end|>\n")).alias("s"))
    return turns.groupBy(key).agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["s"]), "").alias("document"))


# --- packing -----------------------------------------------------------------------------------------------------------------------------


def greedy_blocks(docs: DataFrame, keys: list[str], order: str, length: str, block: int = BLOCK) -> DataFrame:
    """Adds ``block`` (from 0) and ``offset`` (tokens before it in its block) to each document, packing each key's in order.

    A document that doesn't fit closes the block; a longer one than a block stands alone. The fold runs down sorted partitions with one
    counter in memory, so a key may be of any size; a key that holds much of the rows should be given with a shard of it, as packing by shard only
    leaves one more open block a shard.
    """
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*[f for f in docs.schema.fields if f.name not in ("block", "offset")], StructField("block", LongType()), StructField("offset", LongType())])

    def fold(frames):
        last, number, filled = None, 0, 0
        for frame in frames:
            blocks, places = [], []
            for *key, n in frame[[*keys, length]].itertuples(index=False, name=None):
                n = 0 if pd.isna(n) else int(n)
                if key != last:
                    last, number, filled = key, 0, 0
                elif filled + n > block and filled:
                    number, filled = number + 1, 0
                blocks.append(number)
                places.append(filled)
                filled += n
            yield frame.assign(block=blocks, offset=places)[schema.names]

    return docs.repartition(*keys).sortWithinPartitions(*keys, order).mapInPandas(fold, schema)


def greedy_blocks_small(docs: DataFrame, keys: list[str], order: str, length: str, block: int = BLOCK) -> DataFrame:
    """(keys, order, length, block) by a fold in the JVM; for keys whose documents fit in a row."""
    start = F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("filled"), F.array().cast("array<bigint>").alias("out"))

    def step(s, d):
        full = (s["filled"] + d["n"] > block) & (s["filled"] > 0)
        number = F.when(full, s["block"] + 1).otherwise(s["block"])
        return F.struct(number.alias("block"), F.when(full, d["n"]).otherwise(s["filled"] + d["n"]).alias("filled"), F.concat(s["out"], F.array(number)).alias("out"))

    listed = docs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(length).cast("long").alias("n")))).alias("d"))
    folded = listed.withColumn("b", F.aggregate("d", start, step, lambda s: s["out"]))
    return folded.select(*keys, F.explode(F.arrays_zip("d", "b")).alias("x")).select(*keys, F.col("x.d.o").alias(order), F.col("x.d.n").alias(length), F.col("x.b").alias("block"))


def block_layout(packed: DataFrame, keys: list[str], order: str, length: str, ids: str | None = None, block: int = BLOCK) -> DataFrame:
    """A row a block: ``lengths`` of its documents (the attention layout), ``n_tokens``, ``position_ids``, ``cu_seq_lens``, ``max_length``,
    ``oversized``, and ``input_ids`` if ``ids`` are given. A block's documents are bounded by its tokens."""
    fields = [F.col(order).alias("o"), F.col(length).cast("long").alias("n"), *([F.col(ids).alias("ids")] if ids else [])]
    rows = packed.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct(*fields)), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("d"))
    rows = rows.withColumn("lengths", F.transform("d", lambda d: d["n"]))
    out = rows.withColumn("n_tokens", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n))
    out = out.withColumn("position_ids", arrays.position_ids(F.col("lengths"))).withColumn("cu_seq_lens", arrays.offsets(F.col("lengths")))
    out = out.withColumn("max_length", F.array_max("lengths")).withColumn("oversized", F.array_max("lengths") > block)
    if ids:
        out = out.withColumn("input_ids", F.flatten(F.transform("d", lambda d: d["ids"])))
    return out.drop("d")


def fitting(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Without the blocks of oversized documents."""
    return blocks.where(F.coalesce(F.array_max("lengths"), F.lit(0)) <= block)


def for_training(blocks: DataFrame) -> DataFrame:
    """Without texts and audio, ids as BIGINT."""
    kept = blocks.drop(*[c for c in ("audio", "text", "token_type_ids") if c in blocks.columns])
    return kept.withColumns({c: F.col(c).cast("array<bigint>") for c in ("input_ids", "position_ids", "attention_mask") if c in kept.columns})


def frame_layout(utterances: DataFrame, keys: list[str], order: str, samples: str) -> DataFrame:
    """(keys, order, frame_index, segment_id): a row a position of each utterance in its buffer; positions restart with each."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys).orderBy(order)
    n = arrays.positions(F.col(samples))
    numbered = utterances.withColumn("segment_id", F.row_number().over(w) - 1).where(n > 0)
    return numbered.select(*keys, order, "segment_id", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("frame_index"))


def balanced_slices(items: Column, size: int) -> Column:
    """An array in slices of ``size``; the last has the rest."""
    n = F.ceil(F.size(items) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(F.array())
