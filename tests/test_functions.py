import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays, normalizer
from corpusloom.functions import text as texts


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in ((k, "array<double>" if isinstance(v, list) and v and isinstance(v[0], float) else "array<int>" if isinstance(v, list) else "string" if isinstance(v, str | None) else "double" if isinstance(v, float) else "bigint") for k, v in values.items())))
    return row.select(column.alias("x")).first()["x"]


def test_space(spark):
    assert one(spark, texts.strip(F.col("a")), a="　 a b  ") == "a b"
    assert one(spark, texts.words(F.col("a")), a="  a  b　c ") == ["a", "b", "c"]
    assert one(spark, texts.words(F.col("a")), a=None) == []
    assert one(spark, texts.word_count(F.col("a")), a=" \n ") == 0
    assert one(spark, texts.dedup_key(F.col("a")), a=" A\t B ") == "a b"
    assert one(spark, texts.first_text(F.col("a"), F.lit(" x ")), a="  ") == "x"


def test_paths(spark):
    assert one(spark, texts.token_path(F.col("a")), a="f/b/c.x.mp3") == "f_neucodec/b/c.x.json"
    assert one(spark, texts.token_path(F.col("a")), a="c.mp3") is None
    assert one(spark, texts.path_language(F.col("a")), a="t/en/train/1.mp3") == "en"
    assert one(spark, texts.path_split(F.col("a")), a="t/en/1.mp3") is None
    archive, member = texts.archive_member(F.col("a"))
    assert one(spark, archive, a="/data/x_trim/a/b.mp3") == "x_trim_neucodec.zip"
    assert one(spark, member, a="/data/x_trim/a/b.mp3") == "x_trim_neucodec/a/b.json"
    assert one(spark, member, a="x_trim/y_trim/b.c.mp3") == "x_trim_neucodec/y_trim/b.c.json"
    assert [one(spark, c, a=a) for c in (archive, member) for a in ("/data/x/a.mp3", "x_trim/a.wav", None)] == [None] * 6
    assert one(spark, texts.shard_base(F.col("a")), a="voice-0-12") == "voice"
    assert one(spark, texts.replace_everywhere(F.col("a"), ".mp3", ".json"), a="a.mp3.mp3") == "a.json.json"
    assert one(spark, texts.token_path_styled(F.col("a"), F.lit("t"), {"t": "_trim_tok", "u": "_u"}), a="f/b.mp3") == "f_trim_tok/b.json"


def test_short_names(spark):
    assert one(spark, texts.short_name(F.col("a"), "ab.*"), a="ab.*-lr0.001-mlr0.02-wd0.01") == "mlr  0.02"
    assert one(spark, texts.short_name(F.col("a"), "ab"), a="xlr2") == "xlr 2"


def test_labels(spark):
    label, language, script = texts.label_parts(F.col("a"))
    assert [one(spark, c, a="__label__zh_x_Hans") for c in (label, language, script)] == ["zh_x_Hans", "zh_x", "Hans"]
    assert one(spark, texts.macro_language(F.col("a")), a="ind") == "msa"
    assert one(spark, texts.macro_language(F.col("a")), a="eng") == "eng"
    assert one(spark, texts.clean_markers(F.col("a")), a="<um> so\n[noise] well") == "so well"
    assert one(spark, texts.mixed_words(F.col("a")), a="ab 你好cd 한 x") == ["ab", "你", "好", "cd", "한", "x"]
    kinds = {"漢字かな": "japanese", "漢字 한": "korean", "漢字a": "chinese", "漢a": "latin", "abا ب": "latin", "ا بab": "arabic", "жab": "latin", "жaж": "cyrillic", " \n": "other", "": "other"}
    assert {k: one(spark, texts.character_type(F.col("a")), a=k) for k in kinds} == kinds
    assert one(spark, texts.strip_speech_marks(F.col("a")), a="[laugh] Hi, (ok) you！") == "Hi you"


def test_repeats_and_distances(spark):
    assert one(spark, texts.ngrams(F.split("a", " "), 2), a="a b c") == ["a b", "b c"]
    assert one(spark, texts.ngrams(F.split("a", " "), 5), a="a b c") == []
    assert one(spark, texts.most_repeated(F.split("a", " ")), a="a b a c a") == 3
    assert one(spark, texts.error_rate(F.col("a"), F.lit("abcd")), a="abce") == 0.25
    assert one(spark, texts.error_rate(F.col("a"), F.lit("x")), a="") == 1.0
    assert one(spark, texts.error_rate(F.col("a"), F.lit("xyz"), True), a="a") == 1.0


def test_whole_turns_and_loose_marks_against_brute_force(spark):
    """The two queries on texts that have no SQL, on whole texts with characters beyond ASCII."""
    import random
    import re

    rng = random.Random(6)
    turns = ["".join(rng.choices("ab é漢%$5<[(?)]> ", k=rng.choice([0, 3, 60, 400]))) for _ in range(24)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame(list(zip(turns, turns[1:])), "a string, b string")
    loose = texts.drop_empty_brackets(texts.drop_loose_marks(F.col("a")))
    for r in df.select("a", "b", texts.error_rate(F.col("a"), F.col("b"), clip=True).alias("e"), loose.alias("c")).collect():
        assert r["e"] == (min(1.0, distance(r["a"], r["b"]) / len(r["a"])) if r["a"] else float(bool(r["b"])))
        kept = "".join(c for i, c in enumerate(r["a"]) if c not in "%$" or r["a"][i - 1 : i].isdigit() or r["a"][i + 1 : i + 2].isdigit())
        assert r["c"] == re.sub(r"[<\[(][\W_]*?[>\])]", " ", kept)


def test_partial_windows(spark):
    count = lambda n, size, step: one(spark, F.size(arrays.partial_windows(F.col("a"), size, step)), a=n)
    assert [count(n, 160, 16) for n in (1, 144, 160, 176, 177)] == [1, 1, 2, 3, 3]
    assert [count(n, 100, 100) for n in (10, 100, 179, 180, 200)] == [1, 1, 1, 2, 2]
    assert one(spark, arrays.partial_windows(F.col("a"), 100, 50), a=200) == [0, 50, 100]


def test_prompts_and_sounds(spark):
    assert one(spark, texts.prompt_punctuation(F.col("a")), a="hello  there: “you”...") == 'Hello there, "you",'
    assert one(spark, texts.prompt_punctuation(F.col("a")), a="") == texts.EMPTY_PROMPT
    assert one(spark, texts.sound(F.lit("laughter"), F.col("a"), F.lit(2.0)), a="zh") == "哈哈哈"
    assert one(spark, texts.sound(F.lit("laughter"), F.col("a"), F.lit(2.0)), a="en") == "Hahaha"
    assert one(spark, texts.sound(F.lit("sigh"), F.col("a"), F.lit(0.1)), a="en") == "Hah"
    assert one(spark, texts.drop_loose_marks(F.col("a")), a="50% of % and $5 $") == "50% of  and $5 "
    assert one(spark, texts.tidy_space(F.col("a")), a=" a , b  12 - 13 ") == "a, b 12-13"
    assert one(spark, texts.collapse_marks(F.col("a")), a="a!! b.. c...") == "a! b. c..."
    assert one(spark, normalizer.hangul_letters(F.col("a")), a="한a") == "한a"


def test_positions(spark):
    assert one(spark, arrays.trimmed(F.col("a")), a=320 * 3 + 7) == 960
    assert one(spark, arrays.positions(F.col("a")), a=int(3.7 * 16000)) == int(3.7 * 50)
    assert one(spark, arrays.position_ids(F.col("a")), a=[2, 3]) == [0, 1, 0, 1, 2]
    assert one(spark, arrays.offsets(F.col("a")), a=[2, 3]) == [0, 2, 5]
    assert one(spark, arrays.mask_labels(F.col("a"), F.array(F.lit(2))), a=[1, 2]) == [1, -100]
    assert one(spark, arrays.shifted(F.col("a")), a=[1, 2, 3]) == [2, 3]
    assert one(spark, arrays.crop(F.col("a"), 9, 8), a=[1, 9, 2, 3, 8, 4]) == [2, 3]


def test_codes(spark):
    df = spark.createDataFrame([([1, 2], [3, 4, 5, 6], [7, 8, 9, 10, 11, 12, 13, 14])], "a array<int>, b array<int>, c array<int>")
    df = df.select("*", arrays.interleaved(F.col("a"), F.col("b"), F.col("c")).alias("i"))
    row = df.select("*", *[x.alias(f"l{k}") for k, x in enumerate(arrays.layers(F.col("i")))]).first()
    assert row["i"][:3] == [128267, 128266 + 4096 + 3, 128266 + 2 * 4096 + 7]
    assert (row["l0"], row["l1"], row["l2"]) == (row["a"], row["b"], row["c"])


def test_vectors(spark):
    assert one(spark, arrays.cosine(F.col("a"), F.array(F.lit(0.0), F.lit(2.0))), a=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, arrays.unit(F.col("a")), a=[3.0, 4.0]) == pytest.approx([0.6, 0.8])
    assert sum(one(spark, arrays.softmax(F.col("a")), a=[1.0, 2.0, 3.0])) == pytest.approx(1)


def test_numbers(spark):
    assert one(spark, arrays.calibrated(F.col("a"), "OVRL"), a=3.0) == pytest.approx(np.polyval(arrays.CALIBRATION["OVRL"], 3.0))
    edges = F.array(*[F.lit(float(i)) for i in range(4)])
    got = [one(spark, arrays.bin_index(F.col("a"), edges, 3), a=x) for x in (-1.0, 0.0, 1.0, 1.5, 3.0, 9.0, math.nan)]
    assert got == [0, 0, 0, 1, 2, 2, 0]
    assert [one(spark, arrays.hops(F.col("a")), a=int(s * 16000)) for s in (5, 9.01, 10, 11)] == [1, 1, 1, 2]
    assert one(spark, arrays.windows(F.col("a"), 3, 1), a=[1, 2, 3, 4]) == [[1, 2, 3], [2, 3, 4]]
    assert one(spark, arrays.windows(F.col("a"), 3, 1), a=[1]) == [[1]]
    assert one(spark, arrays.tiled(F.col("a"), F.lit(5)), a=[1, 2]) == [1, 2, 1, 2, 1]
    assert one(spark, arrays.fluency_label(F.array(F.array(F.lit(0), F.lit(3)), F.array(F.lit(3), F.lit(126))), F.array(F.col("a"), F.lit("block"))), a="fluent") == "00:03:fluent, 03:126:block"
    assert one(spark, arrays.fluency(F.col("a"), F.array(F.lit(0.8), F.lit(0.1)), ("x", "y")), a=0.4) == ["x"]


def test_signals_and_language_prompts(spark):
    df = spark.createDataFrame([([[1.0, 3.0], [3.0, 5.0]], "a B", "KO"), ([[0.5]], "b", ""), ([], "c", None), (None, None, "ja")], "c array<array<float>>, t string, g string")
    got = df.select(arrays.mono(F.col("c")).alias("m"), texts.language_prompt(F.col("t"), F.col("g")).alias("p")).collect()
    assert [r["m"] for r in got] == [[2.0, 4.0], [0.5], None, None]
    assert [r["p"] for r in got] == ["[ko]a[SPACE]B", "b", "c", None]
    one = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([1.0], 3), ([], 0)], "m array<float>, n int")
    assert [r[0] for r in one.select(arrays.fitted(F.col("m"), F.col("n"))).collect()] == [[1.0, 2.0], [1.0, 0.0, 0.0], []]
    said = spark.createDataFrame([("각", "ko"), ("각", "en"), ("x", "zh"), (None, "ko")], "t string, g string")
    assert [r[0] for r in said.select(normalizer.converted(F.col("t"), F.col("g"), {"zh": str.upper})).collect()] == ["\u1100\u1161\u11a8", "각", "X", None]
