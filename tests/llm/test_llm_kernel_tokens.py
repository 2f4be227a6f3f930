import random
import re

import numpy as np
import pytest

from corpusloom.llm import kernel, tokens

ODD = ["", " ", "a", "Ab ab", "xéÉ 你好　b", "one two three four five", "\x00 \x0b\t z", "ZZZ " * 50, "퟿\U0001f600 ok"]


def test_words_equal_their_pattern():
    for kinds, pattern in ((kernel.SPACED, r"[^\x20\x09-\x0D]+"), (kernel.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = kernel.Words([t.encode() for t in ODD], kinds)
        raw = (w.codes - 1).astype(np.uint8)
        got = [[raw[w.start[i] : w.end[i]].tobytes().decode() for i in range(w.first[d], w.first[d + 1])] for d in range(len(ODD))]
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        assert got == [re.findall(pattern, t.translate(lower)) for t in ODD]


def test_hashes_depend_on_words_alone():
    a = kernel.Words([b"xx one  two three", b"four"], kernel.SPACED)
    b = kernel.Words([b"zzzzzz", b"ONE two\nthree four"], kernel.SPACED)
    at_a, h_a = a.runs(3, a.hashes())
    at_b, h_b = b.runs(3, b.hashes())
    assert at_a.tolist() == [0, 1] and at_b.tolist() == [1, 2]
    assert h_a[1] == h_b[0] == kernel.hash_words([b"one", b"two", b"three"]) and h_a[0] not in h_b


def test_chunks_keep_texts_whole():
    texts = [b"x" * n for n in (5, 5, 100, 1, 0)]
    assert [t for _, c in kernel.chunks(texts, 10) for t in c] == texts
    assert [i for i, _ in kernel.chunks(texts, 10)] == [0, 2, 3]


@pytest.fixture(scope="module")
def bpe():
    public = pytest.importorskip("public_tokenizers")
    return tokens.load(public.path("byte_bpe_50k.json"))


def whole(tok, text):
    return len(tok.encode(text, add_special_tokens=False).ids)


HARD = ["a" * 4000, " \n  " * 900, "<|endoftext|>" * 300, "ab<|endoftext|>  <|endoftext|>\n\n" * 90, "'ll 's I'm" * 300, "\U0001f600é " * 900, "x" * 333 + " y" * 700, "1234567890" * 200]


@pytest.mark.parametrize("text", HARD)
@pytest.mark.parametrize("chunk, overlap", [(300, 16), (97, 5), (50, 1)])
def test_splicing_is_exact(bpe, text, chunk, overlap):
    assert tokens.count_spliced(bpe, text, chunk, overlap) == whole(bpe, text)


def test_splicing_random_texts(bpe):
    rng = random.Random(1)
    parts = ["word", " ", "  ", "\n", "'s", "Zé", "12", "!?", "<|endoftext|>", "<|endof", "　", "你", "a" * 30]
    for _ in range(60):
        text = "".join(rng.choices(parts, k=400))
        assert tokens.count_spliced(bpe, text, rng.randint(20, 200), rng.randint(1, 30)) == whole(bpe, text)


def test_twin_counts_alike(bpe):
    fast = tokens.twin(bpe)
    for lo in range(0, 0x3000, 64):
        cps = [chr(c) for c in range(lo, lo + 64)]
        for c in cps:
            t = f"a{c}b 1{c}2 {c}{c}! {c}x'{c}s \n{c}\n"
            assert fast.encode(t, allowed_special="all") == bpe.encode(t, add_special_tokens=False).ids


def test_other_libraries(bpe):
    import public_tokenizers

    piece = tokens.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert tokens.count_tokens(piece, ["hello there", ""]) == [len(piece.encode("hello there")), 0]
    word = tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens.twin(word) is None and tokens.count_tokens(word, ["Hello  there"]) == [whole(word, "Hello  there")]


def test_token_counts(spark):
    import public_tokenizers

    df = spark.createDataFrame([(1, None, "x"), (2, "", None), (3, "hello " * 600, "y"), (3, "hello " * 600, "y")], "doc_id long, text string, n_tokens string")
    got = sorted(tuple(r) for r in tokens.token_counts(df, public_tokenizers.path("byte_bpe_50k.json"), huge=500, chunk=200, overlap=8).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    n = whole(tokens.load(public_tokenizers.path("byte_bpe_50k.json")), "hello " * 600)
    assert got == [(1, 0, 0, False), (2, 0, 0, False), (3, 3600, n, True), (3, 3600, n, True)]
    assert tokens.token_counts(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_all_ways_of_counting_agree_on_a_whole_table():
    """The library, the twin and overlapping chunks of a few kB, over every document of sf0.01."""
    import duckdb
    import public_tokenizers

    tok = tokens.load(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    library = [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    assert tokens.count_tokens(tok, texts) == library
    assert tokens.count_tokens(tok, texts, huge=0, chunk=3000, overlap=128) == library
    assert sum(len(t) > 3000 for t in texts) > 100
