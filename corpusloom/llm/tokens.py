"""Token counts of whole texts; huge ones in overlapping chunks that are spliced where both encodings provably agree."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm import base, kernel

#: Characters from which a text is encoded in chunks; of a chunk; of the first overlap tried.
HUGE, CHUNK, OVERLAP = 65_536, 32_768, 256
#: Characters before a chunk's end within which its boundaries prove nothing: longer than any look-ahead or contraction of the
#: splitting pattern; special strings are added to it.
MARGIN = 16
#: Characters of texts that are encoded in one call.
AT_ONCE = 200_000

#: How byte-level BPE splits texts (fixed by the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, object] = {}
_twins: dict[int, object] = {}


def load(path: str):
    """The tokenizer of a ``.json`` file (tokenizers) or a ``.model`` file (sentencepiece), once a process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            _loaded[path] = tok
    return _loaded[path]


def can_splice(tok) -> bool:
    """Whether pieces before the merges depend on no earlier text: byte-level splitting by pattern, no normaliser, no added prefix.

    Then from any piece boundary on, pieces follow from the text that comes after alone, and merges never cross pieces.
    """
    import json

    spec = json.loads(tok.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
    return spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and bool(pre.get("use_regex")) and plain


def twin(tok):
    """The same byte-level BPE as ranks in tiktoken, which counts several times as fast; None where it can't be the same.

    It is the same where the texts are split by the same pattern, merges rank by their result's id, every merge result
    is in the vocabulary and special strings match as they stand.
    """
    import json

    import tiktoken

    spec = json.loads(tok.to_str())
    model = spec["model"]
    if not can_splice(tok) or model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    vocab, merges = model["vocab"], ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [vocab.get(m, -1) for m in merges]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level vocabularies show as they are
    hidden = [b for b in range(256) if b not in shown]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    if ids != sorted(set(ids)) or any(c not in vocab for c in back) or len(vocab) != 256 + len(merges):
        return None
    ranks = {bytes(back[c] for c in word): i for word, i in vocab.items()}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    return tiktoken.Encoding("twin", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _starts(enc) -> dict[int, int]:
    """Character at which each piece (word before merges, or special string) starts -> index of its first token."""
    out: dict[int, int] = {}
    last = object()
    for i, (word, (a, _)) in enumerate(zip(enc.word_ids, enc.offsets, strict=True)):
        if word != last or word is None:
            out.setdefault(a, i)
        last = word
    return out


def count_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, from chunks.

    Chunk A begins at a true piece boundary (the text's begin, or the last splice), so its pieces are true but near its end. The
    next chunk B begins ``overlap`` characters before A's end. A character at which pieces start in both, a margin before A's end, is a true
    boundary for B as well: A counts up to it and B goes on from it. Without such a character the overlap is doubled,
    up to all of A; then A itself is made longer, in the end to the whole text.
    """
    special = max([len(t.content) for t in tok.get_added_tokens_decoder().values()], default=0)
    margin = MARGIN + special
    total, at, size = 0, 0, chunk
    while True:
        end = min(len(text), at + size)
        a = tok.encode(text[at:end], add_special_tokens=False)
        if end == len(text):
            return total + len(a.ids)
        starts_a = {at + c: i for c, i in _starts(a).items()}
        wide, splice = overlap, None
        while splice is None:
            begin = max(at, end - wide)
            if begin <= at:
                break
            b = tok.encode(text[begin : min(len(text), end + margin)], add_special_tokens=False)
            both = [c for c in (begin + c for c in _starts(b)) if c in starts_a and begin < c <= end - margin]
            splice = max(both, default=None)
            wide *= 2
        if splice is None:
            size *= 2
            continue
        total += starts_a[splice]
        at, size = splice, chunk


def count_tokens(tok, texts: list[str], huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    if not hasattr(tok, "encode_batch"):
        return [len(tok.encode(t)) for t in texts]
    splice, fast = can_splice(tok), _twins.setdefault(id(tok), None) or twin(tok)
    _twins[id(tok)] = fast
    out, group, size = [0] * len(texts), [], 0

    def flush() -> None:
        for i, e in zip(group, tok.encode_batch_fast([texts[i] for i in group], add_special_tokens=False), strict=True):
            out[i] = len(e)
        group.clear()

    for i, t in enumerate(texts):
        if len(t) > huge and splice:
            out[i] = count_spliced(tok, t, chunk, overlap)
        elif t and fast:
            out[i] = len(fast.encode(t, allowed_special="all"))
        elif t:
            group.append(i)
            size += len(t)
            if size > AT_ONCE:
                flush()
                size = 0
    if group:
        flush()
    return out


def token_counts(docs: DataFrame, path: str, *, text: str = "text", limit: int = 512, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit); columns with these names are replaced.

    Counts are those of the library for the whole text, without begin, end or added special tokens; special strings inside
    texts are handled as its default. A text of over ``huge`` characters is encoded in overlapping chunks where the tokenizer's
    splitting allows a proof (``can_splice``), else whole. Null and empty texts have 0 bytes and tokens. Rows are mapped one by one: no shuffle,
    repeated rows count alike, an empty table stays empty.
    """
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def start():
        import pyarrow as pa

        tok = load(path)

        def work(batch):
            raw = kernel.as_bytes(batch.column(text))
            n = count_tokens(tok, [t.decode() for t in raw], huge, chunk, overlap)
            return [pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())]

        return work

    return base.append_columns(docs, fields, start)
