"""Vectorised words and hashes over UTF-8 bytes.

A chunk of texts is one byte buffer, the texts parted by a space. A table maps each byte to its
lower-cased value, or to 0 if it is outside words. Every word gets the polynomial hash of its bytes from one
running sum (modulo 2**64), so nothing loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Bytes of text that are worked on at once; a longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 18

_byte = np.arange(256)
_lower = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte)
#: Bytes of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, shifted by one so that 0 means "outside".
SPACED = np.where((_byte == 32) | ((_byte >= 9) & (_byte <= 13)), 0, _lower + 1).astype(np.uint16)
ALNUM = np.where(((_lower >= 48) & (_lower <= 57)) | ((_lower >= 97) & (_lower <= 122)) | (_byte >= 128), _lower + 1, 0).astype(np.uint16)

_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Words:
    """The words of a chunk of texts: ``start``, ``end`` in ``data``, ``doc`` of each; ``first`` has each text's first word."""

    def __init__(self, texts: list[bytes], kinds: np.ndarray):
        self.texts = texts
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.codes = kinds[self.data]
        inside = (self.codes != 0).view(np.int8)
        step = np.diff(inside, prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.begin = np.cumsum(size) - size  # byte at which each text begins
        self.first = np.searchsorted(self.start, np.append(self.begin, len(self.data)))
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self._sum = None

    def _sums(self) -> np.ndarray:
        if self._sum is None:
            up, _ = powers(len(self.data) + 1)
            self._sum = np.empty(len(self.data) + 1, U)
            self._sum[0] = 0
            np.cumsum(self.codes.astype(U) * up[: len(self.data)], out=self._sum[1:])
        return self._sum

    def hash_between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = self._sums()
        _, down = powers(len(self.data) + 1)
        return mix((total[end] - total[start]) * down[start])

    def hashes(self) -> np.ndarray:
        return self.hash_between(self.start, self.end)

    def runs(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of its first word, hash) of each run of ``n`` words that lies in one text."""
        last = len(hashes) - n + 1
        if last <= 0:
            return np.empty(0, np.int64), np.empty(0, U)
        h = np.zeros(last, U)
        for k in range(n):
            h = h * U(BASE) + hashes[k : k + last]
        at = np.flatnonzero(self.doc[:last] == self.doc[n - 1 :])
        return at, mix(h[at])


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts): whole texts of ``most`` bytes together, or one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [b"" if v is None else v for v in column.cast(kind).to_pylist()]


def hash_words(words: list[bytes]) -> int:
    """The hash of a run of words as ``Words.runs`` gives it, for lists of words in Python."""
    w = Words([b" ".join(words)], SPACED)
    return int(w.runs(len(words), w.hashes())[1][0])
