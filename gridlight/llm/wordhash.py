"""Word splitting on UTF-8 bytes and strong 64-bit word hashes for numpy.

Both splits work on bytes: all separators are ASCII, so multi-byte characters stay
whole, and ``bytes.split``/``translate`` run at memory speed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A-Z to a-z; all below 0x80 that is not a letter or digit to a blank.
_ALNUM = bytes(
    c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``."""
    return text.translate(_LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    return text.translate(_ALNUM).split()


class WordIds(dict):
    """word -> xxh64, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def finish(h: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values."""
    h = (h ^ (h >> _S33)) * _C1
    h = (h ^ (h >> _S33)) * _C2
    return h ^ (h >> _S33)


def grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; empty with fewer than k words."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    h = ids[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            h *= base
            h += ids[j : n + j]
        return finish(h + np.uint64(k))


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
