"""Words of texts. Two notions of a word are in use, both on ASCII classes only:
letters, digits and everything beyond ASCII (``plain_words``), or whatever stands between
ASCII white space (``spaced_words``)."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import xxhash

_PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if 48 <= x <= 57 or 97 <= x <= 122 or x > 127 else 32 for x in range(256))
PLAIN_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED_PATTERN = r"[^\x20\x09-\x0D]+"


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def plain_words(text: str) -> list[bytes]:
    """A-Z lower-cased; matches of PLAIN_PATTERN."""
    return utf8(text).translate(_PLAIN).split()


def spaced_words(text: str, lower: bool = False) -> list[bytes]:
    """Matches of SPACED_PATTERN, A-Z lower-cased if asked."""
    raw = utf8(text)
    return (raw.lower() if lower else raw).split()


class WordHashes:
    """64-bit hashes of words. None are kept: hashing a word takes less time than finding it among many."""

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def look_up(ids: dict[bytes, int], words: list[bytes]) -> np.ndarray:
    """Ids of words, 0 for those that have none."""
    return np.fromiter(map(ids.get, words, repeat(0)), np.int32, len(words))


def mixed(a: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (fixed constants of the murmur family)."""
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    a = (a ^ (a >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return a ^ (a >> np.uint64(33))


def word_windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash per k consecutive words."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n] + np.uint64(i + 1))
    return out
