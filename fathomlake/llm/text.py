"""Texts as flat numpy arrays: code points, word hashes, shingles."""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np

_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Characters handled at once; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: Sequence[str], limit: int = CHUNK_CHARS, least: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` characters each, a text counting as ``least`` at least."""
    begin, total = 0, 0
    for i, t in enumerate(texts):
        n = max(len(t), least)
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def codepoints(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row, and where each text begins (one entry more than texts)."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), out=at[1:])
    return cp, at


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 white space and control, 1 letter or digit, 2 any other sign."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum() or c == "_":
            out[i] = 1
        elif c.isprintable() and not c.isspace():
            out[i] = 2
    return out


@functools.lru_cache(maxsize=1)
def _places() -> np.ndarray:
    return mix64(np.arange(1, 4097, dtype=np.uint64) * _GOLD) | np.uint64(1)


def tokens(texts: Sequence[str], signs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and of single signs if wanted, with the
    boundaries of each text in them."""
    cp, at = codepoints([t.lower() for t in texts])
    if not len(cp):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = _classes()[cp]
    word = kind == 1
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(cp))]
    begins[inner] |= word[inner]
    if signs:
        begins |= kind == 2
        used = kind > 0
    else:
        used = word
    where = np.flatnonzero(begins)
    bounds = np.searchsorted(where, at)
    if not len(where):
        return np.empty(0, np.uint64), bounds
    signs_used = cp[used].astype(np.uint64)
    heads = np.flatnonzero(begins[used])
    place = np.arange(len(signs_used)) - np.repeat(heads, np.diff(np.append(heads, len(signs_used))))
    signs_used += np.uint64(1)
    signs_used *= _places()[place & 4095]
    return mix64(np.add.reduceat(signs_used, heads)), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``width`` words of a text; a shorter text that has
    words is one shingle. Returned with the number of each one's text."""
    n = np.diff(bounds)
    doc_of = np.repeat(np.arange(len(n)), n)
    total = len(words)
    if not total:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    acc = np.zeros(total, np.uint64)
    left = np.repeat(bounds[1:], n) - np.arange(total)  # words from here to the text's end
    for k in range(width):
        shifted = np.zeros(total, np.uint64)
        shifted[: total - k] = words[k:] if k else words
        shifted[left <= k] = 0
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(k + 1))
    at_head = np.zeros(total, bool)
    at_head[bounds[:-1][n > 0]] = True
    whole = (left >= width) | at_head
    return acc[whole], doc_of[whole]
