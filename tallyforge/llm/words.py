"""Vectorised word kernel over Arrow string buffers.

A word is a maximal run of bytes outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after
A-Z are lower-cased, so digits, a-z and every byte of a non-ASCII character belong to
words.  As no byte of a multi-byte character is below 0x80, working on UTF-8 bytes
gives the same words as the character class on code points.

Word hashes are polynomial sums modulo 2**64 taken from one prefix sum per segment and
then finalised, so a whole segment of many texts costs a handful of numpy passes.
Segments are about 1 MB and cut between words; a text of any length is processed in
bounded temporary memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = True
IS_WORD[65:91] = True
IS_WORD[97:123] = True
IS_WORD[128:] = True

_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _pow.get("p")
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        for key, base in (("p", _P), ("i", _PINV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
    return _pow["p"], _pow["i"]


def release() -> None:
    """Gives memory that a finished task no longer needs back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (len + 1) of a string array; nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return b[o[0] : o[-1]], o - o[0]


def groups(offs: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Runs of rows holding about ``size`` bytes (a longer text makes its own run)."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, hash) of every word; a word never crosses a text boundary."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    out = []
    pos = 0
    while pos < n:
        end = min(pos + SEGMENT, n)
        while end < n:  # cut where a word cannot continue
            free = np.flatnonzero(~IS_WORD[buf[pos:end]] | first[pos:end])
            if len(free) and free[-1] > 0:
                end = pos + int(free[-1])
                break
            end = min(end + SEGMENT, n)
        out.append(_segment(buf[pos:end], first[pos : end + 1], pos))
        pos = end
    if len(out) == 1:
        return out[0]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _segment(buf: np.ndarray, first: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    isw = IS_WORD[buf]
    begin, last = isw.copy(), isw.copy()
    begin[1:] &= ~isw[:-1] | first[1:n]
    last[:-1] &= ~isw[1:] | first[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    p, inv = _powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[buf].astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:])
    h = mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64))
    return s + base, e + base, h


def hash_word(word: str) -> int:
    """The kernel's hash of one word (already lower-cased or not)."""
    b = np.frombuffer(word.encode(), np.uint8)
    return int(words(b, np.array([0, len(b)]))[2][0])


def text_words(text: str | None) -> list[str]:
    """The words of one text in the plain way; what the kernel is tested against, and how small tables are read."""
    b = (text or "").encode("utf-8", "surrogatepass").lower()
    out, at = [], 0
    flags = IS_WORD[np.frombuffer(b, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    for at, to in edges.reshape(-1, 2):
        out.append(b[at:to].decode("utf-8", "surrogatepass"))
    return out


def code_points(buf: np.ndarray) -> np.ndarray:
    """Number of code points that begin before each byte position (len + 1)."""
    c = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=c[1:])
    return c
