"""Words and shingles of whole texts, on bytes.

A word is a maximal run of ASCII letters and digits or of characters from U+0080 on, after
A-Z are lowered. In UTF-8 the same holds byte by byte, so one table lookup per byte finds
words without decoding.
"""

from __future__ import annotations

import numpy as np

_WORD = [c for c in range(256) if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80]
#: Maps upper to lower case, word bytes to themselves, all others to a blank.
FOLD = bytes(c if c in _WORD else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))

SHINGLE = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_U = np.uint64


def words(text: str | None) -> list[bytes]:
    """The words of a text in order; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def word_spans(raw: bytes) -> list[tuple[int, int]]:
    """Byte offsets (start, end) of the words."""
    inside = np.frombuffer(b" " + raw.translate(FOLD) + b" ", np.uint8) != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]).tolist()
    return list(zip(edges[0::2], edges[1::2], strict=True))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            np.cumprod(table, out=table)
            _powers[k] = table
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, one after another, and the number of words of each text."""
    folded = [t.translate(FOLD) for t in texts]
    joined = np.frombuffer(b" ".join([b"", *folded, b""]), np.uint8)
    inside = joined != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    power, inverse = _power_tables(len(joined))
    sums = np.cumsum(joined.astype(np.uint64) * power[: len(joined)])
    hashes = mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts])
    limits = np.cumsum([1 + len(t) for t in folded]) if folded else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, limits), prepend=0)
    return hashes, counts


_STEP = mix(np.arange(1, 64, dtype=np.uint64)) | _U(1)


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `width` words; a shorter text with words is one run."""
    hashes, counts = word_hashes(texts)
    runs = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        runs += hashes[k : k + len(runs)] * _STEP[k]
    runs = mix(runs)
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(runs[at : at + n - width + 1]))
        elif n:
            short = _U(n) + (hashes[at : at + n] * _STEP[width : width + n]).sum(dtype=np.uint64)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out
