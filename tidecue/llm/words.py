"""Words of whole texts as 64-bit hashes, computed for a batch of texts in numpy.

A word is a maximal run of bytes that are not separators; A-Z count as a-z. Since separators are ASCII,
working on UTF-8 bytes gives the same words as working on characters. The hash of a word is a polynomial
over its bytes modulo 2**64, finished by a mixing step; two different words agree with a chance of about
2**-64.
"""

from __future__ import annotations

import numpy as np

#: Bytes worked on at once; longer texts are cut between two words.
CHUNK = 1 << 20
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = _RNG.integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: For classifiers: everything but ASCII letters, digits and bytes of other scripts separates words.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = np.zeros(0, np.uint64)
_DOWN = np.zeros(0, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _UP, _DOWN
    if len(_UP) < n:
        _UP, _DOWN = _powers(_BASE, n), _powers(_INVERSE, n)
    return _UP, _DOWN


def _chunk_words(data: bytes, separators: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word, that of its first ``head`` bytes, and its first byte's place."""
    a = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = ~separators[a]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(a) + 1)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * up[: len(a)], out=sums[1:])

    def hashed(ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    return hashed(ends), hashed(np.minimum(ends, starts + head)) if head else starts[:0], starts


def pieces(text: bytes, separators: np.ndarray) -> list[bytes]:
    """A long text cut at separators."""
    out, i = [], 0
    while len(text) - i > CHUNK:
        j = i + CHUNK
        while j < len(text) and not separators[text[j]]:
            j += 1
        out.append(text[i:j])
        i = j
    return [*out, text[i:]]


def word_hashes(texts: list[str | None], separators: np.ndarray = WHITE, head: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, of their first ``head`` bytes, and where each text's words start.

    The last has one entry more than there are texts. Null and empty texts have no words.
    """
    found: list[np.ndarray] = []
    heads: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    pending: list[bytes] = []
    first = size = 0

    def flush(upto: int) -> None:
        nonlocal pending, first, size
        if pending:
            bounds = np.cumsum([0, *(len(p) + 1 for p in pending)])
            hashes, begun, starts = _chunk_words(b"\n".join(pending), separators, head)
            counts[first + 1 : upto + 1] = np.diff(np.searchsorted(starts, bounds))
            found.append(hashes)
            heads.append(begun)
        pending, first, size = [], upto, 0

    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "replace")
        if size + len(b) > CHUNK:
            flush(i)
        if len(b) > CHUNK:
            for piece in pieces(b, separators):
                hashes, begun, _ = _chunk_words(piece, separators, head)
                counts[i + 1] += len(hashes)
                found.append(hashes)
                heads.append(begun)
            first = i + 1
            continue
        pending.append(b)
        size += len(b)
    flush(len(texts))
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(found or none), np.concatenate(heads or none), np.cumsum(counts)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every stretch of ``width`` words; those of other widths are others."""
    n = max(0, len(hashes) - width + 1)
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled = rolled + hashes[k : k + n] * _STEPS[k]
    return mix(rolled)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    A text with fewer words than the width has its whole sequence as one shingle; without words, none.
    """
    n = len(hashes) - width + 1
    rolled = np.zeros(0, np.uint64)
    if n > 0:
        rolled = hashes[:n] * _STEPS[0]
        for k in range(1, width):
            rolled = rolled + hashes[k : k + n] * _STEPS[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = (hashes[a:b] * _STEPS[: b - a]).sum(keepdims=True) + np.array([b - a], np.uint64)
            out.append(mix(whole ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
