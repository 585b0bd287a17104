"""Matching blocks of many pairs of texts at once, in arrays.

The blocks of a pair are found greedily: the longest stretch that both texts hold (the first in the one, then in the
other, of equally long ones) is a block, and what lies before it and behind it in both texts is matched in the same
way. Here a *box* is a stretch of the one text with a stretch of the other; every round takes all boxes of all pairs
together, finds the longest block of each, and replaces the box by the two beside it.

The longest block of a box is found by seeds: grams of several characters, packed into one integer, are joined
within the box; neighbouring meetings on a diagonal are one stretch. If there is any seed, the longest stretch
holds one, so only boxes without seeds go on to shorter grams, down to single characters. Boxes whose
characters meet too often, as those of texts that repeat themselves, are searched by the length of the block instead.
"""

from __future__ import annotations

import numpy as np

#: Characters of both texts that are matched in one piece of work.
PIECE = 1 << 17
#: Meetings of grams in one piece of work; boxes that would bring more are searched by length.
MEETINGS = 1 << 22


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts, and where each text begins (and the last ends)."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), ends


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ranges, and the range that each belongs to."""
    size = np.maximum(high - low, 0)
    of = np.repeat(np.arange(len(low)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + low[of], of


class _Grams:
    """Grams of k characters at every place of two arrays, as numbers below ``base``."""

    def __init__(self, a: np.ndarray, b: np.ndarray, bits: int, k: int):
        packed = []
        for x in (a, b):
            n = max(0, len(x) - k + 1)
            own = np.zeros(n, np.int64)
            for i in range(k):
                own = (own << bits) | x[i : i + n]
            packed.append(own)
        found, place = np.unique(np.concatenate(packed), return_inverse=True)
        self.k, self.base, self.a, self.b = k, len(found) + 1, place[: len(packed[0])], place[len(packed[0]) :]


def _best(box: np.ndarray, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each box the row of the longest stretch, the first in a, then in b, of equally long ones."""
    order = np.lexsort((j, i, -size, box))
    return order[np.flatnonzero(np.diff(box[order], prepend=-1))]


def _by_seeds(boxes: np.ndarray, grams: _Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(box, i, j, size) of the longest blocks with a seed, which boxes are without, and which meet too often."""
    k = grams.k
    at_a, of_a = _ranges(boxes[0], boxes[1] - k + 1)
    at_b, of_b = _ranges(boxes[2], boxes[3] - k + 1)
    key_a, key_b = of_a * grams.base + grams.a[at_a], of_b * grams.base + grams.b[at_b]
    order = np.argsort(key_b, kind="stable")
    key_b, at_b = key_b[order], at_b[order]
    first, last = np.searchsorted(key_b, key_a, "left"), np.searchsorted(key_b, key_a, "right")
    meetings = np.bincount(of_a, last - first, boxes.shape[1])
    often = meetings.cumsum() > MEETINGS
    often &= meetings > 64 * np.minimum(boxes[1] - boxes[0], boxes[3] - boxes[2])
    use = ~often[of_a]
    place, row = _ranges(first[use], last[use])
    i, j, box = at_a[use][row], at_b[place], of_a[use][row]
    order = np.lexsort((i, i - j, box))
    i, j, box = i[order], j[order], box[order]
    begin = np.ones(len(i), bool)
    begin[1:] = (np.diff(box) != 0) | (np.diff(i) != 1) | (np.diff(j) != 1)
    starts = np.flatnonzero(begin)
    size = np.diff(np.append(starts, len(i))) + k - 1
    found = np.stack([box[starts], i[starts], j[starts], size])
    return found[:, _best(*found)], np.flatnonzero((meetings == 0) & ~often), np.flatnonzero(often)


def _by_length(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(i, j, size) of the longest block of two texts, by bisection of its size; size is 0 without any.

    Stretches of 2**p characters are numbered, and those of any size told apart by the numbers at their two ends.
    """
    n, whole = len(a), np.concatenate([a, [-1], b])
    numbers = [np.unique(whole, return_inverse=True)[1]]

    def common(size: int) -> tuple[np.ndarray, np.ndarray]:
        p = size.bit_length() - 1
        while len(numbers) <= p:
            half = 1 << (len(numbers) - 1)
            x = numbers[-1]
            numbers.append(np.unique(x[:-half] * (len(whole) + 1) + x[half:], return_inverse=True)[1])
        x, shift = numbers[p], size - (1 << p)
        key = x[: len(whole) - size + 1] * (len(whole) + 1) + x[shift : shift + len(whole) - size + 1]
        return key[: max(0, n - size + 1)], key[n + 1 :]

    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if np.isin(*common(middle)).any() else (low, middle - 1)
    if not low:
        return 0, 0, 0
    x, y = common(low)
    i = int(np.flatnonzero(np.isin(x, y))[0])
    return i, int(np.flatnonzero(y == x[i])[0]), low


def _blocks(a: np.ndarray, b: np.ndarray, boxes: np.ndarray, pair: np.ndarray, least: np.ndarray) -> np.ndarray:
    """(pair, i, j, size) of all blocks in boxes (from and to in a, from and to in b) of pairs of characters.

    Pairs that can no longer reach their ``least`` number of matched characters may be left unfinished.
    """
    kinds, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    bits = max(1, int(len(kinds) - 1).bit_length())
    a, b = place[: len(a)], place[len(a) :]
    widths = [k for k in dict.fromkeys((min(12, 62 // bits), 3, 1)) if k * bits < 63]
    grams = {k: _Grams(a, b, bits, k) for k in widths}
    done, matched = [np.zeros((4, 0), np.int64)], np.zeros(len(least), np.int64)
    while boxes.shape[1]:
        room = matched + np.bincount(pair, np.minimum(boxes[1] - boxes[0], boxes[3] - boxes[2]), len(least)).astype(np.int64)
        keep = (room >= least)[pair]
        boxes, pair = boxes[:, keep], pair[keep]
        found, left = [], np.arange(boxes.shape[1])
        for k in widths:
            blocks, without, often = _by_seeds(boxes[:, left], grams[k])
            blocks[0] = left[blocks[0]]
            found.append(blocks)
            for box in left[often].tolist():
                x, y, u, v = boxes[:, box].tolist()
                i, j, size = _by_length(a[x:y], b[u:v])
                found.append(np.array([[box], [x + i], [u + j], [size]]))
            left = left[without]
        box, i, j, size = np.concatenate(found, axis=1)
        done.append(np.stack([pair[box], i, j, size]))
        matched += np.bincount(pair[box], size, len(least)).astype(np.int64)
        x, y, u, v = boxes[:, box]
        beside = np.concatenate([np.stack([x, i, u, j]), np.stack([i + size, y, j + size, v])], axis=1)
        use = (beside[0] < beside[1]) & (beside[2] < beside[3])
        boxes, pair = beside[:, use], np.concatenate([pair[box], pair[box]])[use]
    return np.concatenate(done, axis=1)


def matching_blocks(want: list[str], got: list[str]) -> list[list[tuple[int, int, int]]]:
    """The blocks (i, j, size) of pairs of texts, in order; neighbouring ones are not joined."""
    a, at_a = codes(want)
    b, at_b = codes(got)
    n = len(want)
    pair, i, j, size = _blocks(a, b, np.stack([at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]]), np.arange(n), np.zeros(n, np.int64))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    for k in np.lexsort((i, pair)).tolist():
        out[pair[k]].append((int(i[k] - at_a[pair[k]]), int(j[k] - at_b[pair[k]]), int(size[k])))
    return out


def _piece_partners(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.diff(at_a), np.diff(at_b)
    out = np.full(len(a), -1)
    own = np.repeat(np.arange(len(n)), n)
    # the same text: each character is its own partner
    alike = n == m
    at = np.flatnonzero(alike[own])
    other = at - at_a[own[at]] + at_b[own[at]]
    alike &= np.bincount(own[at][a[at] != b[other]], minlength=len(n)) == 0
    same = alike[own[at]]
    out[at[same]] = other[same]
    good = alike & (n > 0)
    share = lambda x: 2.0 * x / np.maximum(n + m, 1)
    # common characters, whatever their order, are an upper bound of what can match
    kinds, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    keys = [o * len(kinds) + p for o, p in ((own, place[: len(a)]), (np.repeat(np.arange(len(m)), m), place[len(a) :]))]
    (x, nx), (y, ny) = (np.unique(k, return_counts=True) for k in keys)
    both, ix, iy = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    bound = np.bincount(both // max(1, len(kinds)), np.minimum(nx[ix], ny[iy]), len(n))
    asked = np.flatnonzero(~alike & (share(bound) >= ratio))
    least = np.ceil((n + m)[asked] * ratio / 2 - 1e-9).astype(np.int64)
    boxes = np.stack([at_a[:-1], at_a[1:], at_b[:-1], at_b[1:]])[:, asked]
    pair, i, j, size = _blocks(a, b, boxes, np.arange(len(asked)), least)
    enough = share(np.bincount(asked[pair], size, len(n))) >= ratio
    good[asked] = enough[asked]
    use = enough[asked[pair]]
    at, of = _ranges(i[use], (i + size)[use])
    out[at] = at - i[use][of] + j[use][of]
    return out, good


def partners(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """For each character of the texts in a the place in b of the one it matches, or -1, and which pairs match well.

    Texts are given as ``codes`` gives them. A pair matches well if its blocks hold the ``ratio`` of both its texts;
    other pairs have no partners.
    """
    out, good = np.full(len(a), -1), np.zeros(len(at_a) - 1, bool)
    total = at_a + at_b
    x = 0
    while x < len(good):
        y = max(x + 1, int(np.searchsorted(total, total[x] + PIECE, "right")) - 1)
        found, good[x:y] = _piece_partners(a[at_a[x] : at_a[y]], at_a[x : y + 1] - at_a[x], b[at_b[x] : at_b[y]], at_b[x : y + 1] - at_b[x], ratio)
        out[at_a[x] : at_a[y]] = np.where(found >= 0, found + at_b[x], -1)
        x = y
    return out, good
