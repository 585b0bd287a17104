"""The matcher of many pairs against Python's own, pair by pair."""

from __future__ import annotations

import difflib
import random
import time

import numpy as np
import pytest

from tidecue.operators import matching as mt

ALPHABETS = ["a", "ab", "abcdefghij", "abcdefghijklmnopqrstuvwxyz", "的一是不了人我在有他这中大来上国", "a𝒳é́"]


def altered(rng: random.Random, text: str, alphabet: str, rate: float) -> str:
    s = list(text)
    for _ in range(int(len(s) * rate) + rng.randrange(2)):
        k = rng.randrange(len(s) + 1)
        s[k : k + rng.randrange(3)] = [rng.choice(alphabet) for _ in range(rng.randrange(3))]
    return "".join(s)


def pairs(n: int, seed: int) -> tuple[list[str], list[str]]:
    rng = random.Random(seed)
    a, b = [], []
    for _ in range(n):
        alphabet = rng.choice(ALPHABETS)
        a.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(120))))
        b.append(altered(rng, a[-1], alphabet, rng.choice([0, 0.05, 0.3])) if rng.random() < 0.8 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(120))))
    return a, b


def joined(blocks):
    out: list = []
    for i, j, n in blocks:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (out[-1][0], out[-1][1], out[-1][2] + n)
        else:
            out.append((i, j, n))
    return out


def known(a: str, b: str) -> difflib.SequenceMatcher:
    return difflib.SequenceMatcher(None, a, b, autojunk=False)


@pytest.mark.parametrize("meetings", [20, mt.MEETINGS])
def test_blocks_of_random_pairs(monkeypatch, meetings):
    """10,000 pairs; with few meetings allowed, boxes are searched by length as well."""
    monkeypatch.setattr(mt, "MEETINGS", meetings)
    a, b = pairs(10_000 if meetings > 20 else 2_000, meetings)
    for x, y, found in zip(a, b, mt.matching_blocks(a, b), strict=True):
        assert joined(found) == [tuple(m) for m in known(x, y).get_matching_blocks()[:-1]], (x, y)


@pytest.mark.parametrize("piece", [50, mt.PIECE])
def test_partners_of_random_pairs(monkeypatch, piece):
    monkeypatch.setattr(mt, "PIECE", piece)
    a, b = pairs(1_500, 7)
    (x, at_x), (y, at_y) = mt.codes(a), mt.codes(b)
    found, good = mt.partners(x, at_x, y, at_y, 0.85)
    for k, (s, t) in enumerate(zip(a, b, strict=True)):
        match, expected = known(s, t), np.full(len(s), -1)
        assert good[k] == (match.ratio() >= 0.85 and len(s) > 0)
        for i, j, n in match.get_matching_blocks() if good[k] else []:
            expected[i : i + n] = np.arange(j, j + n) + at_y[k]
        assert (found[at_x[k] : at_x[k + 1]] == expected).all()


@pytest.mark.parametrize("unit", ["abcdefghijklmnopqrstuvwxyz", "ab", "a", None])
def test_long_pairs_in_little_time(unit):
    rng = random.Random(3)
    a = "hello world foo bar " * 1000 if unit is None else "".join(rng.choice(unit) for _ in range(20_000))
    b = altered(rng, a, "abc", 0.03)
    began = time.perf_counter()
    (found,) = mt.matching_blocks([a], [b])
    assert time.perf_counter() - began < 2
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in found)
    assert all(p[0] + p[2] <= q[0] and p[1] + p[2] <= q[1] for p, q in zip(found, found[1:], strict=False))
    if unit and len(unit) > 1:  # of texts that repeat themselves the longest block may lie far off the diagonal
        assert sum(n for _, _, n in found) > 0.8 * len(a)


def test_no_pairs_and_empty_texts():
    assert mt.matching_blocks([], []) == []
    assert mt.matching_blocks(["", "a", ""], ["a", "", ""]) == [[], [], []]
    found, good = mt.partners(*mt.codes(["", "a"]), *mt.codes(["x", ""]), 0.85)
    assert found.tolist() == [-1] and good.tolist() == [False, False]
