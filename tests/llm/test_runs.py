"""Periodic runs against their definition, tried for every period."""

from __future__ import annotations

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from tidecue.llm import queries as q
from tidecue.llm import runs


def brute_runs(words: list) -> list[tuple[int, int, int]]:
    """For each period all maximal stretches, the smallest period of a stretch first."""
    n, found, known = len(words), [], set()
    for period in range(1, n // 3 + 1):
        i = period
        while i < n:
            j = i
            while j < n and words[j] == words[j - period]:
                j += 1
            stretch = (i - period, j - i + period)
            if j > i and stretch[1] >= max(24, 3 * period) and stretch not in known:
                known.add(stretch)
                found.append((*stretch, period))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def planted(rng: random.Random, n: int, vocabulary: int) -> list[int]:
    words = [rng.randrange(vocabulary) for _ in range(n)]
    for _ in range(rng.randrange(4) if n > 5 else 0):
        start = rng.randrange(n)
        period = rng.randrange(1, max(2, n // rng.choice([3, 8, 20]) + 1))
        for i in range(start + period, rng.randrange(start, n)):
            words[i] = words[i - period]
    return words


@pytest.mark.parametrize("vocabulary", [1, 2, 3, 20])
def test_runs_equal_their_definition(vocabulary):
    rng = random.Random(vocabulary)
    seen = 0
    for _ in range(800):
        words = planted(rng, rng.randrange(260), vocabulary)
        expected = brute_runs(words)
        assert runs.find_runs(np.array(words, np.int64)) == expected
        seen += len(expected)
    assert seen > 100


@pytest.mark.parametrize("period", [1, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100])
def test_bounds_of_length(period):
    """A run is found from max(24, 3 q) words on, and not one word earlier."""
    least = max(24, 3 * period)
    for length, found in ((least - 1, []), (least, [(5, least, period)]), (least + 1, [(5, least + 1, period)])):
        body = [i % period for i in range(length)]
        words = [*range(1000, 1005), *body, *range(2000, 2010)]
        assert runs.find_runs(np.array(words)) == found == brute_runs(words)


def test_runs_within_runs():
    """A run whose own period holds a run, and two that overlap by less than a period."""
    inner = [1, 2] * 13
    words = ([*inner, *range(10, 40)]) * 3
    assert runs.find_runs(np.array(words)) == brute_runs(words)
    assert {r[2] for r in brute_runs(words)} == {2, 56}
    words = [*([1, 2, 3] * 10), 1, *([2, 3, 1, 9] * 9)]
    assert runs.find_runs(np.array(words)) == brute_runs(words) != []


@pytest.mark.parametrize("period", [1, 7, 100_000])
def test_long_texts_take_near_linear_time(period):
    began = time.perf_counter()
    assert runs.find_runs(np.arange(400_000) % period) == [(0, 400_000, period)]
    assert time.perf_counter() - began < 20


def test_collapsed_texts_and_odd_rows(spark):
    """Nulls, empty texts, white space of all kinds, repeated rows, clashing columns, an empty table."""
    line = "one two  three\tfour\n"
    texts = [(1, line * 9), (1, line * 9), (None, "x " * 30), (3, None), (4, ""), (5, " \x0b\x0c\r\n"), (6, "a b"), (7, "Café x " * 24 + "end")]
    df = spark.createDataFrame([(k, t, "a", 1, "b") for k, t in texts], "doc_id long, text string, k string, runs long, t string")
    found = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df).collect()), key=repr)
    expected = []
    for k, t in texts:
        words = (t or "").encode().split()
        own = brute_runs(words)
        expected.append((k, len(words), own, b" ".join(brute_collapsed(words, own)).decode()))
    assert found == sorted(expected, key=repr)
    assert found[0] == (1, 36, [(0, 36, 4)], "one two three four")
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_query_by_its_definition(spark, tmp_path):
    rng = random.Random(3)
    texts = {i: " ".join(f"w{x}" for x in planted(rng, rng.randrange(150), rng.choice([2, 40]))) for i in range(300)} | {301: None, 302: "", 303: " \t", 1000003: "only"}
    spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in q.op12_periodic_runs(spark, str(tmp_path)).collect()}
    changed = 0
    for k, t in texts.items():
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(str(k).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            changed += 1
        own = brute_runs(words)
        best = max(own, key=lambda r: (r[1] * 10**6 // r[2], -r[0], -r[2]), default=(None, None, None))
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in own)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        r = found[k]
        assert (r.n_runs, r.start, r.length, r.period) == (len(own), *best), k
        assert r.exponent_milli == (1000 * best[1] // best[2] if own else None)
        assert (r.runs_sha256, r.collapsed_sha256) == (sha(lines.encode()), sha(b" ".join(brute_collapsed(words, own))))
    assert changed > 15 and len(found) == len(texts)
