"""Periodic runs of words: stretches that repeat themselves word for word at least three times.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring
word extends keeping q, and that is long enough: ``LEAST`` words and ``TURNS`` times q.

Each text is read once by an online sparse diagonal DP. Word i and an earlier word i - d lie on the diagonal of lag
d. For each word its earlier occurrences increment the match lengths of their lags, which are the active ones;
a lag that is not incremented ends, and emits its run at once if it is long enough.

What makes the diagonals sparse is which occurrences count, and no run is lost by it:

1. A run of period q matches over 2 q words and over ``GRAM`` words at least. So an earlier occurrence counts for
   lags up to m only where the m words that end in it are the same ones, with m = ``GRAM``, 2 ``GRAM``,
   4 ``GRAM`` and so on, for lags of more than m / 2 each (the first m: for all lags up to it).
2. Of these occurrences the latest one is enough: were there a smaller lag d than q within a run of smallest
   period q, then m + d words would have both periods, hence also their common divisor, and q were not the smallest.

So a word has at most one lag for each m, whatever it repeats, and a text of n words takes O(n log n) steps and O(n)
memory. Words are compared as whole words, not by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.llm.common import slices
from tidecue.llm.words import WHITE, pieces

LEAST = 24
TURNS = 3
#: Words that every run's matches cover: the least of max(LEAST - q, (TURNS - 1) * q) over all periods q.
GRAM = 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(text: str | None) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the distinct words by number."""
    known: dict[bytes, int] = {}
    found = [np.fromiter((known.setdefault(w, len(known)) for w in piece.split()), np.int64) for piece in pieces((text or "").encode("utf-8", "replace"), WHITE)]
    return np.concatenate(found), list(known)


def earlier(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words, ascending, with the lags of their earlier occurrences that count."""
    n, m, base = len(words), 1, 1 + int(words.max(initial=0))
    at, code = np.arange(n), words  # places where the last m words occur more than once, and which words these are
    places, lags = [at[:0]], [at[:0]]
    while len(at) and (m <= GRAM or TURNS * (m // 2 + 1) <= n):
        if m >= GRAM:
            order = np.argsort(code, kind="stable")
            lag = np.diff(at[order])
            use = (np.diff(code[order]) == 0) & (lag <= m) & ((lag > m // 2) | (m == GRAM))
            places.append(at[order[1:]][use])
            lags.append(lag[use])
        ends = np.full(n, -1, np.int64)
        ends[at] = code
        later = at >= m
        at, second = at[later], code[later]
        first = ends[at - m]
        at, second, first = at[first >= 0], second[first >= 0], first[first >= 0]
        _, code, count = np.unique(first * base + second, return_inverse=True, return_counts=True)
        again = count[code] > 1
        at, code, base, m = at[again], code[again], len(count), 2 * m
    place, lag = np.concatenate(places), np.concatenate(lags)
    order = np.lexsort((lag, place))
    return place[order], lag[order]


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbered words, by start, then period."""
    runs: list[tuple[int, int, int]] = []
    active: dict[int, int] = {}  # the match lengths, up to word ``last``, of its lags
    last = -1

    def end() -> None:
        for d, matched in active.items():
            if matched + d >= max(LEAST, TURNS * d):
                runs.append((last + 1 - matched - d, matched + d, d))

    places, lags = earlier(words)
    for i, here in groupby(zip(places.tolist(), lags.tolist(), strict=True), itemgetter(0)):
        if i > last + 1:
            end()
            active = {}
        # a lag that begins has matched over the words that make its occurrence count
        now = {d: active.pop(d, max(GRAM, 1 << (d - 1).bit_length()) - 1) + 1 for _, d in here}
        end()
        active, last = now, i
    end()
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: np.ndarray, known: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The text without words that any run contains after its first period, one space between words."""
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([known[i] for i in words[np.cumsum(depth)[:-1] == 0]]).decode("utf-8")


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_words, runs (start, length and period, by start, then period; words count from 0) and collapsed,
    the text in which each run is cut to its first period.

    Words are `[^\\x20\\x09-\\x0D]+` as they stand. Null and empty texts have no words, no runs and an empty collapsed text.
    Runs may overlap; a word goes if any run has it after its first period. Rows are independent of each other: repeated rows
    give repeated results, null keys stay, other columns are not read. Nothing is shuffled; a task holds one slice of
    texts, and of a long text its words as numbers.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            counts, found, texts = [], [], []
            for t in b.column("t").to_pylist():
                words, known = numbered(t)
                runs = find_runs(words) if len(words) >= LEAST else []
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(collapsed(words, known, runs))
            run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.string())], [key, "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words long, runs {RUNS}, collapsed string")
