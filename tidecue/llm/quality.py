"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are computed where the text lies. A bounded sample of labelled rows is fitted in numpy; the
trees, flattened into arrays of features, thresholds, children and values, are broadcast, and a batch of
rows walks all of them level by level.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.llm.common import bounded_sample, slices

FEATURES = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "letters", "upper", "digits", "white", "high",
    "stops", "commas", "pipes", "symbols", "distinct_words", "top_word", "distinct_lines", "line_words",
    "short_lines", "ended_lines", "long_words", "symbol_words", "repeats", "short_words", "ellipses", "braces",
)
_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digits": range(48, 58), "white": [9, 10, 11, 12, 13, 32], "high": range(128, 256), "stops": b".!?", "commas": b",;:", "pipes": b"|", "symbols": b"#$%&*+/<=>@\\^_~", "braces": b"()[]{}"}
_SYMBOL = re.compile(r"[#$%&*+/<=>@\\^_~|]")


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES; an empty or null text has zeros."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = text.split()
    if not words:
        return [float(np.log1p(len(data))), *[0.0] * (len(FEATURES) - 1)]
    # bincount makes 8 bytes of each byte: long texts are counted in steps
    counts = sum(np.bincount(np.frombuffer(data[i : i + (1 << 20)], np.uint8), minlength=256) for i in range(0, len(data), 1 << 20))
    size, n = len(data), len(words)
    share = {k: float(counts[list(v)].sum()) / size for k, v in _CLASSES.items()}
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(size)), float(np.log1p(n)), float(np.log1p(len(lines))), float(sizes.sum()) / n,
        share["upper"] + share["lower"] + share["high"], share["upper"], share["digits"], share["white"], share["high"],
        share["stops"], share["commas"], share["pipes"], share["symbols"], len(seen) / n, max(seen.values()) / n,
        len(set(lines)) / len(lines), n / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), float((sizes > 12).sum()) / n,
        sum(1 for w in seen if _SYMBOL.search(w)) / len(seen), sum(map(eq, words, words[1:])) / n,
        float((sizes <= 2).sum()) / n, text.count("...") / n, share["braces"],
    ]


@dataclass(frozen=True)
class Forest:
    """Trees as arrays, one row for each tree; a leaf is its own child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the leaf values that each row reaches."""
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            down = x[rows, self.feature[trees, at]] <= self.threshold[trees, at]
            at = np.where(down, self.left[trees, at], self.right[trees, at])
        return self.base + self.value[trees, at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 1.0) -> Forest:
    """Boost trees on the logistic loss; split candidates are quantile bins.

    Without rows, or with one class only, the forest is a constant.
    """
    nodes = 2 ** (depth + 1) - 1
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(y) < 2 * least or y.min() == y.max():
        trees = 0
    shape = (trees, nodes)
    feature, threshold, value = np.zeros(shape, np.int64), np.full(shape, np.inf), np.zeros(shape)
    left, right = np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1))
    if not trees:
        return Forest(feature, threshold, left, right, value, depth, base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    width = bins + 1
    flat = binned + np.arange(x.shape[1]) * width
    margin = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            for k in range(2**level - 1, 2 ** (level + 1) - 1):
                own = np.flatnonzero(node == k)
                if len(own) < 2 * least:
                    continue
                at = flat[own].ravel()
                hist = [np.bincount(at, np.repeat(v, x.shape[1]), x.shape[1] * width).reshape(-1, width).cumsum(axis=1) for v in (grad[own], hess[own], np.ones(len(own)))]
                (g, h, n), (gs, hs, ns) = hist, (a[:, -1:] for a in hist)
                gain = g**2 / (h + l2) + (gs - g) ** 2 / (hs - h + l2) - gs**2 / (hs + l2)
                gain[(n < least) | (ns - n < least)] = -1
                f, b = divmod(int(gain.argmax()), width)
                if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                    continue
                feature[t, k], threshold[t, k], left[t, k], right[t, k] = f, edges[f][b], 2 * k + 1, 2 * k + 2
                node[own] = np.where(binned[own, f] <= b, 2 * k + 1, 2 * k + 2)
        g, h = (np.bincount(node, v, nodes) for v in (grad, hess))
        value[t] = -rate * g / (h + l2)
        margin += value[t][node]
    return Forest(feature, threshold, left, right, value, depth, base)


def _with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            rows = [statistics(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], [*keep, "statistics"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*{*keep, text}).mapInArrow(run, f"{kinds}, statistics array<double>")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_rows: int = 20_000, **growth) -> Forest:
    """Learn from documents that have a label; null labels are left out.

    ``max_rows`` bounds the sample (chosen by a hash of the key), so what comes to the driver is bounded.
    """
    known = bounded_sample(labels.where(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")), "k", max_rows)
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k")  # max_rows at most
    rows = _with_statistics(joined, "t", ["k", "y"]).toPandas().sort_values("k", kind="stable")
    x = np.array(rows["statistics"].tolist(), float).reshape(len(rows), len(FEATURES))
    return grow(x, rows["y"].to_numpy(float), **growth)


def score(df: DataFrame, forest: Forest, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score (0 to 1) and predicted (1 at the threshold or above) of every row, from its whole text.

    Null and empty texts are scored like a text of no words; repeated rows give repeated results.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(forest)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in slices(batches, text):
            x = np.array([statistics(t) for t in b.column(text).to_pylist()], float).reshape(-1, len(FEATURES))
            s = f.score(x)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
