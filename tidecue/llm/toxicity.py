"""Toxicity: a convolutional text classifier with thresholds calibrated by language.

Words become hashed embeddings; filters of several widths slide over the whole text, the maximum of each
over all positions feeds a logistic output. A bounded sample of labelled rows is trained in numpy; the
weights (about 2 MB) are broadcast. All other labelled rows are scored where they lie and counted by the
language that the language model finds, step of the logit and label; from these bounded counts each language
gets the threshold with the best F1. Scores are moved on the logit scale so that every language's threshold
lies at 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.llm.common import counted, in_sample, slices
from tidecue.llm.langid import LanguageModel
from tidecue.llm.words import MARKS, word_hashes

ROWS = 1 << 14
#: Bytes at the start of a word that are hashed beside the whole word, so that inflected forms share a part.
HEAD = 5
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Words convolved at once; a longer text is taken in overlapping steps, which leaves the maxima as they are.
STEP = 1 << 14
#: Steps of the logit, up to LIMIT on either side, by which calibration rows are counted.
RESOLUTION, LIMIT = 20, 30
#: Labelled rows that may be broadcast to find their texts; beyond it, a shuffle join finds them.
BROADCAST_ROWS = 1_000_000


def word_rows(texts: list[str | None]) -> list[np.ndarray]:
    """For each text the two embedding rows of each of its words: of the word and of its first letters."""
    hashes, heads, offsets = word_hashes(texts, MARKS, HEAD)
    rows = np.stack([hashes % np.uint64(ROWS), heads % np.uint64(ROWS) + np.uint64(ROWS)], axis=1).astype(np.int32)
    return [rows[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


@dataclass
class Network:
    embedding: np.ndarray  # ROWS for words, then ROWS for their first letters
    filters: list[np.ndarray]  # width * SIZE x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float
    offsets: dict[str, float] = field(default_factory=dict)  # logit of each language's threshold
    default: float = 0.0

    @staticmethod
    def fresh(seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        f = [r.normal(0, 1 / np.sqrt(w * SIZE), (w * SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Network(r.normal(0, 0.1, (2 * ROWS, SIZE)).astype(np.float32), f, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0)

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        return self.embedding[rows[..., 0]] + self.embedding[rows[..., 1]]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over the text and where it was; 0 and -1 where a filter is negative or does not fit."""
        best, where = np.zeros(FILTERS * len(WIDTHS), np.float32), np.full(FILTERS * len(WIDTHS), -1)
        for i in range(0, len(rows), STEP):
            e = self.embedded(rows[i : i + STEP + max(WIDTHS) - 1])
            for k, w in enumerate(WIDTHS):
                n = min(len(e) - w + 1, STEP)
                if n <= 0:
                    continue
                a = np.repeat(self.bias[k][None], n, axis=0)
                for j in range(w):
                    a += e[j : j + n] @ self.filters[k][j * SIZE : (j + 1) * SIZE]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                at = a.argmax(axis=0)
                top = a[at, np.arange(FILTERS)]
                better = top > best[own]
                best[own] = np.where(better, top, best[own])
                where[own] = np.where(better, at + i, where[own])
        return best, where

    def pooled_together(self, texts: list[np.ndarray], places: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``pooled`` of several texts, one row each; short ones share matrix products of up to STEP words."""
        best, where = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32), np.full((len(texts), FILTERS * len(WIDTHS)), -1)
        group: list[int] = []
        size = 0
        for i, r in enumerate([*texts, None]):
            if group and (r is None or size + len(r) > STEP):
                best[group], where[group] = self._pooled_group([texts[k] for k in group], places)
                group, size = [], 0
            if r is not None and len(r) > STEP:
                best[i], where[i] = self.pooled(r)
            elif r is not None and len(r):
                group.append(i)
                size += len(r)
        return best, where

    def _pooled_group(self, texts: list[np.ndarray], places: bool) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths) - lengths
        e = np.ascontiguousarray(self.embedded(np.concatenate(texts)).T)  # a filter's values lie together
        size = e.shape[1]
        left = np.repeat(starts + lengths, lengths) - np.arange(size)  # words from here to the text's end
        best, where = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32), np.full((len(texts), FILTERS * len(WIDTHS)), -1)
        for k, w in enumerate(WIDTHS):
            n = size - w + 1
            if n <= 0:
                continue
            a = np.full((FILTERS, size), -np.inf, np.float32)
            a[:, :n] = self.filters[k][:SIZE].T @ e[:, :n] + self.bias[k][:, None]
            for j in range(1, w):
                a[:, :n] += self.filters[k][j * SIZE : (j + 1) * SIZE].T @ e[:, j : j + n]
            a[:, left < w] = -np.inf
            top = np.maximum.reduceat(a, starts, axis=1)
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            best[:, own] = np.maximum(top, 0).T
            if places:
                f, at = np.nonzero(a == np.repeat(np.where(top > 0, top, np.inf), lengths, axis=1))
                t = np.searchsorted(starts, at, side="right") - 1
                where[t[::-1], k * FILTERS + f[::-1]] = (at - starts[t])[::-1]  # the first place is written last
        return best, where

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        return (self.pooled_together(texts)[0] @ self.out + self.shift).astype(float)

    def scores(self, texts: list[str | None], languages: list[str]) -> np.ndarray:
        z = self.logits(word_rows(texts)) - np.array([self.offsets.get(x, self.default) for x in languages], float).reshape(len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int = 4, rate: float = 0.1, batch: int = 32, seed: int = 11) -> Network:
    """Adagrad on the logistic loss over all rows; classes weigh the same. The gradient of a maximum goes to its position."""
    net = Network.fresh(seed)
    if not len(y) or y.min() == y.max():
        net.shift = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return net
    r = np.random.default_rng(seed)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).clip(max=5)
    net.out = r.normal(0, 0.1, len(net.out)).astype(np.float32)
    past = {"e": np.full(net.embedding.shape, 1e-4, np.float32), "o": np.full(net.out.shape, 1e-4, np.float32), "s": 1e-4}
    past_f, past_b = [np.full(f.shape, 1e-4, np.float32) for f in net.filters], [np.full(b.shape, 1e-4, np.float32) for b in net.bias]
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            best, where = net.pooled_together([texts[d] for d in own], places=True)
            z = np.clip(best @ net.out + net.shift, -30, 30)
            g = ((1 / (1 + np.exp(-z)) - y[own]) * weight[own] / batch).astype(np.float32)
            back = g[:, None] * net.out
            at_rows, at_grads = [], []
            for k, w in enumerate(WIDTHS):
                t, q = np.nonzero(where[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
                if not len(t):
                    continue
                place, b = where[t, k * FILTERS + q], back[t, k * FILTERS + q]
                rows = np.stack([texts[own[d]][p : p + w] for d, p in zip(t.tolist(), place.tolist(), strict=True)])  # hit, word, row
                g_f, g_b = np.zeros((FILTERS, w * SIZE), np.float32), np.zeros(FILTERS, np.float32)
                np.add.at(g_f, q, b[:, None] * net.embedded(rows).reshape(len(t), -1))
                np.add.at(g_b, q, b)
                at_rows.append(rows.reshape(-1, rows.shape[-1]))
                at_grads.append((b[:, None] * net.filters[k][:, q].T).reshape(-1, SIZE))
                past_f[k] += g_f.T**2
                past_b[k] += g_b**2
                net.filters[k] -= rate * g_f.T / np.sqrt(past_f[k])
                net.bias[k] -= rate * g_b / np.sqrt(past_b[k])
            if at_rows:
                rows, grads = np.concatenate(at_rows), np.concatenate(at_grads)
                used, inverse = np.unique(rows, return_inverse=True)
                g_e = np.zeros((len(used), SIZE), np.float32)
                for part in inverse.reshape(rows.shape).T:
                    np.add.at(g_e, part, grads)
                past["e"][used] += g_e**2
                net.embedding[used] -= rate * g_e / np.sqrt(past["e"][used])
            g_out, g_shift = g @ best, float(g.sum())
            past["o"] += g_out**2
            net.out -= rate * g_out / np.sqrt(past["o"])
            past["s"] += g_shift**2
            net.shift -= rate * g_shift / float(np.sqrt(past["s"]))
    return net


def best_threshold(logits: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> float:
    """The logit of the cut with the best F1, in the middle of the gap there; 0 if a class is missing.

    ``positive`` and ``negative`` count the rows at each logit.
    """
    if not positive.sum() or not negative.sum():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    z, hits, found = logits[order], np.cumsum(positive[order]), np.cumsum((positive + negative)[order])
    i = int((2 * hits / (found + positive.sum())).argmax())
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i] - 1)


def fit(docs: DataFrame, labels: DataFrame, languages: LanguageModel, label: str = "toxic", key: str = "doc_id", text: str = "text", max_rows: int = 16_000, max_bytes: int = 1 << 26, least: int = 20) -> Network:
    """Learn from documents that have a label: three quarters of a bounded sample are trained on, all other rows calibrate.

    ``max_rows`` bounds the sample (chosen by a hash of the key) and ``max_bytes`` its texts, which are sent to
    the driver as word numbers; a text of more than a 64th of ``max_bytes`` only calibrates. A language with
    fewer than ``least`` calibration rows of either class takes the threshold of all languages together.
    """
    c = F.col
    spark = docs.sparkSession
    known = labels.where(c(label).isNotNull() & c(key).isNotNull()).select(c(key).alias("k"), c(label).cast("int").alias("y"))
    n, size = known.count(), F.coalesce(F.octet_length("t"), F.lit(0))
    joined = docs.select(c(key).alias("k"), c(text).alias("t")).join(counted(known, BROADCAST_ROWS), "k")
    chosen = lambda most: in_sample("k", n, most) & (F.pmod(F.xxhash64("k", F.lit(23)), F.lit(4)) != 3) & (size <= max_bytes // 64)
    first = joined.where(chosen(max_rows)).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    most = max_rows if first <= max_bytes else int(min(n, max_rows) * max_bytes / first)
    shared = spark.sparkContext.broadcast(languages)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            rows = [x.tobytes() for x in word_rows(b.column("t").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array(rows, pa.binary())], ["k", "y", "w"])

    kind = docs.schema[key].dataType.simpleString()
    rows = joined.where(chosen(most)).mapInArrow(numbers, f"k {kind}, y int, w binary").toPandas().sort_values(["k", "w"], kind="stable")
    net = train([np.frombuffer(w, np.int32).reshape(-1, 2) for w in rows["w"]], rows["y"].to_numpy(float))
    trained = spark.sparkContext.broadcast(net)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            texts = b.column("t").to_pylist()
            z = np.clip(trained.value.logits(word_rows(texts)), -LIMIT, LIMIT)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.predict(texts)[0], pa.string()), pa.array(np.rint(z * RESOLUTION).astype(np.int32)), b.column("y")], ["l", "z", "y"])

    calibrating = joined.where(~chosen(most)).mapInArrow(steps, "l string, z int, y int")
    counts = calibrating.groupBy("l", "z").agg(F.count_if(c("y") == 1).alias("p"), F.count_if(c("y") == 0).alias("n")).toPandas()  # languages x steps at most
    pooled = counts.groupby("z", as_index=False)[["p", "n"]].sum()
    net.default = best_threshold(pooled["z"].to_numpy(float) / RESOLUTION, pooled["p"].to_numpy(), pooled["n"].to_numpy())
    for name, own in counts.groupby("l"):
        if min(own["p"].sum(), own["n"].sum()) >= least:
            net.offsets[name] = best_threshold(own["z"].to_numpy(float) / RESOLUTION, own["p"].to_numpy(), own["n"].to_numpy())
    return net


def score(df: DataFrame, net: Network, languages: LanguageModel, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, score (0 to 1) and predicted (1 at the threshold or above) of every row, from its whole text.

    Null and empty texts are scored as texts without words; repeated rows give repeated results.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((net, languages))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, m = shared.value
        for b in slices(batches, text):
            texts = b.column(text).to_pylist()
            s = n.scores(texts, m.predict(texts)[0])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [key, "score", "predicted"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
