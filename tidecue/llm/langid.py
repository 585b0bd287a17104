"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled texts on Spark (a sum per language and bucket);
the log-probability matrix, of ``max_languages`` x ``buckets`` entries at most, is broadcast. Scoring maps
over partitions without a shuffle: a batch of texts becomes sparse (text, bucket, count) triples, and one
gather and one segmented sum give the log likelihood of each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.llm.common import bounded_sample, slices

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Characters turned into n-grams at once; longer texts are counted in steps.
STEP = 1 << 16
#: Entries of the log-probability matrix that are gathered at once: one text has as many rows as buckets at most.
CELLS = 1 << 23
LETTER = regex.compile(r"\p{L}")
_SALT = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def ngram_counts(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1- to 3-grams of a lower-cased whole text, with their counts."""
    total = np.zeros(buckets, np.int64)
    for i in range(0, max(len(text), 1), STEP):
        # the next step starts with the characters after this one; n-grams across the cut come from the overlap
        part = text[i : i + STEP + len(ORDERS) - 1].lower().encode("utf-32-le", "replace")
        c = np.frombuffer(part, np.uint32).astype(np.uint64)
        own = min(STEP, len(c))
        for n in ORDERS:
            m = min(own, len(c) - n + 1)
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ c[k : k + m]) * np.uint64(_SALT[k])
                h ^= h >> np.uint64(29)
            total += np.bincount((h % np.uint64(buckets)).astype(np.int64), minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass(frozen=True)
class LanguageModel:
    """Learned languages and, for each, log prior and log probabilities of the buckets."""

    languages: tuple[str, ...]
    prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; ``und`` and 0 for a text that is null or has no letter."""
        named = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        if not named:
            return best, score
        sums = np.zeros((len(named), len(self.languages)))
        pending: list[tuple[np.ndarray, np.ndarray]] = []
        room, done = CELLS // len(self.languages), 0

        def flush() -> None:
            nonlocal pending, done
            rows = np.cumsum([0, *(len(at) for at, _ in pending)])[:-1]
            at, counts = (np.concatenate([p[k] for p in pending]) for k in (0, 1))
            sums[done : done + len(pending)] = np.add.reduceat(self.log_prob[at] * counts[:, None], rows, axis=0)
            pending, done = [], done + len(pending)

        for i in named:
            sparse = ngram_counts(texts[i], self.log_prob.shape[0])
            if pending and sum(len(at) for at, _ in pending) + len(sparse[0]) > room:
                flush()
            pending.append(sparse)
        flush()
        sums += self.prior
        top = sums.argmax(axis=1)
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        for k, i in enumerate(named):
            best[i], score[i] = self.languages[top[k]], 1 / odds[k].sum()
        return best, score


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 20_000, max_languages: int = 512, smoothing: float = 0.05) -> LanguageModel:
    """Learn from the labelled rows; rows without text or language are left out.

    ``max_rows`` bounds the sample that is learned from (chosen by a hash of the key). More than
    ``max_languages`` labels are an error, since the matrix is broadcast.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sample = bounded_sample(known.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")), "k", max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for b in slices(batches, "t"):
            for t, label in zip(b.column("t").to_pylist(), b.column("l").to_pylist(), strict=True):
                at, counts = ngram_counts(t)
                np.add.at(sums.setdefault(label, np.zeros(BUCKETS, np.int64)), at, counts)
                docs[label] = docs.get(label, 0) + 1
        for label, total in sums.items():
            at = np.flatnonzero(total)
            where, what = np.append(at, -1), np.append(total[at], docs[label])  # bucket -1: texts
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(where)), pa.array(where, pa.int32()), pa.array(what, pa.int64())], ["l", "bucket", "n"])

    counted = sample.select("t", "l").mapInArrow(run, "l string, bucket int, n long").groupBy("l", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.limit(max_languages * (BUCKETS + 1) + 1).toPandas()
    languages = tuple(sorted(rows["l"].unique())) if len(rows) else ()
    if len(languages) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    matrix, prior = np.full((BUCKETS, len(languages)), smoothing), np.zeros(len(languages))
    for i, label in enumerate(languages):
        own = rows[rows["l"] == label]
        texts = own["bucket"] == -1
        prior[i] = own.loc[texts, "n"].sum()
        matrix[own.loc[~texts, "bucket"], i] += own.loc[~texts, "n"]
    return LanguageModel(languages, np.log(prior / max(prior.sum(), 1)), np.log(matrix / matrix.sum(axis=0)))


def predict(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, lang_pred and score of every row, from the whole text alone.

    Null or letterless texts give ``und`` with score 0; repeated rows give repeated results; other columns
    are not read. Equal likelihoods go to the language that sorts first.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, text):
            best, score = m.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(best, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double")


def label(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """All columns of every row, with lang_pred and lang_score from the whole text; see ``predict``."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, text):
            best, score = m.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best, pa.string()), pa.array(score)], [*b.schema.names, "lang_pred", "lang_score"])

    kept = df.drop("lang_pred", "lang_score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, lang_pred string, lang_score double")
