"""Byte-level BPE: whole texts to token ids and back.

Method: a word is a row of parts, with an array beside it that holds for each boundary between two parts
the rank of their merge. The array is scanned for its minimum, that boundary is deleted and the two
neighbouring ranks are refreshed, until no adjacent parts can be merged. Words are short, so a scan of a contiguous
array beats a heap; a word longer than ``LONG_WORD`` bytes takes a heap with the same result.

Rows are independent: a map over partitions, without a shuffle. A worker holds the vocabulary (1.5 MB on
disk) and a bounded cache of words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidecue.llm.common import slices

LONG_WORD = 256
#: Words kept in a worker's cache; beyond it the cache starts anew.
CACHE_WORDS = 200_000
#: The split of byte-level BPE into words, a fixed value of the format. White space is Unicode's
#: White_Space property, which leaves out U+001C to U+001F.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Texts of these characters alone are split by the same rule with plain ranges, which is faster.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_PLAIN_TEXT = re.compile(rf"[\x00-\x7f{_LATIN}]*")
_PLAIN_SPLIT = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^ \t-\r{_LATIN}0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, mapped to the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces:
    """Byte strings that stand for ids, to be joined for a whole array of ids in one gather."""

    def __init__(self, pieces: list[bytes]):
        self.starts = np.cumsum([0, *map(len, pieces)])
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        out = []
        for i in range(0, len(ids), 1 << 18):  # long texts in steps, for bounded memory
            starts = self.starts[ids[i : i + (1 << 18)]]
            sizes = self.starts[ids[i : i + (1 << 18)] + 1] - starts
            ends = np.cumsum(sizes)
            out.append(self.flat[np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)].tobytes())
        return b"".join(out)


class Vocabulary:
    """A vocabulary file in the JSON form of byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = byte_symbols()
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        merges = [(ids[x], ids[y], ids[x + y]) for a, b in pairs for x, y in [(as_bytes(a), as_bytes(b))]]
        self.single = [ids[bytes([b])] for b in range(256)]
        # merges are kept by ids alone: every worker holds them
        self.pairs = {a << 32 | b: rank for rank, (a, b, _) in enumerate(merges)}
        self.merged = [c for _, _, c in merges]
        texts = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        n = max(texts) + 1
        self.texts = Pieces([texts.get(i, b"") for i in range(n)])
        self.decimals = Pieces([b"%d," % i for i in range(n)])
        self.split = regex.compile(SPLIT)
        specials = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word."""
        if len(word) > LONG_WORD:
            return self._encode_long(word)
        ranks, merged, none = self.pairs, self.merged, len(self.merged)
        part = [self.single[b] for b in word]
        near = [ranks.get(a << 32 | b, none) for a, b in zip(part, part[1:], strict=False)]
        while near:
            least = min(near)
            if least == none:
                break
            i = near.index(least)
            part[i] = merged[least]
            del part[i + 1], near[i]
            if i < len(near):
                near[i] = ranks.get(part[i] << 32 | part[i + 1], none)
            if i:
                near[i - 1] = ranks.get(part[i - 1] << 32 | part[i], none)
        return part

    def _encode_long(self, word: bytes) -> list[int]:
        """The same merges for a long word: lowest rank first, then leftmost, from a heap."""
        n = len(word)
        part = [self.single[b] for b in word]
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = self.pairs.get(part[i] << 32 | part[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, end[i], end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, mid, stop = heapq.heappop(heap)
            if end[i] != mid or mid >= n or end[mid] != stop:
                continue
            part[i], end[i], after[i], end[mid] = self.merged[rank], stop, stop, -1
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        ids, i = [], 0
        while i < n:
            ids.append(part[i])
            i = end[i]
        return ids

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens stand alone."""
        if self.cut is None or not self.cut.search(text):
            return (_PLAIN_SPLIT if _PLAIN_TEXT.fullmatch(text) else self.split).findall(text)
        found: list[str] = []
        for part in self.cut.split(text):
            found += [part] if part in self.special else self.split.findall(part)
        return found

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(_cache(self).__getitem__, self.words(text or ""))), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.texts.joined(np.asarray(ids, np.int64)).decode("utf-8", "replace")

    def digest(self, ids: np.ndarray) -> str:
        """SHA-256 of the decimal ids joined by commas."""
        return hashlib.sha256(self.decimals.joined(ids)[:-1]).hexdigest()


class Words(dict):
    """The encoded form of each word met, as int32 bytes; bounded."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> bytes:
        v = self.vocabulary
        ids = [v.special[word]] if word in v.special else v.encode_word(word.encode("utf-8", "replace"))
        out = np.array(ids, np.int32).tobytes()
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each worker process and file."""
    return Vocabulary(path)


def _cache(v: Vocabulary) -> Words:
    if not hasattr(v, "cache"):
        v.cache = Words(v)
    return v.cache


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the token ids of a text column as ``array<int>``; other columns stay.

    Null and empty texts give an empty array. Whole texts are encoded, whatever their length.
    """
    columns = [c for c in df.columns if c != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out), f"`{out}` array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches, text):
            ids = [v.encode(t) for t in b.column(text).to_pylist()]
            offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), lists], [*columns, out])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the text of a column of token ids; null ids give an empty text, special tokens are kept."""
    columns = [c for c in df.columns if c != out]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches, ids):
            texts = [v.decode(np.array(x or [], np.int64)) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(texts, pa.string())], [*columns, out])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode the ids again, and return a digest of each.

    Columns: the key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the
    decoded text in UTF-8). Ids and texts stay inside the task, so that only digests leave it. Null and empty texts
    have no tokens and the digests of empty strings; repeated rows give repeated results; other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches, text):
            counts, id_digests, text_digests = [], [], []
            for t in b.column(text).to_pylist():
                ids = v.encode(t)
                counts.append(len(ids))
                id_digests.append(v.digest(ids))
                text_digests.append(hashlib.sha256(v.decode(ids).encode()).hexdigest())
            columns = [b.column(key), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()), pa.array(text_digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
