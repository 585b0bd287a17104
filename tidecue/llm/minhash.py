"""Near-duplicate documents from bottom-k sketches of one hash function.

A document is its set of distinct 5-word shingles; two are linked if their Jaccard similarity is at least
0.75. What is kept of a set is the ``K`` smallest of its shingles' 64-bit hashes.

1. Documents with equal sets form a class and are represented by the smallest id.
2. The smallest ``LISTED`` retained values of each representative go into inverted lists. Values that no
   other document retains are dropped; of the others, ordered by how many documents retain them, the rarest
   are listed, just so many that two similar documents share a listed value: a pair of similarity 0.75 has
   at least ``required`` values in common, except with a chance of ``MISS``.
3. In each list all documents meet the one with the fewest unshared values. That is linear in the list, and
   links most of a group of copies. What is connected by now need not be compared again.
4. Only pairs from different components remain. Short lists join with themselves. Long ones are cut into cells
   by set size, so that only neighbouring cells can hold similar sets, and by whether a document lies in the
   list's largest component, within which nothing is compared; cells are cut into chunks of bounded size, and
   pairs of chunks are compared as products of incidence matrices, over wider sketches of ``WIDE`` values that are made
   of these documents only. A pair leaves a block only if it passes the filter and no smaller value of both lists it too; a list whose documents all share the same smaller value, as
   the values of one passage do, is left out for that reason.
5. The filter estimates the similarity from the union's sketch: of its ``K`` smallest values as many must
   be in both sets as a similar pair has except with a chance of ``MISS``.
6. Links are confirmed on full sets: on the sketches where these hold the whole sets of both documents, and on the
   texts elsewhere. Such pairs are gathered by the end that has more of them, in chunks of bounded
   size: its text comes once for each chunk, and partners stream past its set. Components are computed by Spark.

The shingle hash is 64 bits wide: sets of n shingles are confused with a chance of about n**2 / 2**64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import exp, lgamma, log
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.llm.common import counted, few, settle, slices, tidy
from tidecue.llm.components import connected_components
from tidecue.llm.words import shingles, word_hashes

if TYPE_CHECKING:
    import pandas as pd  # workers of Arrow maps do without it

K = 128
#: Values kept of documents in long lists, whose pairs are many: most of their sets are held whole.
WIDE = 512
LISTED = 64
WIDTH = 5
PERCENT = 75
MISS = 1e-9
#: Lists up to this length join with themselves; longer ones are compared in blocks.
SHORT_LIST = 64
BLOCK = 2048
#: Partners that are compared with a document's set in one chunk.
CHUNK = 256
#: Document ids that may be broadcast to fetch sketches or texts; beyond it, a shuffle join fetches them.
BROADCAST_IDS = 1_000_000


@lru_cache
def required(k: int, percent: int = PERCENT, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """How many of the k smallest values of a union of u values are in both sets, if the similarity reaches
    the threshold: given as sizes u in ascending order and a count for each; for other sizes the count of the
    next larger size holds, for larger sizes the last.
    """
    log_choose = lambda n, r: lgamma(n + 1) - lgamma(r + 1) - lgamma(n - r + 1)
    sizes = [*range(k + 1), *range(k + 1, 4 * k, 4), *(4 * k * 2**i for i in range(24))]
    counts = []
    for u in sizes:
        common = -(-u * percent // 100)
        if u <= k:
            counts.append(common)
            continue
        total, x = 0.0, max(0, k - (u - common))
        while x < k:
            total += exp(log_choose(common, x) + log_choose(u - common, k - x) - log_choose(u, k))
            if total > miss:
                break
            x += 1
        counts.append(x)
    return np.array(sizes), np.array(counts)


def needed(low: np.ndarray, high: np.ndarray, k: int, percent: int = PERCENT) -> np.ndarray:
    """The smallest required count of any union size from low to high."""
    sizes, counts = required(k, percent)
    look = lambda u: counts[np.minimum(np.searchsorted(sizes, u), len(sizes) - 1)]
    return np.minimum(look(low), look(high))


def sketch_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = K) -> DataFrame:
    """doc, n (set size), d1 and d2 (digest of the set), sketch, and how many listed values a partner shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            hashes, _, offsets = word_hashes(b.column("t").to_pylist())
            sets = shingles(hashes, offsets, WIDTH)
            n = np.array([len(s) for s in sets], np.int64)
            digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
            kept = [s[:k].view(np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, kept)]).astype(np.int32)), pa.array(np.concatenate([*kept, np.zeros(0, np.int64)])))
            share = needed(n, n * 100 // percent, LISTED, percent)
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(share.astype(np.int32)), lists], ["doc", "n", "d1", "d2", "share", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"doc {kind}, n long, d1 long, d2 long, share int, sketch array<long>")


def inverted_lists(representatives: DataFrame) -> DataFrame:
    """(value, doc, n, noise, mask): listed values; mask has the bits of a document's listed sketch places."""
    places = representatives.select("doc", "n", "share", F.posexplode(F.slice("sketch", 1, LISTED)).alias("at", "value"))
    common = places.groupBy("value").count().where("count > 1")
    shared = places.join(common, "value").groupBy("doc", "n", "share").agg(F.array_sort(F.collect_list(F.struct("count", "value", "at"))).alias("s"))
    length = F.greatest(F.size("s") - F.col("share") + 1, F.lit(0))
    listed = shared.select("doc", "n", (F.least("n", F.lit(LISTED)) - F.size("s")).cast("int").alias("noise"), F.slice("s", F.lit(1), length).alias("s"))
    mask = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["at"])))
    return listed.select("doc", "n", "noise", mask.alias("mask"), F.explode("s").alias("x")).select(F.col("x.value").alias("value"), "doc", "n", "noise", "mask")


def judge(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int = PERCENT, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Whether pairs of sketches (rows, padded with the largest number) may reach the threshold, and whether that is sure.

    It is where both sketches hold their whole sets; elsewhere the sketch of the union decides.
    """
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != np.uint64(2**64 - 1))
    rank = np.cumsum(~twice, axis=1)
    found = (twice & (rank <= k)).sum(axis=1)
    likely = found >= needed(np.maximum(na, nb), (na + nb) * 100 // (100 + percent), k, percent)
    common, sure = twice.sum(axis=1), (na <= k) & (nb <= k)
    return np.where(sure, 100 * common >= percent * (na + nb - common), likely), sure


def _padded(column: list | pd.Series, k: int = K) -> np.ndarray:
    out = np.full((len(column), k), 2**64 - 1, np.uint64)
    for row, x in zip(out, column, strict=True):
        v = np.asarray(x, np.int64).view(np.uint64)
        row[: len(v)] = v
    return out


def _overlaps(values: np.ndarray, at_row: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Common values of every row of the left and every row of the right, of n rows; values with the row of each, no value twice in a row."""
    order = np.argsort(values, kind="stable")
    v, rows = values[order], at_row[order]
    first = np.diff(v, prepend=~v[:1]) != 0
    code = np.cumsum(first) - 1
    kept = np.bincount(code, minlength=1)[code] > 1  # values of one row are in no overlap
    rows, code = rows[kept], np.cumsum(first[kept]) - 1
    total = np.zeros((len(left), len(right)), np.float32)
    for i in range(0, code[-1] + 1 if len(code) else 0, 1024):
        part = slice(*np.searchsorted(code, [i, i + 1024]))
        m = np.zeros((n, code[part.stop - 1] - i + 1), np.float32)
        m[rows[part], code[part] - i] = 1
        total += m[left] @ m[right].T
    return total


def block_pairs(g: pd.DataFrame, percent: int = PERCENT) -> pd.DataFrame:
    """Pairs of a block of one list that pass the filter, lie in different components and are not found by a
    smaller listed value: of rows of side 0 with rows of side 1, or of all rows where a chunk meets itself.
    """
    g = g.sort_values("doc", kind="stable")
    value = np.int64(g["value"].iloc[0]).view(np.uint64)
    sketch, n = _padded(g["sketch"], WIDE), g["n"].to_numpy()
    doc, component, side = g["doc"].to_numpy(), g["component"].to_numpy(), g["side"].to_numpy()
    diagonal = g["same"].iloc[0]
    left, right = (np.arange(len(g)), np.arange(len(g))) if diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    at_row, at_place = np.nonzero(sketch != np.uint64(2**64 - 1))
    values = sketch[at_row, at_place]
    listed = (at_place < 64) & ((g["mask"].to_numpy().view(np.uint64)[at_row] >> (at_place % 64).astype(np.uint64)) & np.uint64(1)).astype(bool)

    low, high = np.maximum(n[left][:, None], n[right][None]), (n[left][:, None] + n[right][None]) * 100 // (100 + percent)
    ok = (low <= high) & (component[left][:, None] != component[right][None])
    ok &= (doc[left][:, None] < doc[right][None]) if diagonal else True
    if ok.any():
        ok &= _overlaps(values, at_row, left, right, len(g)) >= needed(low, high, WIDE, percent)
    if ok.any():
        before = listed & (values < value)
        ok &= _overlaps(values[before], at_row[before], left, right, len(g)) == 0
    x, y = np.nonzero(ok)
    x, y = left[x], right[y]
    judged = [judge(sketch[x[i : i + 1024]], sketch[y[i : i + 1024]], n[x[i : i + 1024]], n[y[i : i + 1024]], percent, WIDE) for i in range(0, len(x), 1024)]
    good, sure = (np.concatenate([np.zeros(0, bool), *(j[k] for j in judged)]) for k in (0, 1))
    x, y = x[good], y[good]
    from pandas import DataFrame as Rows

    return Rows({"a": np.minimum(doc[x], doc[y]), "b": np.maximum(doc[x], doc[y]), "sure": sure[good]})


def own_lists(members: DataFrame) -> DataFrame:
    """The values of lists (value, doc) that are not contained in the list of a smaller value."""
    c = F.col
    unsigned = c("value").bitwiseXOR(F.lit(-(1 << 63)))  # values count as unsigned numbers
    chains = members.groupBy("doc").agg(F.sort_array(F.collect_list(unsigned)).alias("v"))  # LISTED at most
    steps = chains.select(F.explode(F.transform("v", lambda x, i: F.struct(x.alias("value"), F.get("v", i - 1).alias("before")))).alias("x"))
    steps = steps.groupBy("x.value").agg(F.count("*").alias("n"), F.count("x.before").alias("k"), F.min("x.before").alias("a"), F.max("x.before").alias("b"))
    return steps.where((c("k") < c("n")) | (c("a") != c("b"))).select(unsigned.alias("value"))


def block_rows(mixed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Members (value, doc, n, mask, component) of long lists with each block (value, block, same) they are in, and their side."""
    c = F.col
    counts = mixed.groupBy("value", "component").count()
    main = counts.groupBy("value").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
    # a little wider than the ratio of similar sizes, against rounding: these are never more than one step apart
    step = log(100 / percent) + 1e-9
    rows = mixed.join(main, "value").select("value", "doc", "n", "mask", "component", (c("component") == c("main")).alias("core"), F.floor(F.ln("n") / step).cast("int").alias("size"))
    cell = ["value", "size", "core"]
    cells = rows.groupBy(*cell).count().withColumn("chunks", F.ceil(c("count") / BLOCK).cast("int")).drop("count")
    cells = settle(few(cells, mixed.count()), "cells")
    rows = rows.join(cells, cell).withColumn("chunk", F.pmod(F.xxhash64("doc"), "chunks").cast("int")).drop("chunks")
    chunks = cells.select(*cell, F.explode(F.sequence(F.lit(0), c("chunks") - 1)).alias("chunk"))
    x, y = (chunks.select("value", F.struct("size", "core", "chunk").alias(name)) for name in ("x", "y"))
    apart = c("y.size") - c("x.size")
    pairs = x.join(y, "value").where(((apart == 1) | ((apart == 0) & (c("x") <= c("y")))) & ~(c("x.core") & c("y.core")))
    pairs = pairs.select("value", "x", "y", F.struct("x", "y").alias("block"), (c("x") == c("y")).alias("same"))
    sides = [pairs.where(F.lit(True) if side == 0 else ~c("same")).select("value", f"{end}.*", "block", "same", F.lit(side).alias("side")) for side, end in ((0, "x"), (1, "y"))]
    return rows.join(sides[0].union(sides[1]), [*cell, "chunk"]).select("value", "block", "same", "side", "doc", "n", "mask", "component")


def _fetch(table: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a table whose doc is among distinct ids, without a shuffle of the table if these are few."""
    return table.join(counted(ids, BROADCAST_IDS), "doc", "left_semi")


def _with_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("doc").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]), end)
    return pairs


def passing(pairs: DataFrame, sketches: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by their sketches, and whether that is sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "sketch_a", "sketch_b"):
            good, sure = judge(_padded(b.column("sketch_a").to_pylist()), _padded(b.column("sketch_b").to_pylist()), b.column("n_a").to_numpy(), b.column("n_b").to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sure)], ["a", "b", "sure"]).filter(pa.array(good))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select("a", "b").schema)
    return _with_both(pairs, sketches, ["n", "sketch"]).select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(run, f"{kinds}, sure boolean")


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets, given as sorted distinct numbers, reach the threshold."""
    if min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _gathered(pairs: DataFrame) -> DataFrame:
    """(hub, partner, chunk) of pairs (a, b): the hub is the end that has more pairs."""
    c = F.col
    degree = pairs.select(c("a").alias("doc")).union(pairs.select("b")).groupBy("doc").count()
    degree = settle(few(degree, 2 * pairs.count()), "degrees")
    for end in ("a", "b"):
        pairs = pairs.join(counted(degree, BROADCAST_IDS).select(c("doc").alias(end), c("count").alias(f"n_{end}")), end)
    turned = c("n_a") >= c("n_b")
    partner = F.when(turned, c("b")).otherwise(c("a"))
    chunk = F.pmod(F.xxhash64(partner), F.ceil(F.greatest("n_a", "n_b") / CHUNK))
    return settle(pairs.select(F.when(turned, c("a")).otherwise(c("b")).alias("hub"), partner.alias("doc"), chunk.alias("chunk")), "gathered")


def confirmed(pairs: DataFrame, docs: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold; those that are sure need no look at their texts.

    Rows are dealt by hub and chunk and sorted so that the hub's text comes first; sets are made where texts arrive.
    """
    pairs = settle(pairs.groupBy("a", "b").agg(F.bool_or("sure").alias("sure")), "pairs")
    asked = _gathered(pairs.where("not sure").select("a", "b"))
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("t"))
    partners = texts.join(counted(asked, BROADCAST_IDS), "doc").select("hub", "chunk", F.lit(1).alias("kind"), "doc", "t")
    hubs = asked.select("hub", "chunk").distinct().withColumn("doc", F.col("hub"))
    hubs = texts.join(counted(hubs, BROADCAST_IDS), "doc").select("hub", "chunk", F.lit(0).alias("kind"), "doc", "t")
    rows = hubs.union(partners).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "kind")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, {}  # an id that repeats with other texts has several sets
        for b in slices(batches, "t"):
            hashes, _, offsets = word_hashes(b.column("t").to_pylist())
            good = []
            for hub, chunk, kind, s in zip(b.column("hub").to_pylist(), b.column("chunk").to_pylist(), b.column("kind").to_pylist(), shingles(hashes, offsets, WIDTH), strict=True):
                if (hub, chunk) != at:
                    at, own = (hub, chunk), {}
                if kind == 0:
                    own[hashlib.blake2b(s.tobytes(), digest_size=16).digest()] = s
                good.append(kind == 1 and any(similar(s, x, percent) for x in own.values()))
            yield pa.RecordBatch.from_arrays([b.column("hub"), b.column("doc")], ["hub", "doc"]).filter(pa.array(good, pa.bool_()))

    kind = docs.schema[key].dataType.simpleString()
    found = rows.mapInArrow(check, f"hub {kind}, doc {kind}")
    found = found.select(F.least("hub", "doc").alias("a"), F.greatest("hub", "doc").alias("b"))
    return settle(found.union(pairs.where("sure").select("a", "b")), "links")


@tidy("near-duplicates")
def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: the key, n_shingles, component_id (smallest id reachable by links) and kept.

    Null and empty texts have empty sets and are linked with nothing, as is a row without id, which is kept
    with a null component. Rows that repeat an id and a text give repeated results; an id that repeats with
    other texts stands for all of them.
    """
    c = F.col
    sketches = settle(sketch_documents(docs, key, text, percent), "sketches")
    classes = sketches.where("n > 0 and doc is not null").groupBy("d1", "d2").agg(F.min(F.struct("doc", "n", "share", "sketch")).alias("f"))
    classes = settle(classes.select("d1", "d2", "f.*"), "classes")
    lists = settle(inverted_lists(classes), "lists")
    sketched = settle(_fetch(classes.select("doc", "n", "sketch"), lists.select("doc").distinct()), "listed-sketches")
    similar_size = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    pair = [F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")]

    hubs = lists.groupBy("value").agg(F.count("*").alias("size"), F.min(F.struct("noise", "doc", "n")).alias("h")).where("size > 1")
    hubs = settle(few(hubs.select("value", "size", c("h.doc").alias("other"), c("h.n").alias("m")), lists.count() // 2), "hubs")
    star = lists.join(hubs, "value").where((c("doc") != c("other")) & similar_size).select(pair).distinct()
    links = confirmed(passing(star, sketched, percent), docs, key, text, percent)
    components = settle(connected_components(links), "components")

    member = lists.join(hubs.select("value", "size"), "value").join(components, c("doc") == c("node"), "left").withColumn("component", F.coalesce("component", "doc"))
    member = settle(member.select("value", "doc", "n", "mask", "size", "component"), "members")
    mixed = member.groupBy("value").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("value")
    mixed = settle(member.join(mixed, "value", "left_semi"), "mixed")
    short = mixed.where(c("size") <= SHORT_LIST)
    other = short.select("value", c("doc").alias("other"), c("n").alias("m"), c("component").alias("component2"))
    short = short.join(other, "value").where((c("doc") < c("other")) & (c("component") != c("component2")) & similar_size).select(pair).distinct()
    long = mixed.where(c("size") > SHORT_LIST).drop("size")
    long = settle(long.join(own_lists(long), "value", "left_semi"), "long-lists")
    # of near copies many pairs lie just below the threshold: wider sketches settle most of them, within the blocks
    asked = settle(few(long.select(c("doc").alias(key)).distinct(), long.count()), "asked")
    wide = settle(sketch_documents(docs.join(counted(asked, BROADCAST_IDS), key, "left_semi"), key, text, percent, WIDE).dropDuplicates(["doc", "d1", "d2"]), "wide-sketches")
    long = block_rows(long, percent).join(wide.select("doc", "n", "sketch"), ["doc", "n"])
    kind = docs.schema[key].dataType.simpleString()
    long = long.groupBy("value", "block").applyInPandas(lambda g: block_pairs(g, percent), f"a {kind}, b {kind}, sure boolean")
    more = confirmed(passing(short, sketched, percent).union(long), docs, key, text, percent)
    components = settle(connected_components(links.union(more)), "components")

    named = classes.select("d1", "d2", "doc").join(components, c("doc") == c("node"), "left").select("d1", "d2", F.coalesce("component", "doc").alias("component"))
    found = sketches.select("doc", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    component = F.when((c("n") > 0) & c("doc").isNotNull(), c("component")).otherwise(c("doc"))
    return found.select(c("doc").alias(key), c("n").alias("n_shingles"), component.alias("component_id"), c("doc").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents without those that a smaller id represents, all columns kept."""
    gone = near_duplicates(docs, key, text, percent).where("not kept").select(key).distinct()
    return docs.join(counted(gone, BROADCAST_IDS), key, "left_anti").select(docs.columns)  # few: texts are not shuffled
