"""Approximate nearest neighbours by largest inner product, with a robust-pruned directed graph per shard.

Vectors are dealt by a hash of their id to shards, one partition each: as many as the session has cores while
they hold few vectors, and of ``shard_rows`` vectors each beyond that. In a task, copies of a vector become one
node that holds the smallest ids only, as many as a query can ask for; the nodes form a directed graph: a
greedy search from a fixed entry proposes neighbours, and relaxed distance pruning keeps those that no kept
neighbour is clearly closer to. The index is written once. Each shard's index then goes to one task, and all
queries stream past it in batches of bounded size: a beam search gives candidates, scored in double precision
on the original vectors, and the best over all shards stay. Queries whose beam ends among nodes that it cannot tell
from the k-th best, as those of quantised vectors, are answered by an exact scan of the shard instead. Neither vectors nor queries are collected or
broadcast; what is shuffled is the index once, and the queries once for each shard.

Inner products become distances by one more coordinate: with M the largest norm of a shard, x gets
sqrt(M**2 - |x|**2) and a query 0, so that the nearest vector is the one with the largest inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tidecue.llm.common import settle, tidy

#: Vectors in a shard of a large table: the index of 131,072 vectors of 128 numbers takes about 90 MB.
SHARD_ROWS = 131_072
#: A shard has at least so many vectors before the table is dealt to more cores.
LEAST_ROWS = 4_096
DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
#: Searches that advance together in numpy.
TOGETHER = 512
#: Numbers in an array of an exact scan.
SCAN = 1 << 22


def _first_of_each(ids: np.ndarray) -> np.ndarray:
    """Mask of the first place of each number in each row; -1 never counts."""
    order = np.argsort(ids, axis=1, kind="stable")
    ranked = np.take_along_axis(ids, order, axis=1)
    first = np.ones(ids.shape, bool)
    first[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    out = np.empty(ids.shape, bool)
    np.put_along_axis(out, order, first, axis=1)
    return out & (ids >= 0)


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Nodes near the queries and their squared distances, nearest first; -1 where fewer were found.

    All queries advance together: each round expands the nearest ``width`` nodes not yet expanded in the
    beam, until no beam has any.
    """
    b, n = len(queries), len(x)
    norms = np.einsum("nd,nd->n", x, x)
    distance = lambda rows, ids: norms[ids] - 2 * np.einsum("bd,bkd->bk", queries[rows], x[ids])
    ids = np.full((b, beam), -1)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    dist[:, 0] = norms[entry] - 2 * (queries @ x[entry])
    seen = np.zeros((b, n), bool)
    seen[:, entry] = True
    active = np.arange(b)
    while len(active):
        d = np.where(done[active], np.inf, dist[active])
        pick = np.argpartition(d, min(width, beam) - 1, axis=1)[:, :width]
        some = np.take_along_axis(d, pick, axis=1) < np.inf
        live = some.any(axis=1)
        active, pick, some = active[live], pick[live], some[live]
        if not len(active):
            break
        rows = active[:, None]
        done[rows, pick] = True
        near = graph[np.where(some, ids[rows, pick], 0)]
        near = np.where(some[:, :, None], near, -1).reshape(len(active), -1)
        fresh = (near >= 0) & ~seen[rows, near]
        near = np.where(fresh, near, -1)
        near = np.where(_first_of_each(near), near, -1)
        # most places are empty after the first rounds: keep as many columns as the fullest row needs
        full = int((near >= 0).sum(axis=1).max())
        if not full:
            continue
        near = -np.sort(-near, axis=1)[:, :full]
        at, col = np.nonzero(near >= 0)
        seen[active[at], near[at, col]] = True
        nd = np.where(near >= 0, distance(active, np.maximum(near, 0)), np.inf).astype(np.float32)
        all_d, all_i = np.concatenate([dist[active], nd], axis=1), np.concatenate([ids[active], near], axis=1)
        all_done = np.concatenate([done[active], near < 0], axis=1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[active], ids[active], done[active] = (np.take_along_axis(v, best, axis=1) for v in (all_d, all_i, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each point among its candidates (-1: none), all points together.

    The nearest candidate left is kept; those that are ``alpha`` times closer to it than to the point go.
    """
    ids = np.where(_first_of_each(candidates) & (candidates != points[:, None]), candidates, -1)
    v = x[np.maximum(ids, 0)]
    d = np.where(ids >= 0, ((v - x[points][:, None]) ** 2).sum(axis=2), np.inf)
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        at = d.argmin(axis=1)
        ok = d[rows, at] < np.inf
        if not ok.any():
            break
        out[ok, k] = ids[rows, at][ok]
        between = ((v - v[rows, at][:, None]) ** 2).sum(axis=2)
        d = np.where((alpha**2 * between <= d) | ~ok[:, None], np.inf, d)
        d[rows, at] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 5) -> tuple[np.ndarray, int]:
    """Out-neighbours of every node (-1: none), and the entry node, the one nearest to the mean."""
    n = len(x)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    if n <= degree + 1:  # everyone knows everyone
        full = np.tile(np.arange(n), (n, 1))
        full[np.arange(n), np.arange(n)] = -1
        return full, entry
    r = np.random.default_rng(seed)
    graph = r.integers(0, n, (n, degree))
    graph[graph == np.arange(n)[:, None]] = entry
    for slack in (1.0, alpha):
        order = r.permutation(n)
        for i in range(0, n, TOGETHER):
            points = order[i : i + TOGETHER]
            found, _ = beam_search(x, graph, entry, x[points], beam)
            graph[points] = robust_prune(x, points, np.concatenate([found, graph[points]], axis=1), degree, slack)
            # each new neighbour learns of the point; where that makes too many, its neighbours are pruned
            at, col = np.nonzero(graph[points] >= 0)
            target, source = graph[points][at, col], points[at]
            known = (graph[target] == source[:, None]).any(axis=1)
            target, source = target[~known], source[~known]
            if not len(target):
                continue
            by = np.argsort(target, kind="stable")
            target, source = target[by], source[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            extra = np.full((len(nodes), int(count.max())), -1)
            extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
            both = np.concatenate([graph[nodes], extra], axis=1)
            over = (both >= 0).sum(axis=1) > degree
            graph[nodes[~over]] = -np.sort(-both[~over], axis=1)[:, :degree]
            for k in range(0, int(over.sum()), TOGETHER):
                own = np.flatnonzero(over)[k : k + TOGETHER]
                width = int((both[own] >= 0).sum(axis=1).max())
                graph[nodes[own]] = robust_prune(x, nodes[own], -np.sort(-both[own], axis=1)[:, :width], degree, slack)
    return graph, entry


class Shard:
    """A graph over the distinct vectors of a shard, and for each of them its smallest ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, starts: np.ndarray, graph: np.ndarray | None = None, entry: int = 0):
        self.vectors, self.ids, self.starts = vectors, ids, starts
        norm = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        self.longest = norm.max()
        rest = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        self.x = np.concatenate([vectors / self.longest, rest[:, None]], axis=1).astype(np.float32)
        self.graph, self.entry = build_graph(self.x) if graph is None else (graph, entry)

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray, keep: int) -> Shard:
        """A new graph; of each vector's copies the smallest ``keep`` ids stay, more cannot be among the nearest."""
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        distinct, inverse = np.unique(np.ascontiguousarray(vectors[order]), axis=0, return_inverse=True)
        by = np.argsort(inverse.ravel(), kind="stable")
        starts = np.searchsorted(inverse.ravel()[by], np.arange(len(distinct) + 1))
        kept = np.minimum(np.diff(starts), keep)
        place = np.arange(kept.sum()) + np.repeat(starts[:-1] - np.cumsum(kept) + kept, kept)
        return Shard(distinct, ids[by[place]], np.append(0, kept.cumsum()))

    def packed(self) -> list:
        parts = (self.vectors, self.graph.astype(np.int32), self.ids, self.starts)
        return [self.vectors.shape[1], self.entry, *(np.ascontiguousarray(p).tobytes() for p in parts)]

    @staticmethod
    def unpacked(row: dict, kind: type) -> Shard:
        vectors = np.frombuffer(row["vectors"], kind).reshape(-1, row["width"])
        graph = np.frombuffer(row["graph"], np.int32).reshape(len(vectors), -1).astype(np.int64)
        return Shard(vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64), graph, int(row["entry"]))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> list[tuple[int, int, float]]:
        """The k best of the shard for each query but the query itself: (query, id, score), ties to the smaller id."""
        out = []
        for i in range(0, len(ids), TOGETHER):
            own, q = ids[i : i + TOGETHER], queries[i : i + TOGETHER].astype(float)
            unit = np.concatenate([q / np.sqrt((q**2).sum(axis=1, keepdims=True)), np.zeros((len(q), 1))], axis=1).astype(np.float32)
            found, _ = beam_search(self.x, self.graph, self.entry, unit, min(max(beam, k + 1), len(self.x)))
            score = np.where(found >= 0, np.einsum("bd,bkd->bk", q, self.vectors[np.maximum(found, 0)].astype(float)), -np.inf)
            # where the k-th best of a full beam is as near as its last node, by what the beam can tell apart, others may be as near
            blur = 1e-6 * self.longest * np.sqrt((q**2).sum(axis=1))
            kth = -np.sort(-score, axis=1)[:, min(k, score.shape[1] - 1)]
            tied = (found >= 0).all(axis=1) & (found.shape[1] < len(self.x)) & (kth - score.min(axis=1) <= blur)
            for at in np.flatnonzero(~tied).tolist():
                out += self._best(own[at], found[at][found[at] >= 0], score[at][found[at] >= 0], k)
            out += self._scan(own[tied], q[tied], k)
        return out

    def _best(self, one: int, nodes: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The k best ids of nodes with their scores, a repeated id once for each different score."""
        size = self.starts[nodes + 1] - self.starts[nodes]
        ids = self.ids[np.arange(size.sum()) + np.repeat(self.starts[nodes] - np.cumsum(size) + size, size)]
        score = np.repeat(score, size)
        order = np.lexsort((ids, -score))
        ids, score = ids[order], score[order]
        keep = ids != one
        keep[1:] &= (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])
        return [(int(one), c, v) for c, v in zip(ids[keep][:k].tolist(), score[keep][:k].tolist(), strict=True)]

    def _scan(self, own: np.ndarray, q: np.ndarray, k: int) -> list[tuple[int, int, float]]:
        """The exact answer by all nodes, for queries that the beam leaves open; in slices of bounded size."""
        out: list[tuple[int, int, float]] = []
        wide = max(1, SCAN // len(self.x))
        tall = max(1, SCAN // self.vectors.shape[1])
        for i in range(0, len(own), wide):
            part = q[i : i + wide]
            rough = np.concatenate([part @ self.vectors[j : j + tall].astype(float).T for j in range(0, len(self.x), tall)], axis=1)
            last = -np.partition(-rough, min(k, rough.shape[1] - 1), axis=1)[:, min(k, rough.shape[1] - 1)]
            for at in range(len(part)):
                # rounding of a matrix product may differ from that of the measure itself, which decides
                nodes = np.flatnonzero(rough[at] >= last[at] - 1e-9 * max(1.0, abs(last[at])))
                out += self._best(own[i + at], nodes, self._scores(part[at], nodes), k)
        return out

    def _scores(self, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        tall = max(1, SCAN // self.vectors.shape[1])
        return np.concatenate([np.einsum("bd,bkd->bk", q[None], self.vectors[nodes[j : j + tall]].astype(float)[None])[0] for j in range(0, len(nodes), tall)])


def usable(vector: str) -> Column:
    """Whether a vector is not null, not all zero, and has finite components only."""
    c = F.col(vector)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(c, lambda v: v != 0), F.lit(False))


def dealt(vectors: DataFrame, shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_ROWS) -> tuple[int, int]:
    """The length that most vectors (v) have, the smaller one of equals, and the number of shards for those."""
    counts = vectors.groupBy(F.size("v").alias("width")).count().orderBy(F.col("count").desc(), "width").first()
    if counts is None:
        return 0, 1
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    return counts["width"], max(ceil(counts["count"] / shard_rows), min(cores, counts["count"] // least_rows), 1)


def stored_type(df: DataFrame, vector: str) -> tuple[str, type]:
    """How vectors are kept and scored: single precision as it is, all else as doubles."""
    single = df.schema[vector].dataType.elementType == FloatType()
    return ("array<float>", np.float32) if single else ("array<double>", np.float64)


def build_index(rows: DataFrame, shards: int, keep: int, kind: type) -> DataFrame:
    """One row per shard: its graph over the vectors (id, v), and the smallest ``keep`` ids of each."""
    schema = "shard int, width int, entry int, vectors binary, graph binary, ids binary, starts binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, shard = [], [], 0
        for b in batches:
            if b.num_rows:
                shard = b.column("shard")[0].as_py()
                ids.append(b.column("id").to_numpy())
                vectors.append(b.column("v").flatten().to_numpy().astype(kind).reshape(b.num_rows, -1))
        if ids:
            made = Shard.of(np.concatenate(ids), np.concatenate(vectors), keep).packed()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([shard, *made], [pa.int32()] * 3 + [pa.binary()] * 4, strict=True)], [x.split()[0] for x in schema.split(", ")])

    own = rows.select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    return settle(own.repartitionById(shards, F.col("shard")).mapInArrow(build, schema), "index")


@tidy("nearest")
def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found for each query, itself left out.

    Ties go to the smaller id. Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without id, nor vectors of another length than most have. An id that repeats counts once
    for each different score. With no more than k candidates, all are returned.
    """
    c = F.col
    (sql_type, kind), (other, _) = stored_type(vectors, vector), stored_type(queries, vector)
    if other != sql_type:
        sql_type, kind = "array<double>", np.float64
    pick = lambda df: df.where(c(key).isNotNull() & usable(vector)).select(c(key).alias("id"), c(vector).cast(sql_type).alias("v"))
    width, shards = dealt(pick(vectors), shard_rows, least_rows)
    rows, asked = (pick(df).where(F.size("v") == width) for df in (vectors, queries))
    index = build_index(rows, shards, k + 1, kind)
    parts = ("width", "entry", "vectors", "graph", "ids", "starts")
    none = [F.lit(None).cast(index.schema[x].dataType).alias(x) for x in parts]
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    both = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast(sql_type).alias("v"), *parts)
    both = both.union(asked.select(every, F.lit(1).alias("kind"), "id", "v", *none)).repartitionById(shards, c("shard")).sortWithinPartitions("kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for b in batches:
            own = b.column("kind").to_numpy()
            first = int((own == 0).sum())  # the index comes before all queries
            if first:
                shard = Shard.unpacked({x: b.column(x)[0].as_py() for x in parts}, kind)
            asked = b.slice(first)
            if shard is None or not asked.num_rows:
                continue
            found = shard.search(asked.column("id").to_numpy(), asked.column("v").flatten().to_numpy().reshape(asked.num_rows, -1), k, beam)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(search, "query_id long, vec_id long, score double")
    # rows of an id lie in one shard, which gives each of its scores once; a query id that repeats may still ask twice for one.
    # The limit by rank is applied in part before the only shuffle, and equal ranks of a query are equal rows.
    nearest_first = Window.partitionBy("query_id").orderBy(c("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(nearest_first)).where(c("rank") <= k)
    return ranked.dropDuplicates(["query_id", "rank"]).select("query_id", "rank", "vec_id", "score")
