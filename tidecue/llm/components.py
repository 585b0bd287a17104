"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.llm.common import few, settle


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """For every node of the links (a, b) the smallest node that it is connected with: (node, component).

    Each round connects a node's larger neighbours, then its smaller ones, with the smallest of them; the
    number of rounds grows with the logarithm of the longest path. Minima are aggregated before the
    shuffle, and every round is written, so a hub costs no more than its links. Null ends are ignored.
    No round makes more edges than it had, hence the number of their partitions. ``links`` are read twice.
    """
    c = F.col
    n = links.count()
    edges = settle(few(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), n), "edges")
    nodes = few(edges.select(c("u").alias("node")).union(edges.select("v")).distinct(), 2 * n)
    mark = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(c("v").alias("u"), c("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(c("v").alias("u"), c("m").alias("v")).union(low.select("u", "m")).where("u <> v")
        edges = settle(few(small.distinct(), n), "edges")  # u stays the larger end
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(found, nodes["node"] == found["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
