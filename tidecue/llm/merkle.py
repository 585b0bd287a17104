"""A Merkle manifest of a dataset: a digest per row, per group of rows and of the whole, and proofs of membership.

H is SHA-256 as lowercase hex over its inputs concatenated; digests enter as hex text. A row's leaf is the H of its
columns. Within a group leaves stand in order of key; while multiple nodes remain, every 2 consecutive ones (the last
may be alone) become their H. What remains is the group's subroot; the subroots, in order of group, give the root.

Checkpoint and recompute: of a tree of n leaves only every ``step``-th level is persisted, so that next to the leaves
hardly n / 2**step digests are kept. A stored node and the 2**step stored nodes below it span an aligned subtree, one
block. A proof is put together from the root downwards: each block regenerates the missing levels between from its
own stored nodes, emits for each of these the siblings on the way up, and discards what it regenerated. Blocks are
independent rows of at most 2**step digests, whatever a group's size, so no group lies in one task.

Places of leaves come from one range partitioning by group and key, which cuts large groups into many partitions,
and from counts per partition; rows are never numbered by one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecue.llm.common import counted, scope, settle

#: Levels between two that are persisted.
STEP = 4
#: Counts of partitions and groups that may be broadcast; beyond it, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def leaf_digest(columns: list[Column]) -> Column:
    """The H of values: each `-` if null, else the length of its text in UTF-8 bytes, a colon and the text."""
    part = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return F.sha2(F.concat(*[part(x.cast("string")) for x in columns]), 256)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _above(nodes: Column) -> Column:
    """The level above some consecutive nodes, the first of which has an even place."""
    pair = lambda i: F.concat(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), lambda i: F.sha2(pair(i), 256))


def _first(n: Column, step: int) -> Column:
    """The numbers from 0 to n - 1, for n of 0 to ``step``."""
    return F.slice(F.array(*[F.lit(i) for i in range(step)]), F.lit(1), n.cast("int"))


def _height(n: Column) -> Column:
    """Levels above n nodes: the least h with 2**h >= n."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def numbered(rows: DataFrame, group: str, order: list[str], place: str = "place", size: str = "n") -> DataFrame:
    """The rows with their place (from 0) within their group in ascending order, nulls first, and the group's size.

    Rows that are equal in all of ``order`` take any order among themselves.
    """
    c = F.col
    keys = [group, *order]
    # the last key cuts hot keys in the range partitioning
    marked = rows.withColumn("_row", F.monotonically_increasing_id())
    dealt = marked.repartitionByRange(*[c(k).asc_nulls_first() for k in keys], "_row").sortWithinPartitions(*[c(k).asc_nulls_first() for k in keys], "_row")
    # a row's id holds its partition, in its upper bits, and its place within that
    dealt = settle(dealt.drop("_row").withColumn("_at", F.monotonically_increasing_id()), "numbered")
    parts = dealt.groupBy(c(group).alias("_group"), F.shiftright("_at", 33).alias("_part")).agg(F.min("_at").alias("_from"), F.count("*").alias("_rows"))
    own = Window.partitionBy("_group")  # a row for each partition that holds some of the group
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = settle(parts.select("_group", "_part", (before - c("_from")).alias("_shift"), F.sum("_rows").over(own).alias(size)), "parts")
    found = dealt.join(counted(parts, BROADCAST_ROWS), c(group).eqNullSafe(c("_group")) & (F.shiftright("_at", 33) == c("_part")))
    return found.select(*rows.columns, (c("_at") + c("_shift")).alias(place), size)


def _build(nodes: DataFrame, folder: str, step: int) -> tuple[int, DataFrame]:
    """Write the stored levels of the trees of nodes (g, n, place, digest, item), as blocks; how many levels, and their roots (g, n, digest)."""
    c = F.col
    spark, roots = nodes.sparkSession, []
    most = nodes.agg(F.max(_height(c("n")))).first()[0] or 0
    levels = max(1, -(-most // step))
    nodes = nodes.withColumn("leaves", c("n"))
    for k in range(levels):
        blocks = nodes.groupBy("g", "n", "leaves", F.shiftright("place", step).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "item"))).alias("members"))
        blocks.write.parquet(f"{folder}/{k}")
        digest = F.aggregate(_first(F.least(_height(c("n")), F.lit(step)), step), F.transform("members", lambda m: m["digest"]), lambda a, _: _above(a))[0]
        nodes = spark.read.schema(blocks.schema).parquet(f"{folder}/{k}").select("g", F.ceil(c("n") / (1 << step)).alias("n"), "leaves", c("block").alias("place"), digest.alias("digest"), F.lit(None).cast("int").alias("item"))
        roots.append(nodes.where("n = 1").select("g", c("leaves").alias("n"), "digest"))
        nodes = nodes.where("n > 1")
    return levels, reduce(DataFrame.union, roots)


def write_manifest(rows: DataFrame, path: str, key: str = "doc_id", group: str = "lang", leaf: str = "leaf", step: int = STEP) -> None:
    """Write the manifest of rows with a column of leaf digests to a new folder; other columns are kept beside the leaves.

    Leaves ascend by key, then by digest, groups by value (texts by their UTF-8 bytes), nulls first in both. A table
    without rows has a manifest without a root. The folder must be one that all executors share.
    """
    c = F.col
    spark = rows.sparkSession
    with scope(spark):
        # under names of their own, so that no column can clash with those used here
        item = F.struct(c(key).alias("key"), F.struct(*[c(x) for x in rows.columns if x not in (key, group, leaf)], F.lit(0).alias("_")).alias("rest"))
        leaves = numbered(rows.select(c(group).alias("g"), c(key).alias("_key"), c(leaf).alias("digest"), item.alias("item")), "g", ["_key", "digest"])
        levels, roots = _build(leaves, f"{path}/groups", step)
        roots.write.parquet(f"{path}/roots")
        roots = spark.read.parquet(f"{path}/roots").select(F.lit(0).alias("g"), c("g").alias("item"), c("digest"))
        top_levels, root = _build(numbered(roots, "g", ["item"]), f"{path}/top", step)
        found = root.first()
        layout = spark.createDataFrame([(step, levels, top_levels, found and found.digest)], "step int, levels int, top_levels int, root string")
        layout.write.parquet(f"{path}/layout")


def _paths(spark: SparkSession, folder: str, levels: int, step: int, roots: DataFrame) -> DataFrame:
    """(g, digest, item, proof, tree) of all leaves of trees, given each tree's root as (g, tree, proof)."""
    c = F.col
    above = None
    for k in reversed(range(levels)):
        blocks = spark.read.parquet(f"{folder}/{k}").withColumnRenamed("g", "own").drop("leaves")
        last = blocks.where(c("n") <= 1 << step).join(roots, c("own").eqNullSafe(c("g")))
        met = last if above is None else last.unionByName(blocks.where(c("n") > 1 << step).join(above, c("own").eqNullSafe(c("g")) & (c("block") == c("place"))).select(last.columns))
        height = F.least(_height(c("n")), F.lit(step))
        # the block's own levels below its root, regenerated from the stored one
        grown = F.aggregate(F.slice(_first(height, step), F.lit(2), F.lit(step)), F.array(F.transform("members", lambda m: m["digest"])), lambda a, _: F.concat(a, F.array(_above(F.element_at(a, -1)))))

        def siblings(regenerated: Column, i: Column) -> Column:
            at = lambda j: F.call_function("shiftright", i, j)
            sibling = lambda j: F.get(F.get(regenerated, j), at(j).bitwiseXOR(F.lit(1)))
            return F.transform(_first(height, step), lambda j: F.struct(sibling(j).alias("sibling"), (at(j) % 2 == 1).alias("left")))

        each = _let(grown, lambda r: F.transform("members", lambda m, i: F.struct(m["place"].alias("place"), m["digest"].alias("digest"), m["item"].alias("item"), F.concat(siblings(r, i), c("proof")).alias("proof"))))
        above = met.select(c("own").alias("g"), "tree", F.explode(each).alias("x")).select("g", "tree", "x.*")
    return above.select("g", "tree", "digest", "item", "proof")


def proofs(spark: SparkSession, path: str, key: str = "doc_id", group: str = "lang", leaf: str = "leaf") -> DataFrame:
    """Per row of a written manifest: group, key, leaf, subroot, root and proof, and the columns kept beside the leaves as ``rest``.

    The proof has an entry per level, from the leaf up to the root: the node's sibling, null where it has none, and whether
    that stands left of it.
    """
    c = F.col
    layout = spark.read.parquet(f"{path}/layout").first()
    none = F.array().cast("array<struct<sibling:string,left:boolean>>")
    root = spark.range(1).select(c("id").cast("int").alias("g"), F.lit(layout.root).cast("string").alias("tree"), none.alias("proof"))
    tops = _paths(spark, f"{path}/top", layout.top_levels, layout.step, root)
    roots = tops.select(c("item").alias("g"), c("digest").alias("tree"), "proof")
    found = _paths(spark, f"{path}/groups", layout.levels, layout.step, roots)
    return found.select(c("g").alias(group), c("item.key").alias(key), c("digest").alias(leaf), c("tree").alias("subroot"), F.lit(layout.root).cast("string").alias("root"), "proof", c("item.rest").alias("rest"))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and a proof."""
    joined = lambda a, s: F.when(s["sibling"].isNull(), a).when(s["left"], F.concat(s["sibling"], a)).otherwise(F.concat(a, s["sibling"]))
    return F.aggregate(proof, leaf, lambda a, s: F.sha2(joined(a, s), 256))


def proof_digest(proof: Column) -> Column:
    """The H of a proof's siblings, from the leaf up to the root."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.coalesce(s["sibling"], F.lit(""))), ""), 256)
