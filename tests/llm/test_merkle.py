"""Merkle manifests against a plain tree that holds all its levels."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidecue.llm import merkle
from tidecue.llm.common import shared_folder

KEPT = "doc_id long, lang string, text string, g int, place long, `n` long, item string"  # the last four clash with inner names


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values) -> str:
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves: list[str]) -> list[list[str]]:
    levels = [leaves]
    while len(levels[-1]) > 1:
        v = levels[-1]
        levels.append([sha(*v[i : i + 2]) for i in range(0, len(v), 2)])
    return levels


def plain_path(levels: list[list[str]], i: int) -> list[tuple[str | None, bool]]:
    return [(v[(i >> k) ^ 1] if (i >> k) ^ 1 < len(v) else None, bool((i >> k) & 1)) for k, v in enumerate(levels[:-1])]


def nulls_first(x):
    return (x is not None, x.encode() if isinstance(x, str) else x or 0)


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """(lang, doc_id, leaf, subroot, root, proof) of all rows."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], plain_leaf(r[0], r[1], r[2])))
    order = sorted(groups, key=nulls_first)
    trees = {g: plain_tree([x for _, x in sorted(groups[g], key=lambda y: (nulls_first(y[0]), y[1]))]) for g in order}
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (key, leaf) in enumerate(sorted(groups[g], key=lambda y: (nulls_first(y[0]), y[1]))):
            out.append((g, key, leaf, trees[g][-1][0], top[-1][0], plain_path(trees[g], i) + plain_path(top, k)))
    return sorted(out, key=repr)


def written(spark, rows, step=merkle.STEP):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], KEPT).repartition(3)
    folder = shared_folder(spark, "manifest")
    merkle.write_manifest(df.withColumn("leaf", merkle.leaf_digest([F.col("doc_id"), F.col("lang"), F.col("text")])), folder, step=step)
    return folder


def found_rows(spark, folder):
    return sorted(((r.lang, r.doc_id, r.leaf, r.subroot, r.root, [(s.sibling, s.left) for s in r.proof]) for r in merkle.proofs(spark, folder).collect()), key=repr)


def many(sizes: dict) -> list[tuple]:
    rng = random.Random(1)
    return [(rng.randrange(10**6), g, f"text {g} {i} é") for g, n in sizes.items() for i in range(n)]


@pytest.mark.parametrize("step", [2, 4])
def test_trees_of_all_small_sizes(spark, step):
    """Groups of 1 to 20 leaves and around powers of two, with a group that is null and one that is empty text."""
    rows = many({f"g{n}": n for n in (*range(1, 21), 31, 32, 33, 64, 65)} | {None: 7, "": 2, "ß": 3, "Z": 1, "a": 1})
    assert found_rows(spark, written(spark, rows, step)) == plain_manifest(rows)


def test_one_large_group_in_many_partitions(spark):
    rows = many({"en": 700, "de": 3})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = written(spark, rows)
        found = found_rows(spark, folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == plain_manifest(rows)
    widest = [spark.read.parquet(f"{folder}/groups/{k}").agg(F.max(F.size("members"))).first()[0] for k in range(3)]
    assert widest == [16, 16, 3]  # no row grows with a group


def test_ties_repeated_rows_and_nulls(spark):
    rows = [(5, "en", "a"), (5, "en", "a"), (5, "en", "b"), (None, "en", "c"), (None, "en", "c"), (None, None, None), (1, "en", None), (-3, "en", ""), (5, "de", "a")]
    found = found_rows(spark, written(spark, rows))
    assert found == plain_manifest(rows) and len(found) == len(rows)


def test_empty_tables_and_single_rows(spark):
    assert found_rows(spark, written(spark, [])) == []
    (lang, key, leaf, subroot, root, proof), = found_rows(spark, written(spark, [(1, "en", "x")]))
    assert leaf == subroot == root == plain_leaf(1, "en", "x") and proof == []


def test_only_every_few_levels_are_stored(spark):
    folder = written(spark, many({"en": 300}))
    nodes = [spark.read.parquet(f"{folder}/groups/{k}").select(F.explode("members")).count() for k in range(3)]
    assert nodes == [300, 19, 2]  # of the levels with 300, 150, 75, 38, 19, 10, 5, 3, 2 and 1 nodes


def test_folding_finds_every_change(spark):
    rows = many({"en": 40, None: 3, "de": 1})
    found = merkle.proofs(spark, written(spark, rows))
    right = merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")
    wrong = merkle.fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")
    turned = merkle.fold(F.col("leaf"), F.transform("proof", lambda s: F.struct(s["sibling"].alias("sibling"), (~s["left"]).alias("left")))) == F.col("root")
    assert found.select(F.bool_and(right), F.bool_or(wrong), F.bool_or(turned)).first()[:] == (True, False, False)
    assert [tuple(r) for r in found.select("rest.g", "rest.place", "rest.n", "rest.item", "rest.text").where("doc_id is not null").distinct().select("g", "place", "n", "item").distinct().collect()] == [(1, 2, 3, "x")]


def test_leaf_tells_columns_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "-"), ("-", None), ("", None), ("é", "")], "x string, y string")
    leaves = [r[0] for r in df.select(merkle.leaf_digest([F.col("x"), F.col("y")])).collect()]
    assert len(set(leaves)) == 6 and leaves[5] == sha("2:é0:")
