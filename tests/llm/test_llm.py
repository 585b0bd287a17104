"""Operators of the llm subpackage against brute force, libraries, round trips and held-out labels."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import os
import random
import re
import time
import tracemalloc
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from compare import connect, rows_in, rows_of
from tidecue.llm import ann, bpe, chat, components, decontam, langid, linedup, minhash, quality, toxicity, warc, words
from tidecue.llm import queries as q
from tidecue.llm import common
from tidecue.llm.common import held_out, scope, settle, table

SCHEMA = "doc_id long, text string, lang string, source string, doc string, no string"  # the last two clash with inner names


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def made(spark, texts: dict):
    return spark.createDataFrame([(k, t, None, None, "x", "y") for k, t in texts.items()] if isinstance(texts, dict) else [(k, t, None, None, "x", "y") for k, t in texts], SCHEMA)


@pytest.fixture(autouse=True)
def same_settings(spark):
    """No operator changes a setting of the session."""
    before = dict(spark.conf.getAll)
    yield
    assert dict(spark.conf.getAll) == before


def test_batches_are_bounded_by_bytes():
    texts = ["x" * 1_000_000] * 300 + ["w" * 1000] * 2000 + [None, "", "y"] * 200 + ["z" * 20_000_000] + ["é"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([[1] * 10] * len(texts))], ["k", "t", "n"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), "t", "n"))
    assert [k for p in parts for k in p.column("k").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows <= common.SLICE_ROWS and (p.num_rows == 1 or sum(len(t or "") for t in p.column("t").to_pylist()) <= common.SLICE_BYTES) for p in parts)


def test_scopes_of_threads(spark):
    """Operators that run at once delete their own tables only, also when one fails."""
    folder = common.shared_folder(spark, "x").rsplit("/", 1)[0]
    frames = [made(spark, {k: "same line\nsame line", k + 1: "same line"}) for k in (1, 10)]

    def count(df):
        with common.scope(spark):
            return [tuple(r) for r in linedup.line_counts(df).orderBy("doc_id").collect()]

    before = set(os.listdir(folder))
    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(count, frames))
    assert found == [[(k, 2, 1, [1]), (k + 1, 1, 1, [0])] for k in (1, 10)]
    with pytest.raises(ZeroDivisionError), common.scope(spark):
        common.settle(frames[0], "failing")
        raise ZeroDivisionError
    assert set(os.listdir(folder)) == before


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    df = q.queries()[name](spark, sf_dir)
    columns, expected = rows_in(connect(sf_dir), q.oracle_sql()[name])
    assert sorted(df.columns) == columns
    assert rows_of(df) == expected


# --- words


def test_words_of_long_and_odd_texts(monkeypatch):
    monkeypatch.setattr(words, "CHUNK", 50)
    texts = [None, "", "a B\tc", "x" * 200 + " y", "Ünï ünï\x0bz", "word " * 100, "A a", "\x1c"]
    hashes, heads, offsets = words.word_hashes(texts, head=2)
    seen: dict[str, int] = {}
    for t, a, b in zip(texts, offsets, offsets[1:]):
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert len(own) == b - a
        for w, h in zip(own, hashes[a:b].tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) and len(heads) == len(hashes)


# --- 1


def test_ann_recall_and_edges(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_rows=200).toPandas()
    rows = vectors.orderBy("vec_id").toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    hits = []
    for qid, own in found.groupby("query_id"):
        s = x @ x[qid]
        s[qid] = -np.inf
        best = rows["vec_id"].to_numpy()[np.lexsort((rows["vec_id"], -s))[:20]]
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21)) and own["score"].is_monotonic_decreasing
        assert np.allclose(own["score"], s[own["vec_id"]])
        hits.append(len(set(best) & set(own["vec_id"])) / 20)
    assert len(hits) == 25 and np.mean(hits) >= 0.95


def test_ann_copies_norms_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=6) * (1 + i % 7)], "e") for i in range(300)]
    rows += [(1000 + i, [3.0, 0.0, 0.0, 0.0, 0.0, 0.0], "e") for i in range(100)]
    rows += [(2000, None, "e"), (2001, [0.0] * 6, "e"), (2002, [float("nan")] * 6, "e"), (2003, [None] + [1.0] * 5, "e"), (2004, [float("inf")] * 6, "e"), (None, [1.0] * 6, "e")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string")
    found = ann.nearest(df, df.where("vec_id in (1050, 3, 2001)"), k=20, shard_rows=100).toPandas()
    good = [r for r in rows if r[0] is not None and r[0] < 2000]
    x = np.array([r[1] for r in good], np.float32).astype(float)
    ids = np.array([r[0] for r in good])
    assert set(found["query_id"]) == {1050, 3}
    for qid in (1050, 3):
        s = x @ x[list(ids).index(qid)]
        s[list(ids).index(qid)] = -np.inf
        want = ids[np.lexsort((ids, -s))[:20]]
        got = found[found["query_id"] == qid].sort_values("rank")["vec_id"].to_numpy()
        assert len(set(want) & set(got)) >= 18 and 2000 > got.max()
        assert list(got[np.isin(got, want)]) == [w for w in want if w in set(got)]
    assert ann.nearest(df.limit(0), df).count() == 0
    few = df.where("vec_id < 4")
    assert ann.nearest(few, few).count() == 12


def test_ann_many_ties_take_one_scan():
    """8,000 vectors of which all, or large groups, have the same score with each query."""
    rng = np.random.default_rng(4)
    for vectors in (np.stack([np.ones(8000), np.arange(8000) / 8000, np.zeros(8000)], axis=1), np.sign(rng.standard_normal((8000, 9)))):
        vectors = vectors.astype(np.float32)
        ids = rng.permutation(8000)
        shard = ann.Shard.of(ids, vectors, 21)
        queries = np.array([[1.0, 0, 0]] * 20) if vectors.shape[1] == 3 else vectors[:20].astype(float)
        own = np.arange(-20, 0)
        began = time.perf_counter()
        found = shard.search(own, queries, 20, ann.SEARCH_BEAM)
        assert time.perf_counter() - began < 1
        for one, q in zip(own.tolist(), queries, strict=True):
            score = vectors.astype(float) @ q
            best = np.lexsort((ids, -score))[:20]
            assert [(c, v) for o, c, v in found if o == one] == list(zip(ids[best].tolist(), score[best].tolist(), strict=True))


def test_ann_scores_doubles_as_they_are(spark):
    """Differences below single precision decide; an id that repeats has a row for each score; other columns may clash."""
    rows = [(i, [1 + i * 1e-9, 0.0], 1, "x", [2.0]) for i in range(30)] + [(7, [1 + 40e-9, 0.0], 1, "x", [2.0]), (7, [1 + 40e-9, 0.0], 1, "x", [2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, shard string, v array<double>")
    found = ann.nearest(df, df.where("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(7, 1 + 40e-9), (29, 1 + 29e-9), (28, 1 + 28e-9), (27, 1 + 27e-9), (26, 1 + 26e-9)]
    many = spark.createDataFrame([(i, [1 + i * 1e-9, 0.0]) for i in range(500)], "vec_id long, embedding array<double>")
    found = ann.nearest(many, many.where("vec_id = 3"), k=20).orderBy("rank")
    assert [r.vec_id for r in found.collect()] == list(range(499, 479, -1))


def test_ann_ranks_before_its_only_shuffle(spark, sf_dir, monkeypatch):
    vectors = table(spark, sf_dir, "embeddings")
    monkeypatch.setattr(ann, "nearest", ann.nearest.__wrapped__)
    with common.scope(spark):
        plan = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), shard_rows=50)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapInArrow")]
    assert after.count("Exchange") == 1 and after.count("WindowGroupLimit") == 2


def test_ann_ties_go_to_the_smaller_id(spark):
    """Vectors of one inner product, more of them than a beam holds; vectors of other lengths take no part."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, *rng.normal(size=4).tolist()]) for i in range(1, 400)] + [(0, [1.0, 0.0, 0.0, 0.0, 0.0]), (-1, [9.0]), (-2, [9.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(df, df.where("vec_id <= 0")).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, i) for i in range(1, 21)]


# --- 2


def brute_components(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


@pytest.mark.parametrize(("short", "block"), [(64, 2048), (2, 4)])
def test_minhash_against_brute_force(spark, monkeypatch, short, block):
    """The second case sends most lists through blocks, several of them."""
    monkeypatch.setattr(minhash, "SHORT_LIST", short)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts: dict[int, str | None] = {900: None, 901: "", 902: "  ", 903: "one two", 904: "One TWO", 905: "one  two\n", 906: "long " * 3000}
    for g in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([20, 90, 250]))]
        for k in range(14):
            own = [rng.choice(vocabulary) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06, 0.1]) else w for w in base]
            texts[g * 20 + k] = " ".join(own) + (" " + " ".join(passage) if k % 2 else "")
    for k in range(30):
        texts[500 + k] = " ".join([*(rng.choice(vocabulary) for _ in range(40)), *passage])
    found = minhash.near_duplicates(made(spark, texts)).collect()
    want = brute_components(texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_minhash_null_ids_repeats_and_empty(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(made(spark, rows)).collect()), key=str)
    assert found == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]
    assert minhash.near_duplicates(made(spark, rows).limit(0)).count() == 0


def test_required_counts_are_safe():
    """Sampled pairs at the threshold hardly ever have fewer common values than required."""
    rng = np.random.default_rng(2)
    for u in (50, 130, 200, 400, 3000):
        need = minhash.needed(np.array([u]), np.array([u]), minhash.K)[0]
        common = math.ceil(0.75 * u)
        low = min((rng.permutation(u)[: minhash.K] < common).sum() for _ in range(300))
        assert need <= low


def test_components_on_chains(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 501), (501, 500), (600, 600), (None, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(101)}, 500: 500, 501: 500, **{i: 1000 for i in range(1000, 1050)}}


def test_small_tables_of_rounds_are_few_files(spark, monkeypatch):
    """A round over few links costs no task and file for every shuffle partition where Spark does not merge these."""
    written = []
    settle = components.settle
    monkeypatch.setattr(components, "settle", lambda *a: written.append(settle(*a)) or written[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = [(7 * i, 7 * i + k) for i in range(200) for k in (1, 2, 3)] + [(7 * i + 3, 7 * i + 7) for i in range(20)]
        found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {7 * i + k: 0 if i <= 20 else 7 * i for i in range(200) for k in range(4)}
    most = 2 * spark.sparkContext.defaultParallelism
    assert len(written) > 2 and all(len(x.inputFiles()) <= most for x in written)


def test_overlaps_against_plain_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 9):
        sets = [np.unique(rng.integers(0, 3000, rng.integers(0, 1500)).astype(np.uint64)) for _ in range(n)]
        rows = np.repeat(np.arange(n), [len(x) for x in sets])
        left, right = np.flatnonzero(rng.random(n) < 0.5), np.flatnonzero(rng.random(n) < 0.7)
        found = minhash._overlaps(np.concatenate([*sets, np.zeros(0, np.uint64)]), rows, left, right, n)
        assert all(found[i, j] == len(np.intersect1d(sets[a], sets[b])) for i, a in enumerate(left) for j, b in enumerate(right) if a != b)


# --- 3


def brute_lines(texts: dict[int, str | None]) -> dict[int, list[int]]:
    lines = [(k, i, frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", line.lower()) if x)) for k in sorted(texts) if texts[k] is not None for i, line in enumerate(texts[k].split("\n"))]
    gone: dict[int, list[int]] = {}
    for at, (k, i, s) in enumerate(lines):
        if s and any(o and len(s & o) * 100 >= len(s | o) * linedup.PERCENT for _, _, o in lines[:at]):
            gone.setdefault(k, []).append(i)
    return gone


def test_linedup_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(120)]
    bases = [[rng.choice(vocabulary) for _ in range(n)] for n in (3, 8, 20, 20, 40, 60)]
    texts: dict[int, str | None] = {}
    for k in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            base = rng.choice(bases)
            lines.append(" ".join(rng.choice(vocabulary) if rng.random() < rng.choice([0, 0, 0.02, 0.05, 0.2]) else w for w in base))
        texts[k] = "\n".join(rng.choice([lines, [*lines, "", "  "]]))
    texts |= {100: None, 101: "", 102: "\n\n", 103: "SAME line\nsame LINE", 104: "a"}
    df = made(spark, texts)
    found = {r.doc_id: list(r.removed) for r in linedup.line_counts(df).where("n_removed > 0").collect()}
    want = brute_lines(texts)
    assert found == want
    kept = {r.doc_id: r for r in linedup.remove_lines(df).collect()}
    assert len(kept) == len(texts) and kept[100].text is None and kept[3].doc == "x"
    for k, t in texts.items():
        if t is not None:
            assert kept[k].text == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want.get(k, []))
    assert linedup.remove_lines(df.limit(0)).count() == 0


def test_linedup_null_and_repeated_ids(spark):
    rows = [(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, "a b c\nd")]
    kept = sorted(((r.doc_id, r.text) for r in linedup.remove_lines(made(spark, rows)).collect()), key=str)
    assert kept == [(1, "a b c"), (1, "a b c"), (2, "d"), (None, "a b c")]


def test_linedup_ids_of_several_texts(spark):
    """Rows of an id that stands for several texts take no part; inner names may be columns of the documents."""
    rows = [(1, "a b c"), (2, "a b c\nd"), (2, "a b c\ne"), (3, "a b c\nf"), (4, "")]
    df = made(spark, rows).withColumn("removed", F.lit(1)).withColumn("lines", F.lit(2))
    kept = linedup.remove_lines(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a b c"), (2, "a b c\nd"), (2, "a b c\ne"), (3, "f"), (4, "")]
    assert {r.doc_id for r in linedup.line_counts(df).collect()} == {1, 3, 4}


def test_linedup_long_text_and_keys(spark):
    """A text of many lines; class keys are two digests of the words, neither of which follows from the other."""
    texts = {1: "\n".join(f"line {i} of many\tlines\x0b{i % 1000}" for i in range(30_000)), 2: "line 7 OF many lines 7\nnew"}
    found = {r.doc_id: (r.n_lines, r.n_removed) for r in linedup.line_counts(made(spark, texts)).collect()}
    assert found == {1: (30_000, 0), 2: (2, 1)}
    rows = linedup.split_lines(spark.createDataFrame(list(texts.items()), "doc long, text string"))
    keys = rows.select("k1", "k2", F.xxhash64(F.lit(7), "k1").alias("x"), F.xxhash64("k1", F.lit(7)).alias("y")).distinct().collect()
    assert len(keys) == len({k.k1 for k in keys}) == len({k.k2 for k in keys}) == 30_001 and not any(k.k2 in (k.x, k.y) for k in keys)


def test_linedup_splits_texts_once(spark):
    """Each text is read once; prefixes hold the words of the fewest lines, by one code for each word, and what they were made of is deleted."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    rare = {k: f"common words of all lines stand in here and rare{k}" for k in range(40)}
    docs = spark.createDataFrame(list(rare.items()), "doc long, text string").withColumn("text", read.asNondeterministic()("text"))
    folder = common.shared_folder(spark, "x").rsplit("/", 1)[0]
    before = set(os.listdir(folder))
    with common.scope(spark):
        lines = linedup.split_lines(docs)
        assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["lines"]
        rows = lines.collect()
    assert seen.value == len(rows) == 40 and set(os.listdir(folder)) == before
    assert all(r.n == 10 and len(r.prefix) == 2 for r in rows)
    assert len({r.prefix[0] for r in rows}) == 40 and not {r.prefix[0] for r in rows} & {r.prefix[1] for r in rows}


# --- 4, 5, 9


def test_langid_against_plain_bayes(spark):
    """Exact n-grams, no hashing: the same posterior, as no two n-grams of these texts share a bucket."""
    rows = [(1, "ab ba", "x"), (2, "ab ab b", "x"), (3, "cb bc", "y"), (4, None, "y"), (5, "zz", None), (6, "ca", "y"), (6, "ca", "y")]
    grams = lambda t: [t.lower()[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)]
    every = sorted({g for _, t, _ in rows if t for g in grams(t)})
    buckets = {g: [b for b, k in zip(*map(list, langid.ngram_counts(g))) if k == 1] for g in every}
    own = {g: {int(b) for b in langid.ngram_counts(g)[0]} - {b for h in every if h != g and h in g for b in langid.ngram_counts(h)[0].tolist()} for g in every}
    assert all(own.values()) and buckets
    counts, texts = {}, {}
    for _, t, lang in rows:
        if t and lang:
            texts[lang] = texts.get(lang, 0) + 1
            for g in grams(t):
                counts.setdefault(lang, {})[g] = counts.setdefault(lang, {}).get(g, 0) + 1
    log = {k: math.log(v / sum(texts.values())) for k, v in texts.items()}
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = ["ab", "bc c", "Ab cb", "b"]
    found = langid.predict(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string").withColumn("lang_pred", F.lit("?")), model).orderBy("doc_id").collect()
    for r, t in zip(found, asked):
        score = {k: log[k] + sum(math.log((c.get(g, 0) + 0.05) / (sum(c.values()) + 0.05 * langid.BUCKETS)) for g in grams(t)) for k, c in counts.items()}
        best = max(score, key=score.get)
        assert r.lang_pred == best and r.score == pytest.approx(1 / sum(math.exp(v - score[best]) for v in score.values()))
    assert langid.predict(made(spark, {}).limit(0), model).count() == 0


def test_langid_scores_do_not_depend_on_room(spark, docs, monkeypatch):
    model = langid.fit(docs)
    texts = [r.text for r in docs.limit(60).collect()]
    whole = model.predict(texts)
    monkeypatch.setattr(langid, "CELLS", 1)
    cut = model.predict(texts)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1])


def test_statistics_against_plain_counts():
    text = "The cat.\n\nA $5 cat cat, the|end...\nextraordinarily"
    words = text.split()
    lines = ["The cat.", "A $5 cat cat, the|end...", "extraordinarily"]
    got = dict(zip(quality.FEATURES, quality.statistics(text)))
    n, size = len(words), len(text)
    want = {
        "log_bytes": math.log(1 + size), "log_words": math.log(1 + n), "log_lines": math.log(4), "word_bytes": sum(map(len, words)) / n,
        "letters": sum(x.isalpha() for x in text) / size, "upper": 2 / size, "digits": 1 / size, "white": sum(x.isspace() for x in text) / size, "high": 0,
        "stops": 4 / size, "commas": 1 / size, "pipes": 1 / size, "symbols": 1 / size, "distinct_words": len(set(words)) / n, "top_word": 1 / n,
        "distinct_lines": 1, "line_words": n / 3, "short_lines": 1, "ended_lines": 2 / 3, "long_words": 1 / n, "symbol_words": 2 / len(set(words)), "repeats": 0,
        "short_words": 2 / n, "ellipses": 1 / n, "braces": 0,
    }
    assert got == pytest.approx(want)


def test_split_choice_against_brute_force():
    """The first split of the first tree has the largest gain of all features and thresholds."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, (80, 3)).astype(float), rng.integers(0, 2, 80).astype(float)
    y[x[:, 1] > 6] = 1
    forest = quality.grow(x, y, trees=1, depth=1, least=5)
    p = y.mean()
    score = lambda rows: sum(p - v for v in y[rows]) ** 2 / (sum(p * (1 - p) for _ in y[rows]) + 1.0)
    gains = {}
    for f in range(3):
        for t in sorted(set(x[:, f]))[:-1]:
            low = x[:, f] <= t
            if 5 <= low.sum() <= 75:
                gains[f, t] = score(low) + score(~low) - score(np.ones(80, bool))
    at = (int(forest.feature[0, 0]), forest.threshold[0, 0])
    same = max(v for (f, t), v in gains.items() if f == at[0] and (x[:, f] <= t).tolist() == (x[:, f] <= at[1]).tolist())
    assert same == pytest.approx(max(gains.values()))


def test_network_against_plain_loops():
    net = toxicity.Network.fresh()
    net.out = np.random.default_rng(1).normal(size=net.out.shape).astype(np.float32)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 2 * toxicity.ROWS, (n, 2)).astype(np.int32) for n in (0, 1, 2, 5, 30)]
    for t, z in zip(texts, net.logits(texts)):
        words = [(net.embedding[a] + net.embedding[b]).tolist() for a, b in t.tolist()]
        want, k = net.shift, 0
        for w, f in zip(toxicity.WIDTHS, net.filters):
            for c in range(toxicity.FILTERS):
                values = [sum(v * float(f[i, c]) for i, v in enumerate(sum(words[p : p + w], []))) for p in range(len(words) - w + 1)]
                want += max([0.0, *values]) * float(net.out[k])
                k += 1
        assert z == pytest.approx(want, abs=1e-4)


def test_threshold_against_brute_force():
    rng = random.Random(8)
    for _ in range(30):
        z = sorted({rng.randint(-20, 20) / 4 for _ in range(12)})
        p, n = [rng.randint(0, 3) for _ in z], [rng.randint(0, 3) for _ in z]
        cut = toxicity.best_threshold(np.array(z), np.array(p), np.array(n))
        f1 = lambda t: 2 * sum(a for v, a in zip(z, p) if v >= t) / max(1, sum(a + b for v, a, b in zip(z, p, n) if v >= t) + sum(p))
        if sum(p) and sum(n):
            assert f1(cut) == pytest.approx(max(f1(t) for t in z))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = q.op9_toxicity(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    right = ((found["predicted"] == 1) & (found["toxic"] == 1)).sum()
    assert right / (found["toxic"] == 1).sum() > 0.6 and right / (found["predicted"] == 1).sum() > 0.85
    assert ((found["score"] >= 0.5).astype(int) == found["predicted"]).all()


def test_classifiers_without_rows(spark, docs):
    labels = table(spark, "/root/testdata/sf0.001", "labels")
    languages = langid.fit(docs)
    net = toxicity.fit(docs, labels.limit(0), languages)
    assert toxicity.score(docs, net, languages).where("score between 0 and 1").count() == docs.count()
    assert toxicity.score(docs.limit(0), net, languages).count() == 0
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0
    clash = docs.withColumn("score", F.lit("x")).withColumn("predicted", F.lit("x")).withColumn("k", F.lit("x")).withColumn("y", F.lit("x"))
    assert quality.score(clash, quality.fit(clash, labels)).columns == ["doc_id", "score", "predicted"]
    assert toxicity.score(clash, toxicity.fit(clash, labels, languages), languages).columns == ["doc_id", "score", "predicted"]


def test_langid_held_out_accuracy(spark, docs):
    found = q.op4_langid(spark, "/root/testdata/sf0.01").join(table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (found["lang_pred"] == found["lang"]).mean() > 0.97
    model = langid.fit(docs)
    best, score = model.predict([None, "", "123 ...", "the and of", "x" * 300_000])
    assert best[:3] == ["und"] * 3 and list(score[:3]) == [0, 0, 0] and best[3] in model.languages and 0 < score[3] <= 1
    assert langid.fit(docs.limit(0)).predict(["abc"])[0] == ["und"]
    labelled = langid.label(docs, model)
    assert labelled.columns == [*docs.columns, "lang_pred", "lang_score"] and labelled.count() == docs.count()


def test_ngrams_do_not_depend_on_steps(monkeypatch):
    text = "Größe und Maß, été à Noël. " * 40
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "STEP", 17)
    cut = langid.ngram_counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def auc(score: pd.Series, y: pd.Series) -> float:
    ranks = score.rank()
    return (ranks[y == 1].mean() - ranks[y == 0].mean()) / len(y) + 0.5


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = q.op5_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert auc(found["score"], found["quality"]) > 0.95
    assert ((found["score"] >= 0.3).astype(int) == found["predicted"]).all() and found["score"].between(0, 1).all()
    assert quality.statistics(None) == quality.statistics("") == [0.0] * len(quality.FEATURES)
    assert len(quality.statistics("a")) == len(quality.FEATURES)
    empty = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels").limit(0))
    assert quality.score(made(spark, {1: None, 2: "a b"}), empty).count() == 2


def test_forest_equals_recursion():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.grow(x, y, trees=20)

    def walk(t: int, row: np.ndarray, k: int = 0) -> float:
        if forest.left[t, k] == k:
            return forest.value[t, k]
        return walk(t, row, forest.left[t, k] if row[forest.feature[t, k]] <= forest.threshold[t, k] else forest.right[t, k])

    assert np.allclose(forest.margin(x[:20]), [forest.base + sum(walk(t, r) for t in range(20)) for r in x[:20]])
    assert auc(pd.Series(forest.score(x)), pd.Series(y)) > 0.97


def test_toxicity_learns_and_calibrates(spark, docs):
    rng = random.Random(1)
    neutral = [f"n{i}" for i in range(300)]
    texts, marks = {}, {}
    for k in range(600):
        own = [rng.choice(neutral) for _ in range(rng.randint(5, 80))]
        marks[k] = int(k % 4 == 0)
        if marks[k]:
            own[rng.randrange(len(own))] = rng.choice(["vileword", "vilewords", "nastyone"])
        texts[k] = " ".join(own)
    texts |= {1000: None, 1001: "", 1002: "vileword " * 40_000}
    languages = langid.fit(docs)
    labels = spark.createDataFrame([(k, v) for k, v in marks.items()], "doc_id long, toxic int")
    df = made(spark, texts)
    net = toxicity.fit(df, labels.where(~held_out()), languages)
    found = toxicity.score(df, net, languages).join(labels, "doc_id", "left").withColumn("held_out", held_out()).toPandas().set_index("doc_id")
    test = found[found["held_out"] & found["toxic"].notna()]
    assert (test["predicted"] == test["toxic"]).mean() > 0.95
    assert found.loc[1002, "predicted"] == 1 and found.loc[1000, "score"] == found.loc[1001, "score"] and found["score"].between(0, 1).all()


def test_pooling_does_not_depend_on_steps(monkeypatch):
    net = toxicity.Network.fresh()
    net.bias = [b + 0.1 for b in net.bias]
    rows = np.random.default_rng(0).integers(0, toxicity.ROWS, (500, 2)).astype(np.int32)
    whole = net.pooled(rows)
    monkeypatch.setattr(toxicity, "STEP", 37)
    cut = net.pooled(rows)
    assert np.allclose(whole[0], cut[0], atol=1e-5) and (whole[1] == cut[1]).all()


# --- 6


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = q.tokenizer_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(0)
    odd = [chr(x) for x in [*range(0x250), 0x1680, *range(0x2000, 0x2070), 0x3000, 0xFEFF, 0x1F600, 0x660, 0xBD, 0x5D0, 0x4E00]] + ["<|endoftext|>", "'s", "'ll", " ", "  ", "ab"] * 15
    texts = dict(enumerate("".join(rng.choices(odd, k=rng.randint(0, 40))) for _ in range(400)))
    texts |= {1000: None, 1001: "", 1002: "ab" * 6000, 1003: "the " * 80_000, 1004: " " * 5000}
    found = {r.doc_id: r for r in bpe.round_trip(made(spark, texts).union(made(spark, {5000: "x"})), path).collect()}
    for k, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[k].n_tokens == len(ids)
        assert found[k].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(docs, path), path)
    assert back.where("decoded <> text").count() == 0 and back.count() == docs.count()
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_bpe_vocabulary_is_small_and_merges_long_words_alike(docs):
    path = q.tokenizer_path()
    tracemalloc.start()
    try:
        v = bpe.Vocabulary(path)
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 12 << 20  # each worker holds it
    rng = random.Random(3)
    found = {w for r in docs.select("text").collect() for w in v.words(r.text)} | {"".join(rng.choices("aeinst é一", k=rng.randint(1, 200))) for _ in range(500)}
    assert all(v._encode_long(w) == v.encode_word(w) for w in (x.encode() for x in found))


# --- 7


def test_warc_round_trip_with_edges(spark, tmp_path):
    pages = [(1, "u1", "same"), (2, "u\r\n2", "same"), (3, None, None), (4, "u4", ""), (5, "u5", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (6, "u6", "é" * 50_000), (7, "u7", "same"), (None, "u", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("refers_to", F.lit(1)).withColumn("n", F.lit("x"))
    warc.write_warc(warc.mark_revisits(df), f"{tmp_path}/a", file_records=2)
    found = warc.read_warc(spark, f"{tmp_path}/a").withColumn("page", warc.page_of(F.col("record_id"))).collect()
    assert all(r.kind != "gap" for r in found) and len(found) == len(pages)
    by = {r.page: r for r in found}
    for k, _, t in pages:
        data = (t or "").encode()
        assert by[k].payload_bytes == len(data) and by[k].payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
    assert {k: r.refers_to for k, r in by.items() if r.kind == "revisit"} == {1: "<urn:page:7>", 2: "<urn:page:7>", 3: "<urn:page:4>"}
    assert bytes(by[5].payload) == pages[4][2].encode()
    warc.write_warc(warc.mark_revisits(df), f"{tmp_path}/z", compression="gzip")
    assert {(r.record_id, r.kind, r.payload_digest) for r in warc.read_warc(spark, f"{tmp_path}/z").collect()} == {(r.record_id, r.kind, r.payload_digest) for r in found}
    warc.write_warc(warc.mark_revisits(df.limit(0)), f"{tmp_path}/none")
    assert warc.read_warc(spark, f"{tmp_path}/none").count() == 0
    long_only = warc.mark_revisits(df, least_bytes=10).where("refers_to is not null").count()
    assert long_only == 0


def member(kind: str, body: bytes, digest: bool = True) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    told = f"WARC-Payload-Digest: sha1:{warc.base32(body)}\r\n" if digest else ""
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{told}Content-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"


def salvaged(data: bytes, step: int = 7) -> list[warc.Record]:
    return list(warc.salvage(iter([data[i : i + step] for i in range(0, len(data), step)])))


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_salvage_reader(step):
    a, b, c = (member("response", x * 20) for x in (b"one", b"two", b"three"))
    assert [r.payload for r in salvaged(a + b + c, step)] == [b"one" * 20, b"two" * 20, b"three" * 20]
    broken = b[:60] + b"#" + b[61:]
    for damaged in (a + b[:-30] + c, a + b"junk" * 9 + c, a + b.replace(b"twotwo", b"tw0two", 1) + c, a + broken + c):
        got = salvaged(damaged, step)
        kinds = [r.kind for r in got]
        assert kinds == ["response", "gap", "response"] or damaged == a + broken + c
        assert got[0].payload == b"one" * 20 and got[-1].payload == b"three" * 20
        assert sum(r.size for r in got if r.kind == "gap") == len(damaged) - len(a) - len(c) or damaged == a + broken + c
    z = [gzip.compress(x) for x in (a, b, c)]
    assert [(r.payload, r.offset) for r in salvaged(b"".join(z), step)] == [(b"one" * 20, 0), (b"two" * 20, len(z[0])), (b"three" * 20, len(z[0] + z[1]))]
    bad = z[1][:20] + bytes([z[1][20] ^ 0xFF]) + z[1][21:]
    got = salvaged(z[0] + bad + z[2], step)
    assert [r.kind for r in got] == ["response", "gap", "response"] and got[1].size == len(bad)
    assert [r.kind for r in salvaged(z[0] + z[1][:15], step)] == ["response", "gap"]
    assert [r.kind for r in salvaged(b"xx" + z[0] + a + z[2], step)] == ["gap", "response", "response", "response"]
    assert salvaged(b"", step) == []


def test_salvage_of_one_damaged_member():
    """Records that came out before the damage are given, also if only the member's own check fails."""
    bodies = [hashlib.sha256(str(i).encode()).digest() * 40 for i in range(300)]
    whole = gzip.compress(b"".join(member("response", x) for x in bodies))
    cut = salvaged(whole[: len(whole) // 2], 1000)
    assert [r.kind for r in cut][-1] == "gap" and 50 < len(cut) < 250 and [r.payload for r in cut[:-1]] == bodies[: len(cut) - 1]
    wrong = salvaged(whole[:-8] + bytes(8), 1000)
    assert [r.payload for r in wrong[:-1]] == bodies and wrong[-1].kind == "gap" and wrong[-1].size == len(whole)


def test_salvage_is_linear_in_members():
    """Twice the members take about twice the time, not four times; a window holds no more than a few records."""
    import time

    def seconds(n):
        data = b"".join(gzip.compress(member("response", b"x" * 2000)) for _ in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in warc.salvage(iter([data[i : i + (1 << 20)] for i in range(0, len(data), 1 << 20)]))) == n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 10 * seconds(4_000) + 0.5


# --- 8


def test_chat_formatting(spark):
    t = lambda *turns: [{"role": r, "text": x} for r, x in turns]
    rows = [
        (1, t(("user", "a"), ("assistant", "b")), t(("user", "a"), ("assistant", "c"))), (2, t(("user", "a")), t(("user", "a"))), (3, None, t(("assistant", "x"))),
        (4, t(("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "dd")), t(("user", "a"), ("assistant", "b"))), (5, [], []),
    ]
    df = spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>").withColumn("prompt", F.lit(1))
    found = {r.pair_id: r for r in chat.format_preferences(df).collect()}
    one = found[1]
    assert one.n_prompt_turns == 1 and one.prompt == "<|im_start|>user\na<|im_end|>\n" and one.chosen == "<|im_start|>assistant\nb<|im_end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_mask] == ["b<|im_end|>"] and [one.rejected[s.start : s.end] for s in one.rejected_mask] == ["c<|im_end|>"]
    assert found[2].n_prompt_turns == 1 and found[2].chosen == found[2].rejected == "" and found[2].chosen_mask == []
    assert found[3].n_prompt_turns == 0 and found[3].chosen == "" and found[3].rejected
    assert found[4].n_prompt_turns == 2 and [found[4].chosen[s.start : s.end] for s in found[4].chosen_mask] == ["dd<|im_end|>"] and found[4].rejected == ""
    assert found[5].n_prompt_turns == 0 and found[5].prompt == ""
    turns = spark.createDataFrame([(1, 0, None, None), (1, 1, "assistant", "x"), (None, 0, "user", "y")], "conv_id long, turn long, role string, text string")
    assert [len(r.chosen) for r in chat.echo_pairs(turns).collect()] == [2]
    assert chat.echo_pairs(turns.limit(0)).count() == 0


def test_chat_of_long_conversations_and_markers(spark):
    turns = spark.range(4000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), "id").alias("text"))
    row = chat.format_preferences(chat.echo_pairs(turns), "conv_id").first()
    assert row.n_prompt_turns == 3999 and row.prompt.count(chat.CLOSE) == 3999 and row.chosen == "<|im_start|>assistant\ntext 3999<|im_end|>\n" and "text 3998" in row.rejected
    odd = spark.createDataFrame([(1, [{"role": "user", "text": "a<|im_end|>"}]), (2, [{"role": "user", "text": "a"}]), (3, [])], "id long, t array<struct<role:string,text:string>>")
    assert [r[0] for r in odd.orderBy("id").select(chat.has_markers(F.col("t"))).collect()] == [True, False, False]


# --- 10


def test_decontamination(spark):
    item = "The train left Paris at 12 with Anna Smith on board and reached the coast after 30 miles of slow and careful travel today"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short"), (None, item)], "item_id long, text string")
    filler = "some other words that have nothing to do with it at all in any way. "
    swapped = item.replace("12", "19").replace("30", "77").replace("Paris", "Rome")
    texts = {
        1: filler + item + " " + filler, 2: filler + swapped, 3: filler * 3, 4: None, 5: "", 6: filler + item.replace("12 with Anna", "12 with Bob").replace("train left", "bus quit"),
        7: item[:40] + " " + filler, 8: (filler * 5000) + item.upper().replace("ANNA SMITH", "Anna Smith").replace("PARIS", "Paris"), 9: item.replace(" ", "\n"),
    }
    found = {(r.doc_id, r.item_id): r.reparameterised for r in decontam.contaminated(made(spark, texts), bench).collect()}
    assert found[(1, 1)] is False and found[(2, 1)] is True and found[(9, 1)] is False
    assert not {3, 4, 5, 7} & {d for d, _ in found}
    kept = {r.doc_id for r in decontam.remove_contaminated(made(spark, texts), bench).collect()}
    assert {3, 4, 5, 7} <= kept and not {1, 2, 9} & kept
    assert decontam.contaminated(made(spark, texts).limit(0), bench).count() == 0 and decontam.contaminated(made(spark, texts), bench.limit(0)).count() == 0


def test_slots_must_be_consistent(spark):
    item = "if 5 boys share one red apple then 5 boys and their mother eat it at home on this day"
    good, bad = item.replace("5", "8"), item.replace("5", "8", 1)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = {r.doc_id for r in decontam.contaminated(made(spark, {1: good, 2: bad, 3: item}), bench).collect()}
    assert found == {1, 3}


def test_number_words_of_four_languages(spark):
    items = {1: "Ein Zug fährt zwei Stunden lang mit der ganzen Familie durch das weite Land und hält dann an", 2: "le petit train roule pendant trois heures avec toute la famille dans le grand pays vert"}
    texts = {1: items[1].replace("zwei Stunden", "fünf Tage"), 2: items[2].replace("trois heures", "deux jours"), 3: items[2].replace("trois heures", "la nuit").replace("famille", "ville").replace("train", "chat")}
    found = decontam.contaminated(made(spark, texts), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.reparameterised) for r in found} == {(1, 1, True), (2, 2, True)}


def test_items_without_a_window(spark):
    items = {
        1: "A train travels 60 km in 2 hours", 2: "What is the capital of Zorland?", 3: "The quick otters swim across muddy rivers daily", 4: "...",
        5: "60 km 2 hours 60 km 2 hours 5 days 7 weeks", 6: "5 boys and 5 girls", 7: "", 8: "10 cm 20 cm 30 cm 40 cm 50 cm is the length of 60 cm 70 cm",
    }
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    texts = {
        1: "we read that A train travels 60 km in 2 hours, and more", 2: "so a train travels 80 km in 3 hours", 3: "say what is the capital of zorland, please", 4: "and The quick otters swim across muddy rivers daily too",
        5: "it was 60 km 2 hours 60 km 2 hours 5 days 7 weeks", 6: "8 boys and 8 girls", 7: "8 boys and 9 girls", 8: "it was 70 km 2 hours 60 km 2 hours 5 days 7 weeks", 9: "...", 10: "",
        11: "x 11 cm 20 cm 30 cm 40 cm 50 cm is the length of 60 cm 70 cm", 12: "x 11 cm 20 cm 30 cm 40 cm 50 cm is the length of 60 cm 71 mm", 13: "a train", 14: None, 15: "is the length of 60",
    }
    rows = decontam.contaminated(made(spark, texts), bench).collect()
    found = {(r.doc_id, r.item_id): r.reparameterised for r in rows}
    assert len(rows) == len(found) and all(r.n_windows == r.item_windows == 1 for r in rows)
    assert found == {(1, 1): False, (2, 1): True, (3, 2): False, (4, 3): False, (5, 5): False, (6, 6): True, (11, 8): True}


def test_held_out_fold(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_workers_get_texts_in_small_batches(spark):
    df = spark.range(6000, numPartitions=1).select("id", F.repeat(F.lit("0123456789abcdef"), 500).alias("t"))  # 48 MB

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    with scope(spark):
        found = settle(df.mapInArrow(sizes, "n long, size long"), "sizes").collect()
    assert sum(r.n for r in found) == 6000
    assert max(r.n for r in found) <= 2048
    assert max(r["size"] for r in found) < 5 << 20
