"""The pipeline against a plain model of its stages, run in order over a sample of the documents table."""

from __future__ import annotations

import hashlib
import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidecue.llm import decontam, linedup
from tidecue.llm import queries as q
from tidecue.llm.common import BATCHES, held_out, shared_folder, table
from test_llm import brute_components, brute_lines


def plain_template(words: list[str], i: int) -> str:
    w = words[i]
    p = w.rstrip(".,;:!?\"')").lower()
    if p in decontam.UNITS:
        return "<unit>"
    if p in decontam.NUMBER_WORDS or w[:1] < ":" and re.fullmatch(r"[-+$]?[0-9][0-9.,]*(%|st|nd|rd|th)?", p):
        return "<number>"
    if "A" <= w[:1] <= "Z" and i and not re.search(r"[.!?:]$", words[i - 1]) and re.fullmatch(r"[A-Z][a-z]+[.,;:!?\"')]*", w):
        return "<name>"
    return p


def brute_leaks(texts: dict[int, str], items: dict[int, str]) -> set[int]:
    """Documents that hold an item; slots are not checked, since the items of the tables have none."""
    def windows(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        t = [plain_template(words, i) for i in range(len(words))]
        return [tuple(t[i : i + decontam.WINDOW]) for i in range(len(t) - decontam.WINDOW + 1)]

    kept = {k: {i: w for i, w in enumerate(windows(t)) if sum(not x.startswith("<") for x in w) >= decontam.LITERALS} for k, t in items.items()}
    out = set()
    for d, text in texts.items():
        own = set(windows(text))
        if any(w and sum(x in own for x in w.values()) >= len(w) * decontam.SHARE for w in kept.values()):
            out.add(d)
    return out


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema) if stage is not corpus_pipeline.STAGES[-1][1] else docs
        results.append(docs)
    return results


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_stay(stages):
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_language_keeps_clean_documents(spark, stages):
    before, after = stages[0], stages[1]
    assert set(texts(after)) <= set(texts(before))
    gone = set(texts(before)) - set(texts(after))
    assert len(gone) <= 0.02 * before.count()
    joined = after.join(before.select("doc_id", F.col("lang").alias("told")), "doc_id").where(held_out()).select((F.col("lang") == F.col("told")).cast("int").alias("ok"))
    assert joined.agg(F.avg("ok")).first()[0] > 0.95


def test_lines(stages):
    before, after = texts(stages[1]), texts(stages[2])
    gone = brute_lines(before)
    want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, [])) for k, t in before.items()}
    assert after == {k: t for k, t in want.items() if re.search(r"[^\x20\x09-\x0D]", t)}
    assert stages[2].where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_copies(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert after == {k: before[k] for k, (_, c) in brute_components(before).items() if c == k}


def test_leaks(spark, sf_dir, stages):
    before, after = texts(stages[3]), texts(stages[4])
    items = {r.item_id: r.text for r in table(spark, sf_dir, "benchmark").collect()}
    assert set(before) - set(after) == brute_leaks(before, items)


def test_tokens(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(q.tokenizer_path())
    before = texts(stages[4])
    found = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in stages[5].collect()}
    for k, t in before.items():
        ids = library.encode(t, add_special_tokens=False).ids
        assert found[k] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert len(found) == len(before)


def test_percent_is_stated():
    assert linedup.PERCENT == 90 and [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "leaks", "tokens"]


def test_run_leaves_only_what_its_result_reads(spark, sf_dir):
    folder = shared_folder(spark, "x").rsplit("/", 1)[0]
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["leaks"]


@pytest.mark.parametrize("stage", [corpus_pipeline.language, corpus_pipeline.tokens])
@pytest.mark.parametrize("own", [None, "300"])
def test_stages_that_run_later_get_small_batches(spark, sf_dir, stage, own):
    docs = table(spark, sf_dir, "documents").limit(3).select(F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("doc_id"), F.repeat(F.lit("0123456789abcdef"), 500).alias("text"), "lang", "source", "n_chars").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    for key in BATCHES:
        spark.conf.unset(key)
    records = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if own:
        spark.conf.set(records, own)
    try:
        stage(spark, docs, sf_dir)
        found = docs.mapInArrow(sizes, "n long, size long").collect()  # 48 MB, as what the stage returned would get it
        assert sum(r.n for r in found) == 6000
        assert max(r.n for r in found) <= int(own or 2048)
        assert max(r["size"] for r in found) < 5 << 20
    finally:
        for key in BATCHES:
            spark.conf.unset(key)
