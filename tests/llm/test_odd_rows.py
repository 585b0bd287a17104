"""Repeated rows, null ids, ties and very long texts of operators whose other tests do not hold them."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecue.llm import chat, decontam, langid, quality, toxicity, warc
from tidecue.llm.common import held_out, table

TEXTS = "doc_id long, text string, k string, t string, y int"  # all but two clash with inner names
GOOD = "The committee met on Tuesday and agreed on a careful plan for the library. Its members thanked the staff."
BAD = "buy buy buy !!! click here $$$ now now now"


def made(spark, rows):
    return spark.createDataFrame([(k, t, "a", "b", 7) for k, t in rows], TEXTS)


@pytest.fixture(scope="module")
def learned(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out())
    return docs, labels, langid.fit(docs.where(~held_out()))


def odd(spark, docs, labels):
    """The tables with rows that no fit may learn from: null ids on both sides, null labels, ids without a document."""
    extra = spark.createDataFrame([(None, 1, 1), (None, 0, 0), (10**9, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(None, GOOD), (None, None)], "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(nulls), labels.select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")).unionByName(extra)


def test_quality_of_odd_rows(spark, learned):
    docs, labels, _ = learned
    forest = quality.fit(docs, labels)
    again = quality.fit(*odd(spark, docs, labels))
    rows = [(1, GOOD), (1, GOOD), (1, BAD), (None, GOOD), (None, None), (2, ""), (3, None)]
    score = lambda f: sorted((repr(r.doc_id), r.score, r.predicted) for r in quality.score(made(spark, rows), f).collect())
    found = score(forest)
    assert len(found) == len(rows) and found == score(again)  # rows without id or label teach nothing
    by = [(k, s) for k, s, _ in found]
    plain = {t: float(forest.score(np.array([quality.statistics(t)], float))[0]) for t in (GOOD, BAD, "", None)}
    assert sorted(by) == sorted((repr(k), plain[t]) for k, t in rows) and plain[""] == plain[None]


def test_quality_of_a_text_of_many_megabytes(spark, learned):
    docs, labels, _ = learned
    forest = quality.fit(docs, labels)
    long = (GOOD + "\n") * 60_000
    (row,) = quality.score(made(spark, [(1, long)]), forest).collect()
    assert 0 <= row.score <= 1
    assert row.score == float(forest.score(np.array([quality.statistics(long)], float))[0])


def test_toxicity_of_odd_rows(spark, learned):
    docs, labels, languages = learned
    net = toxicity.fit(docs, labels, languages)
    again = toxicity.fit(*odd(spark, docs, labels), languages)
    rows = [(1, GOOD), (1, GOOD), (1, BAD), (None, GOOD), (None, None), (2, ""), (3, None)]
    score = lambda n: sorted((repr(r.doc_id), round(r.score, 5), r.predicted) for r in toxicity.score(made(spark, rows), n, languages).collect())
    found = score(net)
    assert found == score(again)  # rows without id or label teach nothing
    of = lambda key: [x[1] for x in found if x[0] == key]
    good, empty = max(set(of("1")), key=of("1").count), of("2")[0]
    assert of("1").count(good) == 2 and len(of("1")) == 3
    assert sorted(of("None")) == sorted([good, empty]) and of("3") == [empty]


def test_decontamination_of_odd_rows(spark):
    rng = random.Random(1)
    item = " ".join(f"word{rng.randrange(500)}" for _ in range(24))
    clean = " ".join(f"other{rng.randrange(500)}" for _ in range(60))
    rows = [(1, f"{clean} {item} {clean}")] * 2 + [(1, clean), (2, clean), (2, clean), (None, item), (None, clean), (3, None), (4, "")]
    benchmark = spark.createDataFrame([(9, item), (9, item), (None, item), (8, None), (7, "")], "item_id long, text string")
    found = decontam.contaminated(made(spark, rows), benchmark)
    assert {(r.doc_id, r.item_id) for r in found.collect() if r.item_id is not None} == {(1, 9)}
    kept = decontam.remove_contaminated(made(spark, rows), benchmark)
    assert kept.columns == ["doc_id", "text", "k", "t", "y"]
    # an id stands for all its rows; a row without id is in no report and stays
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(["2", "2", "None", "None", "3", "4"])


def test_archives_of_rows_repeated_with_the_largest_key(spark, tmp_path):
    pages = [(1, "u", "same"), (5, "u", "same"), (5, "v", "same"), (None, "w", "same"), (2, "x", ""), (3, "y", None), (4, "z", "own"), (None, "q", "alone")]
    marked = warc.mark_revisits(spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload_bytes int"))
    found = sorted(((r.page_id, r.url, r.refers_to) for r in marked.collect()), key=repr)
    assert found == sorted([(1, "u", 5), (5, "u", None), (5, "v", None), (None, "w", 5), (2, "x", 3), (3, "y", None), (4, "z", None), (None, "q", None)], key=repr)
    warc.write_warc(marked, f"{tmp_path}/warc")
    back = warc.read_warc(spark, f"{tmp_path}/warc")
    assert sorted(r.kind for r in back.collect()) == ["response"] * 5 + ["revisit"] * 3


def test_preferences_of_repeated_turns(spark):
    """Turns that repeat a number stand in order of role and text; a conversation that is told twice doubles its turns."""
    turns = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (2, None, "user", None), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*t, "n") for t in turns], "conv_id long, turn int, role string, text string, turns string")
    found = {r.conv_id: r for r in chat.format_preferences(chat.echo_pairs(df), "conv_id").collect()}
    assert set(found) == {1, 2}
    assert found[1].n_prompt_turns == 3 or found[1].rejected == ""
    told = lambda *own: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in own)
    whole = found[1].prompt + found[1].chosen
    assert whole == told(("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "c"))
    assert (found[2].prompt, found[2].chosen, found[2].rejected) == (told(("user", "")), "", "")
