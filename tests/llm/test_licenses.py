"""License scans against brute force: phrases by a search through words, notices by planted alterations."""

from __future__ import annotations

import random
import re

import pytest

from compare import connect, rows_in, rows_of
from tidecue.llm import licenses
from tidecue.llm import queries as q

SCHEMA = "doc_id long, text string, k string, t string, r1 long, found string, spans int"  # all but two clash with inner names
NOTICE = dict((label, text) for label, text in licenses.NOTICES)


def made(spark, rows):
    return spark.createDataFrame([(k, t, "a", "b", 1, "c", 2) for k, t in rows], SCHEMA)


def words_of(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def spans(spark, text, known=None):
    (row,) = licenses.scan(made(spark, [(1, text)]), known=known).collect()
    assert row.n_words == len(words_of(text))
    return [tuple(s) for s in row.spans]


def labels(spark, text):
    return sorted({s[3] for s in spans(spark, text)})


def brute_phrases(text):
    words, out = words_of(text), []
    for kind, label, phrase in licenses.templates():
        own = phrase.split()
        if kind != "notice":
            out += [(i, i + len(own), kind, label, len(own), 1.0) for i in range(len(words)) if words[i : i + len(own)] == own]
    return sorted(out)


@pytest.mark.parametrize("chunk", [3, licenses.CHUNK])
def test_phrases_equal_a_search(spark, monkeypatch, chunk):
    """All places, also such that overlap, stand at either end, or are cut by a chunk; separators of all kinds."""
    monkeypatch.setattr(licenses, "CHUNK", chunk)
    rng = random.Random(2)
    bag = "gnu general public license apache cc by nc mit lesser mozilla bsd 2 3 clause é".split()
    texts = ["".join(rng.choice([w, w.upper()]) + rng.choice([" ", "\n", ", ", "-", "\x00", "_"]) for w in rng.choices(bag, k=rng.randrange(60))) for _ in range(150)]
    texts += ["CC BY CC BY CC BY", "mit license", "MIT", "", None, "mitlicense mit  license", "éapache license", "apache licenseé apache license"]
    found = {r.doc_id: (r.n_words, [tuple(s) for s in r.spans]) for r in licenses.scan(made(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert found[i] == (len(words_of(t)), [s for s in brute_phrases(t)]), t
    assert sum(len(s) for _, s in found.values()) > 50


def test_each_notice_is_found_alone_and_altered(spark):
    """Whole, in capitals, with words put in, left out and replaced, within other text; never under another license's name."""
    rows, altered_words = [], {}
    for label in NOTICE:
        own = words_of(NOTICE[label])
        rng = random.Random(label)
        altered = list(own)
        for _ in range(len(own) // 12):
            k = rng.randrange(len(altered))
            altered[k : k + 1] = rng.choice([[], ["other"], [altered[k], "more", "words"]])
        around = [f"w{rng.randrange(50)}" for _ in range(40)]
        altered_words[label] = len(altered)
        rows += [NOTICE[label], NOTICE[label].upper(), " ".join(around + altered + around), " ".join(own[: len(own) // 2])]
    found = {r.doc_id: [s for s in r.spans if s["kind"] == "notice"] for r in licenses.scan(made(spark, list(enumerate(rows)))).collect()}
    for i, label in enumerate(NOTICE):
        whole, capitals, within, half = (found[4 * i + k] for k in range(4))
        assert [(s["start"], s["end"], s["label"], s["share"]) for s in whole] == [(0, len(words_of(NOTICE[label])), label, 1.0)]
        assert capitals == whole
        (s,) = within
        assert s["label"] == label and s["share"] >= 0.75 and abs(s["start"] - 40) < 8 and abs(s["end"] - 40 - altered_words[label]) < 8
        assert half == []  # half of it is not the license


def test_repeated_and_shuffled_notices(spark):
    text = NOTICE["isc"]
    n = len(words_of(text))
    assert [(s[0], s[1]) for s in spans(spark, f"{text} {text} x {text}") if s[2] == "notice"] == [(0, n), (n, 2 * n), (2 * n + 1, 3 * n + 1)]
    mixed = words_of(text)
    random.Random(1).shuffle(mixed)
    assert [s for s in spans(spark, " ".join(mixed)) if s[2] == "notice"] == []


def test_the_better_of_two_like_notices_stays(spark):
    assert labels(spark, NOTICE["gpl"]) == ["gpl"]
    assert labels(spark, NOTICE["agpl"]) == ["agpl"]
    assert labels(spark, NOTICE["lgpl"] + " " + NOTICE["gpl"]) == ["gpl", "lgpl"]
    assert labels(spark, "Licensed under CC BY-NC 4.0.") == ["cc-by", "cc-by-nc"]  # a base phrase stays


def test_odd_rows(spark):
    text = "Released under the MIT License."
    rows = [(1, text), (1, text), (1, "apache license"), (None, text), (None, None), (2, ""), (3, "\x00 ,;")]
    found = sorted(((r.doc_id, r.n_words, [s["label"] for s in r.spans]) for r in licenses.scan(made(spark, rows)).collect()), key=repr)
    assert found == sorted([(1, 5, ["mit"]), (1, 5, ["mit"]), (1, 2, ["apache"]), (None, 5, ["mit"]), (None, 0, []), (2, 0, []), (3, 0, [])], key=repr)
    assert licenses.scan(made(spark, [])).collect() == []
    with pytest.raises(ValueError, match="2 words"):
        licenses.scan(made(spark, rows), known=[("phrase", "x", "one")])


def test_long_texts_and_shuffled_candidates(spark, monkeypatch):
    """Candidates beyond the broadcast bound give the same rows."""
    filler = " ".join(f"w{i % 997}" for i in range(200_000))
    rows = [(i, f"{filler} {NOTICE['mit']} {filler} apache license" if i == 7 else f"mit license {i}") for i in range(20)]
    expected = rows_of(licenses.scan(made(spark, rows)))
    monkeypatch.setattr(licenses, "BROADCAST_ROWS", 3)
    assert rows_of(licenses.scan(made(spark, rows))) == expected
    (long,) = [dict(zip(("doc_id", "n_words", "spans"), r, strict=True)) for r in expected if r[0] == 7]
    assert [(s[0], s[3]) for s in long["spans"]] == [(200_000, "mit"), (400_000 + len(words_of(NOTICE["mit"])), "apache")]


def test_query_and_sql_with_notices(spark, tmp_path):
    """The tables hold short lines only; here the SQL meets whole and altered notices as well."""
    rng = random.Random(4)
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            _, _, text = rng.choice(licenses.templates())
            own = [w for w in words_of(text) if rng.random() > 0.05]
            words += own[: rng.randrange(len(own) + 1)] if rng.random() < 0.3 else own
            words += ["x"] * rng.randrange(3)
        rows.append((i, " ".join(words)))
    made(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    columns, expected = rows_in(connect(str(tmp_path)), q.OP11_SQL)
    df = q.op11_licenses(spark, str(tmp_path))
    assert sorted(df.columns) == columns and rows_of(df) == expected
    assert len({r[columns.index("labels")] for r in expected}) > 10
