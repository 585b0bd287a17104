"""License scans by diagonal voting against templates of license texts.

A template is a short phrase that counts where its words stand consecutively, or a longer notice that may be altered a
little. A document's words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case.

1. The hashes of all stretches of ``PHRASE`` and of ``GRAM`` words of every document, rolled over whole texts, are
   joined with those of the templates: phrases are found by the former, notices by the latter.
2. A meeting of place p in a document with place t of a template is a vote for the diagonal p - t. Votes are counted
   by diagonal, in part before the shuffle. Grams that meet nothing leave no row, so what is shuffled follows the
   licenses of a corpus and not its words.
3. Neighbouring diagonals of a notice, up to ``gap`` apart, are merged: words put in or left out shift what follows
   from one diagonal to the next. A group that has votes for ``VOTES`` % of the template's grams is a candidate, as is
   a diagonal with all grams of a phrase.
4. Candidates are verified on the words of the document: a word of the template is matched if it stands on one of the
   group's diagonals. Phrases need all their words on one diagonal, notices ``LEAST`` % of them. Where notices of
   different labels overlap, the one with more matched words stays, then that with the larger share: a notice that
   differs from another by one word holds most of that one too.

Only candidates' texts are read a second time. Texts are not shuffled unless candidates are too many to be broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecue.llm.common import counted, settle, slices, tidy
from tidecue.llm.words import MARKS, grams, word_hashes

PHRASE = 2
GRAM = 4
VOTES = 25
LEAST = 75
#: Places whose grams are sent to Spark as one row.
CHUNK = 1 << 15
#: Grams of templates and diagonals of candidates that may be broadcast; beyond it, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WORD = SEPARATORS.replace("[", "[^", 1)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPANS = "array<struct<start:int,end:int,kind:string,label:string,matched:int,share:double>>"

#: (label, phrase): fixed values.
BASE = [("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license")]

#: (label, phrase) beside these.
PHRASES = [
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("bsd", "bsd license"),
    ("bsd", "bsd 2 clause"),
    ("bsd", "bsd 3 clause"),
    ("isc", "isc license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "cc0 1 0"),
]

#: (label, notice): what the licenses ask to put into files, or their first sentences.
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def templates() -> list[tuple[str, str, str]]:
    """(kind, label, text); kinds are base, phrase and notice."""
    return [(kind, label, text) for kind, own in (("base", BASE), ("phrase", PHRASES), ("notice", NOTICES)) for label, text in own]


def plain_words(text: str) -> list[str]:
    """The words of a template."""
    return "".join(x if x > "\x7f" else " " if MARKS[ord(x)] else x.lower() for x in text).split()


class Templates:
    """Templates as a constant for Spark's expressions, and their grams (gram, template, place) as a table."""

    def __init__(self, spark: SparkSession, known: list[tuple[str, str, str]]):
        rows, places = [], []
        for i, (kind, label, text) in enumerate(known):
            width = GRAM if kind == "notice" else PHRASE
            words = plain_words(text)
            if len(words) < width:
                raise ValueError(f"a {kind} has {width} words at least: {text!r}")
            found = grams(word_hashes([text], MARKS)[0], width).view(np.int64).tolist()
            votes, gap = (-(-len(found) * VOTES // 100), min(8, len(words) // 4)) if kind == "notice" else (len(found), 0)
            rows.append({"kind": kind, "label": label, "words": words, "gap": gap, "votes": votes})
            places += [(g, i, k) for k, g in enumerate(found)]
        self.all = F.from_json(F.lit(json.dumps(rows)), "array<struct<kind:string,label:string,words:array<string>,gap:int,votes:int>>")
        self.grams = spark.createDataFrame(places, "gram long, template int, place int")


def _rolled(docs: DataFrame) -> DataFrame:
    """(r1, r2, place, gram) of documents (r1, r2, t): both kinds of grams of every place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            hashes, _, offsets = word_hashes(b.column("t").to_pylist(), MARKS)
            rolled = {w: grams(hashes, w) for w in (PHRASE, GRAM)}
            of, first, n_phrase, lists = [], [], [], []
            for i, (a, z) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                for at in range(a, z - PHRASE + 1, CHUNK):
                    short, long = (rolled[w][at : max(at, min(at + CHUNK, z - w + 1))] for w in (PHRASE, GRAM))
                    of.append(i)
                    first.append(at - a)
                    n_phrase.append(len(short))
                    lists += [short, long]
            ends = np.cumsum([0, *(len(x) + len(y) for x, y in zip(lists[::2], lists[1::2], strict=True))])
            values = pa.array(np.concatenate([*lists, np.zeros(0, np.uint64)]).view(np.int64))
            picked = b.select(["r1", "r2"]).take(pa.array(of, pa.int64()))
            columns = [*picked.columns, pa.array(first, pa.int32()), pa.array(n_phrase, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
            yield pa.RecordBatch.from_arrays(columns, ["r1", "r2", "first", "n_phrase", "grams"])

    chunks = docs.select("r1", "r2", "t").mapInArrow(run, "r1 long, r2 long, first int, n_phrase int, grams array<long>")
    each = chunks.select("r1", "r2", "first", "n_phrase", F.posexplode("grams").alias("k", "gram"))
    k = F.col("k")
    return each.select("r1", "r2", (F.col("first") + F.when(k < F.col("n_phrase"), k).otherwise(k - F.col("n_phrase"))).alias("place"), "gram")


def candidates(rolled: DataFrame, known: Templates) -> DataFrame:
    """(r1, r2, template, diagonals): merged diagonals that have votes enough."""
    c = F.col
    met = rolled.withColumnRenamed("place", "at").join(counted(known.grams, BROADCAST_ROWS), "gram")
    votes = met.groupBy("r1", "r2", "template", (c("at") - c("place")).alias("diagonal")).agg(F.count("*").alias("votes"))
    along = Window.partitionBy("r1", "r2", "template").orderBy("diagonal")
    apart = F.coalesce(c("diagonal") - F.lag("diagonal").over(along) > F.get(known.all, c("template"))["gap"], F.lit(True))
    grouped = votes.withColumn("apart", apart.cast("int")).withColumn("part", F.sum("apart").over(along))
    grouped = grouped.groupBy("r1", "r2", "template", "part").agg(F.sum("votes").alias("votes"), F.array_sort(F.collect_list("diagonal")).alias("diagonals"))
    return grouped.where(c("votes") >= F.get(known.all, c("template"))["votes"]).select("r1", "r2", "template", "diagonals")


def _verified(words: Column, found: Column, known: Templates) -> Column:
    """Spans of candidates (template, diagonals) whose words are there."""

    def span(x: Column, template: Column) -> Column:
        at = lambda word, t: F.get(F.filter(F.transform(x["diagonals"], lambda d: d + t), lambda p: (p >= 0) & F.get(words, p).eqNullSafe(word)), F.lit(0))
        places = F.filter(F.transform(template["words"], at), lambda p: p.isNotNull())
        fields = lambda p: [F.array_min(p).alias("start"), (F.array_max(p) + 1).alias("end"), template["kind"].alias("kind"), template["label"].alias("label"), F.size(p).alias("matched"), (F.size(p) / F.size(template["words"])).alias("share")]
        return F.transform(F.array(places), lambda p: F.struct(*fields(p)))[0]

    enough = lambda s: s["share"] >= F.when(s["kind"] == "notice", LEAST / 100).otherwise(1.0)
    return F.filter(F.transform(found, lambda x: span(x, F.get(known.all, x["template"]))), enough)


def _undisputed(spans: Column) -> Column:
    """Spans without notices that overlap a notice of another label that fits better."""
    better = lambda a, b: (a["matched"] > b["matched"]) | ((a["matched"] == b["matched"]) & (a["share"] > b["share"]))
    rival = lambda a, b: (a["kind"] == "notice") & (a["label"] != b["label"]) & (a["start"] < b["end"]) & (b["start"] < a["end"]) & better(a, b)
    return F.filter(spans, lambda b: (b["kind"] != "notice") | ~F.exists(spans, lambda a: rival(a, b)))


@tidy("license-spans")
def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Per row: the key, n_words and spans (start, end, kind, label, matched, share), sorted.

    Places are numbers of words, from 0; ``matched`` counts the template's words that are there and ``share`` is their share.
    Null and empty texts have no words and no spans. Repeated rows give repeated results, rows that repeat an id with other
    texts, or have none, their own ones. Other columns are not read.
    """
    c = F.col
    templates_ = Templates(docs.sparkSession, templates() if known is None else known)
    # a row is known by two hashes of its key and text: neither need be unique
    rows = docs.select(c(key).alias("k"), c(text).alias("t")).withColumns({"r1": F.xxhash64("k", "t"), "r2": F.xxhash64(F.lit(1), "t", "k")})
    found = candidates(_rolled(rows), templates_).groupBy("r1", "r2").agg(F.collect_list(F.struct("template", "diagonals")).alias("found"))
    found = settle(found, "candidates")
    size = found.agg(F.sum(F.aggregate("found", F.lit(0), lambda n, x: n + F.size(x["diagonals"])))).first()[0] or 0
    met = rows.join(F.broadcast(found) if size <= BROADCAST_ROWS else found, ["r1", "r2"], "left")
    words = F.filter(F.split(F.translate("t", UPPER, UPPER.lower()), SEPARATORS), lambda x: x != "")
    # within functions of an array's one element, words and spans are computed once
    spans = F.transform(F.array(words), lambda w: _verified(w, c("found"), templates_))
    spans = F.transform(spans, lambda s: F.array_sort(_undisputed(s)))[0]
    n_words = F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)).cast("long")
    return met.select(c("k").alias(key), n_words.alias("n_words"), F.when(c("found").isNotNull(), spans).otherwise(F.array().cast(SPANS)).alias("spans"))
