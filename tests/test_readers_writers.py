"""Readers and writers on files, and rules on literal cases."""

from __future__ import annotations

import ipaddress
import json
import os
import random
import unicodedata
import sys
import re

import pytest
from pyspark.sql import functions as F

from tidecue.functions import text as tx
from tidecue.functions import timing as tm
from tidecue.operators import checks as ck
from tidecue.sources import readers as rd
from tidecue.sources import writers as wr


def put(root, name: str, content: str) -> None:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")


def test_transcripts_from_files(spark, tmp_path):
    good = [{"index": 0, "start": 0, "end": 1.5, "source_text": "a"}, {"index": 1, "start": 2, "end": 3, "source_text": "b", "speaker": "S"}]
    put(tmp_path, "j1/segments.json", json.dumps(good, indent=2))
    put(tmp_path, "j2/segments.json", "[]")
    put(tmp_path, "j3/segments.json", json.dumps([{"index": 0, "start": -1, "end": 1, "source_text": "a"}]))
    put(tmp_path, "j4/segments.json", "no json")
    rows, rejected = rd.read_segments(spark, f"{tmp_path}/*/segments.json")
    assert [(r.job_id, r["index"], r.speaker) for r in rows.orderBy("index").collect()] == [("j1", 0, None), ("j1", 1, "S")]
    assert {r.job_id: r.reason for r in rejected.collect()} == {"j2": "empty", "j3": "invalid row", "j4": "unreadable"}


def test_drafts_reject_odd_ids(spark):
    draft = '```json\n{"segments":[{"id":1,"text":"x"},{"id":1.0,"text":"y"},{"id":"3","text":"z"},{"id":true,"text":4},{"text":"n"}]}\n```'
    rows, bad = rd.parse_translations(spark.createDataFrame([("a", draft), ("b", "none"), ("c", '{"segments":{}}'), ("d", None)], "job_id string, content string"))
    assert [(r.id, r.text) for r in rows.orderBy("pos").collect()] == [(1, "x"), (None, "y"), (None, "z"), (None, None), (None, "n")]
    assert {r.job_id: r.reason for r in bad.collect()} == {"b": "no object", "c": "no segments", "d": "no object"}


@pytest.mark.parametrize(
    "row",
    [{"start": "0", "end": 1, "text": "x"}, {"start": 0, "end": 0, "text": "x"}, {"start": -1, "end": 1, "text": "x"}, {"start": 0, "end": 1, "text": " "}, {"end": 1, "text": "x"}, 5],
)
def test_one_bad_word_voids_the_sidecar(spark, row):
    good = {"start": 0.0, "end": 0.5, "text": "x"}
    docs = spark.createDataFrame([(1, json.dumps([good, row])), (2, json.dumps([good])), (3, "{"), (4, None)], "clip long, content string")
    assert [r.clip for r in rd.parse_word_timings(docs, ["clip"]).collect()] == [2]


def test_media_file_ties_and_side_files(spark):
    files = [("a", "source.mp4", 5), ("a", "source.MKV", 5), ("a", "source.json", 9), ("a", "other.mp4", 99), ("b", "source.part", 3)]
    found = rd.pick_media_file(spark.createDataFrame(files, "job_id string, name string, length long")).collect()
    assert [tuple(r) for r in found] == [("a", "source.MKV", 5)]


@pytest.mark.parametrize(
    ("url", "reason"),
    [
        ("https://www.youtube.com/watch?v=a", None), (" https://youtu.be/a ", None), ("http://b23.tv/x", None), ("https://WWW.bilibili.com./video/1", None),
        ("ftp://youtube.com/a", "scheme"), ("https://u:p@youtube.com/a", "credentials"), ("https://127.0.0.1/a", "ip address"), ("https://[::1]/a", "ip address"), ("https://youtube.com.evil.org/", "not allowed"), (None, "scheme"),
        ("https://999.1.1.1/a", "not allowed"), ("https://1.2.3/a", "not allowed"), ("https://01.2.3.4/", "not allowed"), ("https://255.255.255.255:80/a", "ip address"), ("https://1.2.3.4./", "ip address"),
        ("https://[2001:db8::1.2.3.4]:443/", "ip address"), ("https://[1:2:3:4:5:6:7:8]/", "ip address"), ("https://[fe80::1%eth0]/", "ip address"), ("https://[1::2::3]/", "scheme"), ("https://[youtu.be]/", "scheme"), ("https://[::1/a", "scheme"),
        ("https://youtu.be:8080/a b", None), ("https://:p@youtu.be/", "credentials"), ("https://:@youtu.be/", None), ("https:///a", "host"), ("https://a@b@youtu.be/", "credentials"), ("https:youtu.be", "host"), ("youtu.be/a", "scheme"), ("", "scheme"),
    ],
)
def test_urls(spark, url, reason):
    assert ck.check_source_urls(spark.createDataFrame([(url,)], "url string")).first()["reason"] == reason


def test_addresses_against_python(spark):
    """Random strings of address characters are addresses where Python takes them for one."""
    rng = random.Random(5)
    hosts = {"::", "::1", "1::", "1:2:3:4:5:6:7::", "::8:7:6:5:4:3:2", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4", "1.2.3.4", "1.2.3.4.5", "12345::", ":1", "1:", "1:::2", "g::1", "::%", "::%1", "1.2.3.256", "", ":"}
    hosts |= {"".join(rng.choice(["1", "ff", ":", "::", ".", "0", "255.1.1.1"]) for _ in range(rng.randint(1, 16))) for _ in range(3000)}
    hosts |= {":".join(f"{rng.randrange(1 << 16):x}" for _ in range(rng.randint(6, 9))) for _ in range(50)}

    def known(host):
        try:
            ipaddress.ip_address(host)
        except ValueError:
            return False
        return True

    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", ck.is_ip_address(F.col("h")).alias("ip")).collect()
    assert {r.h: r.ip for r in rows} == {h: known(h) for h in hosts}


def test_scalar_functions_against_python(spark):
    rng = random.Random(2)
    seconds = [3661.234, 0.0005, 0.0015, -1.0, 400_000.5, *(rng.random() * 9000 for _ in range(200))]

    def stamp(s):
        ms = max(0, round(s * 1000))
        return f"{ms // 3600000:02d}:{ms // 60000 % 60:02d}:{ms // 1000 % 60:02d},{ms % 1000:03d}"

    rows = spark.createDataFrame([(s,) for s in seconds], "s double").select("s", tx.srt_timestamp(F.col("s")).alias("t")).collect()
    assert all(r.t == stamp(r.s) for r in rows)

    def chain(x):
        parts = []
        while x > 2:
            parts, x = [*parts, 2.0], x / 2
        while x < 0.5:
            parts, x = [*parts, 0.5], x / 0.5
        return ",".join(f"atempo={p:.6f}" for p in [*parts, x])

    factors = [1.25, 4.5, 0.25, 2.0, 0.5, 16.0, 1e-3, *(10 ** rng.uniform(-3, 3) for _ in range(200))]
    rows = spark.createDataFrame([(x,) for x in factors], "x double").select("x", tm.tempo_chain(F.col("x")).alias("t")).collect()
    assert all(r.t == chain(r.x) for r in rows)
    assert spark.range(1).select(tm.tempo_chain(F.lit(0.0))).first()[0] is None


def test_spoken_characters(spark):
    cases = {"Straße, ＡＢＣ!": "strasseabc", "第3集。": "第3集", "": "", "…": "", "½ x": "12x"}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.spoken_characters(F.col("t")).alias("s"), tx.spoken_weight(F.col("t")).alias("w")).collect()
    assert {r.t: r.s for r in rows} == cases
    assert {r.w for r in rows if not r.s} == {1}


def test_folding_against_python(spark):
    """Every character alone, and random strings of simple and other ones, capitals and marks that compose included."""
    rng = random.Random(9)
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    simple = [x for x in every if re.match(f"[{tx.SIMPLE}]", x)]
    assert len(simple) > 25_000
    # a character between two letters meets neighbours that it may compose with
    texts = [x for x in every if ord(x) < 0x3400 or x in "一龠豈ｱﾞ！Ａ" or 0xF900 <= ord(x) < 0x10800] + [f"e{x}\u0301" for x in every[:0x400]]
    texts += simple + ["".join(rng.choice(simple[:420]) for _ in range(12)) for _ in range(2000)] + ["".join(rng.choice([rng.choice(simple), rng.choice("e\u0301\u0308ßẞΣςİ한ᄀ가ﬁ①Å")]) for _ in range(8)) for _ in range(2000)]
    texts = sorted(set(texts))
    kept = lambda t: "".join(x for x in unicodedata.normalize("NFKC", t).casefold() if x.isalnum())
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.spoken_characters(F.col("t")).alias("s"), tx.casefolded(F.col("t")).alias("c"), tx.simply_spoken(F.col("t")).alias("p"))
    for r in df.toPandas().itertuples():
        assert r.c == r.t.casefold(), ascii(r.t)
        assert r.p is None or r.p == kept(r.t), ascii(r.t)
        assert (r.p is not None) == bool(re.fullmatch(f"[{tx.SIMPLE}]*", r.t)), ascii(r.t)
        assert r.s == kept(r.t), ascii(r.t)


def test_names(spark):
    title = "标题" * 60
    rows = spark.createDataFrame([("a b/c?.mp4 ",), ("...",), (title,)], "t string").select(tx.safe_output_name(F.col("t"), F.lit("0123456789")).alias("n")).collect()
    names = [r.n for r in rows]
    assert names[0] == "a-b-c-.mp4-01234567.mp4" and names[1] == "translated-video-01234567.mp4"
    assert names[2] == title[:66] + "-01234567.mp4"  # 200 bytes hold 66 characters of 3 bytes


def test_subtitles_and_documents_to_files(spark, tmp_path):
    cues = spark.createDataFrame([("j", 0, 0.0, 1.0, " a\nb ", ""), ("j", 1, 61.5, 62.0, "x", "译文 ")], "job_id string, idx long, start_s double, end_s double, source_text string, translated_text string")
    assert wr.to_srt(cues).first()["srt"] == "1\n00:00:00,000 --> 00:00:01,000\na b\n\n2\n00:01:01,500 --> 00:01:02,000\n译文\n"
    wr.write_srt(cues, f"{tmp_path}/srt")
    assert spark.read.text(f"{tmp_path}/srt").count() == 7
    renders = spark.createDataFrame([("0123456789", "T", 1), ("0123456789", "T", 2)], "job_id string, title string, rendered_at long")
    wr.write_bundle_index(renders, f"{tmp_path}/index", "first")
    assert sorted(r.version for r in spark.read.parquet(f"{tmp_path}/index").collect()) == [1, 2]


def check_manifests(spark, tmp_path):
    """All fields of a manifest, defaults of one that has only what it must have, reasons of others; B9 and B10 fed from them."""
    paths = {f"{p}_path": p for p in ("source", "audio", "subtitle", "english_subtitle", "dub_audio", "output", "segments", "translations")}
    options = {"target_language": "zh", "keep_original_audio": True, "duck_original_audio": False, "burn_subtitles": None, "source_language": "ja", "glossary": {"Anna": "安娜"}}
    overflow = [{"segment": 3, "tempo": 2.5, "cues": [3, 4]}]
    whole = {"id": "0" * 32, "source": "https://youtu.be/x", "status": "failed", "progress": 40, "stage_message": "m", "options": options, "created_at": "2024-05-01T10:00:00Z", "updated_at": "2024-05-01T12:30:00.250000+02:00"}
    whole |= {"title": "T", **paths, "error": "E", "failed_stage": "muxing", "overflow_segments": overflow, "metadata": {"detected_language": "ja"}}
    least = {"id": "1" * 32, "source": "s"}
    wrong = {"j3": {"id": "x"}, "j4": {**least, "status": "lost"}, "j5": {**least, "progress": 101}, "j6": {"id": "2" * 32}, "j7": {**least, "failed_stage": "rendering"}}
    for name, m in {"j1": whole, "j2": least, **wrong}.items():
        put(tmp_path, f"{name}/job.json", json.dumps(m))
    put(tmp_path, "j8/job.json", "{")
    jobs, bad = rd.read_manifests(spark, f"{tmp_path}/*/job.json")
    first, second = (r.asDict(True) for r in jobs.orderBy("id").collect())
    assert [json.loads(r.o) for r in jobs.where("title = 'T'").select(F.to_json("overflow_segments").alias("o")).collect()] == [overflow]
    assert {k: v for k, v in first.items() if k not in ("created_at", "updated_at", "overflow_segments")} == {k: v for k, v in whole.items() if k not in ("created_at", "updated_at", "overflow_segments")}
    assert [r.t for r in jobs.where("title = 'T'").select(F.unix_millis("updated_at").alias("t")).collect()] == [1714559400250]
    expected = dict.fromkeys(first) | least | {"status": "queued", "progress": 0, "stage_message": rd.STAGE_MESSAGE, "overflow_segments": [], "metadata": {}}
    assert second == expected | {"options": dict.fromkeys(options) | {"target_language": rd.TARGET_LANGUAGE, "glossary": {}}}
    assert sorted((r.path.split("/")[-2], r.reason) for r in bad.collect()) == [("j3", "bad id"), ("j4", "invalid value"), ("j5", "invalid value"), ("j6", "no source"), ("j7", "invalid value"), ("j8", "invalid JSON")]
    chosen = ck.effective_options(rd.manifest_options(jobs), {"keep_original_audio": False, "duck_original_audio": True, "burn_subtitles": True}).orderBy("job_id").collect()
    assert [tuple(r) for r in chosen] == [("0" * 32, True, False, True), ("1" * 32, False, True, True)]
    report = ck.job_report(rd.manifest_jobs(jobs), spark.createDataFrame([("1" * 32, "lost")], "job_id string, run_error string")).orderBy("job_id").collect()
    assert [(r.status, r.failed_stage, r.error, r.output_path, r.detected_language) for r in report] == [("failed", "muxing", "E", "output", "ja"), ("failed", None, "lost", None, None)]


def test_readers_on_files(spark, tmp_path):
    """Each reader from files in job folders, with one that it rejects."""
    put(tmp_path, "j1/translations.json", '{"segments":[{"id":0,"text":"甲","en":"a"},{"id":1,"text":"乙"}]}')
    put(tmp_path, "j2/translations.json", "[]")
    rows, bad = rd.read_translations(spark, f"{tmp_path}/*/translations.json")
    assert [(r.job_id, r.pos, r.id, r.text, r.en) for r in rows.orderBy("pos").collect()] == [("j1", 0, 0, "甲", "a"), ("j1", 1, 1, "乙", None)]
    assert [tuple(r) for r in bad.collect()] == [("j2", "no object")]

    word = {"start": 0.0, "end": 0.5, "text": "x"}
    put(tmp_path, "j1/tts/00001.words.json", json.dumps([word, {**word, "start": 0.25}]))
    put(tmp_path, "j1/tts/00002.words.json", json.dumps([word, {**word, "end": 0}]))
    assert [(r.clip, r.pos, r.start, r.end, r.text) for r in rd.read_word_timings(spark, f"{tmp_path}/j1/tts/*.words.json").orderBy("pos").collect()] == [("00001", 0, 0.0, 0.5, "x"), ("00001", 1, 0.25, 0.5, "x")]

    put(tmp_path, "j1/probe.json", json.dumps({"format": {"duration": "12.5"}, "streams": [{"codec_type": "audio", "tags": {"language": "en"}}]}))
    put(tmp_path, "j2/probe.json", "{")
    probes, bad = rd.read_probe_documents(spark, f"{tmp_path}/*/probe.json")
    assert [(r.job_id, r.probe.format.duration, r.probe.streams[0].tags.language) for r in probes.collect()] == [("j1", "12.5", "en")]
    assert [tuple(r) for r in bad.collect()] == [("j2", "invalid JSON")]
    assert [(r.duration, r.has_audio) for r in ck.media_facts(probes).collect()] == [(12.5, True)]

    check_manifests(spark, tmp_path)

    put(tmp_path, "j1/glossary.json", '{"Anna":"安娜"}')
    put(tmp_path, "j2/glossary.json", '{"Anna":1}')
    terms, bad = rd.read_glossary(spark, f"{tmp_path}/*/glossary.json")
    assert [tuple(r) for r in terms.collect()] == [("j1", "Anna", "安娜")] and [tuple(r) for r in bad.collect()] == [("j2", "not a string")]

    put(tmp_path, "j1/intervals.json", '{"original_audio_windows":[[0,1.5]],"segments":[{"start":2,"end":3}]}')
    found = rd.read_interval_drafts(spark, f"{tmp_path}/*/intervals.json").orderBy("kind").collect()
    assert [tuple(r) for r in found] == [("j1", "segment", 0, 2.0, 3.0), ("j1", "window", 0, 0.0, 1.5)]
    put(tmp_path, "j2/intervals.json", '{"original_audio_windows":[[0,1],[2,1],5,{"start":1}],"segments":[]}')
    found = rd.read_interval_drafts(spark, f"{tmp_path}/*/intervals.json")
    assert [tuple(r) for r in rd.interval_faults(found).collect()] == [("j2", "window", 3)]


@pytest.mark.parametrize(
    ("reader", "good", "bad"),
    [
        ("read_segments", '[{"index":0,"start":0,"end":1,"source_text":"a"}]', "[]"),
        ("read_translations", '{"segments":[{"id":0,"text":"a","en":"b"},{"id":1.5,"text":2}]}', "{}"),
        ("read_probe_documents", '{"format":{"duration":"1.5"},"streams":[]}', "{"),
        ("read_manifests", '{"id":"00000000000000000000000000000000","source":"s","overflow_segments":[{"a":[1,2]}]}', '{"id":"x"}'),
        ("read_glossary", '{"a":"b","c":"d"}', '{"a":1}'),
    ],
)
def test_documents_are_parsed_once(spark, tmp_path, reader, good, bad):
    """With a store both results are as without one, and read nothing but the store."""
    put(tmp_path, "in/j1/x.json", good)
    put(tmp_path, "in/j2/x.json", bad)
    read = getattr(rd, reader)
    shown = lambda frames: [sorted(r.j for r in f.select(F.to_json(F.struct(*f.columns)).alias("j")).collect()) for f in frames]
    plain = shown(read(spark, f"{tmp_path}/in/*/x.json"))
    frames = read(spark, f"{tmp_path}/in/*/x.json", f"{tmp_path}/store")
    for name in ("j1", "j2"):
        os.remove(tmp_path / f"in/{name}/x.json")
    assert shown(frames) == plain and all(plain)
    for f in frames:
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "parquet" in plan and "FileScan text" not in plan and "Scan text" not in plan


def test_files_and_hashes(spark, tmp_path):
    import hashlib

    from tidecue.operators import joins as jn

    for name, content in (("j1/source.mp4", "12345"), ("j1/source.json", "123456789"), ("j2/a.b.MKV", "x"), ("j2/notes.txt", "y")):
        put(tmp_path, name, content)
    files = rd.list_files(spark, f"{tmp_path}/*/*")
    assert sorted(tuple(r) for r in files.collect()) == [("j1", "source.json", 9), ("j1", "source.mp4", 5), ("j2", "a.b.MKV", 1), ("j2", "notes.txt", 1)]
    assert [tuple(r) for r in rd.pick_media_file(files).collect()] == [("j1", "source.mp4", 5)]
    assert {r.name: (r.accepted, r.title) for r in rd.local_sources(files).collect()} == {"source.json": (False, "source"), "source.mp4": (True, "source"), "a.b.MKV": (True, "a.b"), "notes.txt": (False, "notes")}
    hashed = rd.hash_files(spark, f"{tmp_path}/j1/*")
    expected = spark.createDataFrame([("source.mp4", hashlib.sha256(b"12345").hexdigest()), ("source.json", "0"), ("none", "1")], "name string, sha256 string")
    assert {r.name: r.status for r in jn.asset_audit(expected, hashed).collect()} == {"source.mp4": "ok", "source.json": "changed", "none": "missing"}
    ok = spark.createDataFrame([(10.0, 10.25), (10.0, 10.4), (10.0, 10.04)], "a double, b double")
    assert [tuple(r) for r in ok.select(jn.stem_length_ok(F.col("a"), F.col("b")), jn.stem_length_ok(F.col("a"), F.col("b"), instrumental=True)).collect()] == [(True, False), (False, False), (True, True)]


def test_large_files_are_hashed_by_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(rd, "HASH_CHUNK", 1000)
    contents = {"big file é%.bin": bytes(range(256)) * 40_000, "chunk": b"x" * 1000, "more": b"x" * 1001}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    found = rd.hash_files(spark, str(tmp_path))
    assert {r.name: (r.length, r.sha256) for r in found.collect()} == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in contents.items()}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("packed", [False, True])
def test_documents_to_files(spark, tmp_path, packed):
    documents = spark.createDataFrame([("a", "1\n2"), ("b", "é")], "job_id string, value string")
    for _ in range(2):  # the second time replaces the first
        wr.write_documents(documents, f"{tmp_path}/d", packed)
    back = spark.read.parquet(f"{tmp_path}/d") if packed else spark.read.text(f"{tmp_path}/d", wholetext=True)
    assert sorted((r.job_id, r.value.rstrip("\n")) for r in back.collect()) == [("a", "1\n2"), ("b", "é")]


def test_target_language_folds_case(spark):
    rows = spark.createDataFrame([("ZH_Hans",), ("  simplified \t CHINESE ",), ("Straße",), (None,)], "language string")
    assert [r.target_language for r in ck.normalize_target_language(rows).collect()] == [ck.TARGET_LANGUAGE, ck.TARGET_LANGUAGE, None, None]


def test_empty_tables(spark, sf_dir):
    empty = spark.createDataFrame([], "job_id long, idx long, start_s double, end_s double, text string, speaker string, extra string")
    from tidecue.operators import aggregates as ag
    from tidecue.operators import ordered as od

    assert od.merge_fragments(empty).count() == 0
    assert od.divide_overlaps(empty).count() == 0
    assert od.split_sentences(empty).count() == 0
    assert ag.index_stride(empty).count() == 0
    assert wr.to_srt(empty, source="text", translated="speaker").count() == 0
