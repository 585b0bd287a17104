"""Sinks that are written to more than once: what later writes add, replace and leave alone, down to the files."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidecue.sources import writers as wr

DOCUMENT = "job_id string, value string"
RENDER = "job_id string, title string, rendered_at long"


def files(path) -> dict[str, int]:
    """Data files below a folder, with when they were written."""
    found = [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")]
    return {f: os.stat(f).st_mtime_ns for f in found}


def held(spark, path, packed):
    return sorted((r.job_id, (r.value or "").rstrip("\n")) for r in wr.read_documents(spark, path, packed).collect())


def failing(documents):
    return documents.withColumn("value", F.when(F.col("job_id") == "boom", F.raise_error(F.lit("lost"))).otherwise(F.col("value")))


@pytest.mark.parametrize("packed", [False, True])
def test_other_jobs_stay(spark, tmp_path, packed):
    path = f"{tmp_path}/d"
    make = lambda *rows: spark.createDataFrame(list(rows), DOCUMENT)
    wr.write_documents(make(("a", "1"), ("b", "2"), ("007", "3"), ("x/y z=%", "4")), path, packed)
    before = files(path)
    wr.write_documents(make(("b", "new\nlines é"), ("c", "5")), path, packed)
    assert held(spark, path, packed) == [("007", "3"), ("a", "1"), ("b", "new\nlines é"), ("c", "5"), ("x/y z=%", "4")]
    after = files(path)
    kept = [f for f in before if f in after]
    assert kept and all(before[f] == after[f] for f in kept)  # untouched jobs' files are the same ones
    if not packed:
        assert len(kept) == 3
    again = held(spark, path, packed)
    wr.write_documents(make(("b", "new\nlines é"), ("c", "5")), path, packed)
    assert held(spark, path, packed) == again and len(files(path)) == len(after)


@pytest.mark.parametrize("packed", [False, True])
def test_failed_writes_leave_the_old_documents(spark, tmp_path, packed):
    path = f"{tmp_path}/d"
    wr.write_documents(spark.createDataFrame([("a", "1"), ("b", "2"), ("boom", "3")], DOCUMENT), path, packed)
    before = files(path)
    with pytest.raises(Exception, match="lost"):
        wr.write_documents(failing(spark.createDataFrame([("a", "9"), ("boom", "9"), ("c", "9")], DOCUMENT)), path, packed)
    assert held(spark, path, packed) == [("a", "1"), ("b", "2"), ("boom", "3")]
    assert {f: before.get(f) for f in files(path) if "_temporary" not in f and ".spark-staging" not in f} == before


@pytest.mark.parametrize("packed", [False, True])
def test_null_and_repeated_jobs_and_empty_batches(spark, tmp_path, packed):
    path = f"{tmp_path}/d"
    wr.write_documents(spark.createDataFrame([(None, "1"), ("a", "2"), ("a", "3"), ("b", "4")], DOCUMENT), path, packed)
    wr.write_documents(spark.createDataFrame([], DOCUMENT), path, packed)
    values = lambda: sorted(line for r in wr.read_documents(spark, path, packed).collect() for line in r.value.split())
    assert values() == ["1", "2", "3", "4"]
    wr.write_documents(spark.createDataFrame([(None, "5")], DOCUMENT), path, packed)
    wr.write_documents(spark.createDataFrame([("a", "6")], DOCUMENT), path, packed)
    assert values() == ["4", "5", "6"]


def test_packed_documents_read_and_write_touched_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/d"
    wr.write_documents(spark.range(500).select(F.col("id").cast("string").alias("job_id"), F.lit("x").alias("value")), path, True, buckets=16)
    before = files(path)
    wr.write_documents(spark.createDataFrame([("17", "y")], DOCUMENT), path, True, buckets=16)
    after = files(path)
    gone = {os.path.dirname(f) for f in before if f not in after}
    assert len(gone) == 1 and sum(f not in before for f in after) == 1
    assert wr.read_documents(spark, path, True).where("value = 'y'").count() == 1
    assert wr.read_documents(spark, path, True).count() == 500
    with pytest.raises(Exception, match="16|32"):
        wr.write_documents(wr.read_documents(spark, path, True), path, True, buckets=32)


def test_subtitles_of_one_job_replace_only_its_own(spark, tmp_path):
    cue = "job_id long, idx long, start_s double, end_s double, source_text string, translated_text string"
    for rows in ([(1, 0, 0.0, 1.0, "a", ""), (2, 0, 0.0, 1.0, "b", "")], [(2, 0, 0.0, 1.0, "B", "")]):
        wr.write_srt(spark.createDataFrame(rows, cue), f"{tmp_path}/srt")
    assert {r.job_id: r.value.split("\n")[2] for r in wr.read_documents(spark, f"{tmp_path}/srt", job_id="long").collect()} == {1: "a", 2: "B"}


def index(spark, path):
    return sorted((r.job_id, r.version, r.title, r.rendered_at, r.batch) for r in wr.read_bundle_index(spark, path, "long").collect())


def test_versions_go_on_over_batches(spark, tmp_path):
    path = f"{tmp_path}/index"
    batches = {
        "one": [("a", "T", 5), ("a", "T", 3), ("b", "U", 1)],
        "two": [("a", "T", 4), ("c", None, 1), (None, "N", 1)],
        "three": [("a", "T2", 9), ("b", "U", 1), ("b", "U", 1), (None, "N", 1)],
    }
    for name, rows in batches.items():
        wr.write_bundle_index(spark.createDataFrame(rows, RENDER), path, name)
    expected = sorted(
        [("a", 1, "T", 3, "one"), ("a", 2, "T", 5, "one"), ("b", 1, "U", 1, "one"), ("a", 3, "T", 4, "two"), ("c", 1, None, 1, "two"), (None, 1, "N", 1, "two")]
        + [("a", 4, "T2", 9, "three"), ("b", 2, "U", 1, "three"), ("b", 3, "U", 1, "three"), (None, 2, "N", 1, "three")],
        key=repr,
    )
    found = lambda: sorted(((r.job_id, r.version, r.title, r.rendered_at, r.batch) for r in wr.read_bundle_index(spark, path, "long").collect()), key=repr)
    assert found() == expected
    before = files(path)
    for name in ("one", "three", "two"):  # reruns, also of batches that are not the last, add nothing
        wr.write_bundle_index(spark.createDataFrame(batches[name], RENDER), path, name)
    assert found() == expected
    assert {f: t for f, t in files(path).items() if f in before} == before
    names = {(r.job_id, r.video, r.subtitles) for r in wr.read_bundle_index(spark, path, "long").where("version = 1 and job_id = 'a'").collect()}
    assert names == {("a", "T-a.mp4", "T-a.zh-CN.srt")}


def test_a_batch_that_was_cut_off_is_completed(spark, tmp_path):
    """Files of some buckets only are in place: the rerun adds the others' renders and no second version of the first."""
    path = f"{tmp_path}/index"
    rows = [(f"j{i}", "T", i) for i in range(40)]
    wr.write_bundle_index(spark.createDataFrame(rows[:15], RENDER), path, "x")
    wr.write_bundle_index(spark.createDataFrame(rows, RENDER), path, "x")
    assert index(spark, path) == sorted((j, 1, t, at, "x") for j, t, at in rows)
    with pytest.raises(Exception, match="buckets"):
        wr.write_bundle_index(spark.createDataFrame(rows, RENDER), path, "y", buckets=7)
