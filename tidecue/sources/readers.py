"""Readers: transcripts, drafts, word timings, probes, manifests, glossaries, intervals and media files.

Documents are read as whole texts, one row per file, and parsed by expressions; the job is the name of the
folder that holds the file. Each reader has a ``parse_`` part that works on a column of texts, for documents
that already are in a table. What cannot be read is reported in a second DataFrame, never dropped silently.

Both DataFrames come from the same parsed documents. With a ``store``, a new folder, these are written there once and both
read them back; without one, each of the two reads and parses the documents when it is used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecue.functions.text import is_blank, json_object

#: Suffixes of files beside a medium, and of local media.
SIDE_SUFFIXES = ("json", "part", "ytdl", "description", "vtt")
LOCAL_SUFFIXES = ("mp4", "mkv", "mov", "webm", "m4v")
SEGMENT = "struct<index:bigint,start:double,end:double,source_text:string,translated_text:string,speaker:string,tts_file:string>"
OPTIONS = "struct<target_language:string,keep_original_audio:boolean,duck_original_audio:boolean,burn_subtitles:boolean,source_language:string,glossary:map<string,string>>"
MANIFEST = (
    f"id string, source string, status string, progress int, stage_message string, options {OPTIONS}, created_at timestamp, updated_at timestamp, "
    "title string, source_path string, audio_path string, subtitle_path string, english_subtitle_path string, dub_audio_path string, output_path string, "
    "segments_path string, translations_path string, error string, failed_stage string, overflow_segments array<variant>, metadata map<string,string>"
)
#: The states of a job, and what a manifest means that leaves a field out.
STATUSES = ("queued", "downloading", "extracting", "transcribing", "prepared", "translating", "synthesizing", "aligning", "muxing", "completed", "failed")
STAGE_MESSAGE, TARGET_LANGUAGE = "等待处理", "简体中文"
#: Bytes of a file that are hashed at once.
HASH_CHUNK = 1 << 20


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, job_id, content) of text files; the job is the folder's name."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("job_id"), F.col("value").alias("content"))


def _once(parsed: DataFrame, store: str | None) -> tuple[DataFrame, DataFrame]:
    """Parsed documents without and with a ``reason``, written to a folder and read back if one is named."""
    if store is not None:
        parsed.write.parquet(store)
        parsed = parsed.sparkSession.read.schema(parsed.schema).parquet(store)
    return parsed.where("reason is null").drop("reason"), parsed.where("reason is not null")


def parse_segments(documents: DataFrame, content: str = "content", store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Segments of transcript arrays, and (job_id, reason) of transcripts that are unreadable, empty or hold
    a row without text or with times out of their domain. A bad row rejects its whole transcript.
    """
    c = F.col
    parsed = documents.withColumn("rows", F.from_json(c(content), f"array<{SEGMENT}>", {"mode": "PERMISSIVE"}))
    good = lambda r: r["index"].isNotNull() & (r["start"] >= 0) & (r["end"] > 0) & r["source_text"].isNotNull()
    reason = (
        F.when(c("rows").isNull() | F.try_parse_json(content).isNull(), "unreadable")
        .when(F.size("rows") == 0, "empty")
        .when(~F.forall("rows", lambda r: F.coalesce(good(r), F.lit(False))), "invalid row")
    )
    good_ones, bad = _once(parsed.select("job_id", "rows", reason.alias("reason")), store)
    rows = good_ones.select("job_id", F.posexplode("rows").alias("pos", "r")).select("job_id", "pos", "r.*")
    return rows, bad.select("job_id", "reason")


def read_segments(spark: SparkSession, path: str, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_segments(whole_files(spark, path), store=store)


def parse_translations(documents: DataFrame, content: str = "content", store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items (job_id, pos, id, text, en) of drafts, and (job_id, reason) of drafts without an object or a
    ``segments`` array. ``id`` is null unless it is an integer in the JSON; texts are null unless strings.
    """
    c = F.col
    # from_json would turn numbers into text and 1.0 into 1, so types are tested on variants
    held = documents.select("job_id", json_object(c(content)).alias("v"))
    held = held.withColumn("items", F.try_variant_get("v", "$.segments", "array<variant>"))
    held = held.withColumn("reason", F.when(c("v").isNull(), "no object").when(c("items").isNull(), "no segments"))
    good, bad = _once(held.select("job_id", "items", "reason"), store)
    items = good.select("job_id", F.posexplode("items").alias("pos", "item"))
    kind = lambda field: F.schema_of_variant(F.try_variant_get("item", f"$.{field}", "variant"))
    text = lambda field: F.when(kind(field) == "STRING", F.try_variant_get("item", f"$.{field}", "string"))
    rows = items.select("job_id", "pos", F.when(kind("id") == "BIGINT", F.try_variant_get("item", "$.id", "bigint")).alias("id"), text("text").alias("text"), text("en").alias("en"))
    return rows, bad.select("job_id", "reason")


def read_translations(spark: SparkSession, path: str, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_translations(whole_files(spark, path), store=store)


def parse_word_timings(sidecars: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """(keys, pos, start, end, text) of word sidecars; one bad row voids the whole sidecar, as does bad JSON.

    A row is good if start and end are numbers with 0 <= start < end < infinity, its text is not blank, and
    it starts no earlier than the row before.
    """
    items = sidecars.select(*keys, F.posexplode(F.try_variant_get(F.try_parse_json(content), "$", "array<variant>")).alias("pos", "item"))
    kind = lambda field: F.schema_of_variant(F.try_variant_get("item", f"$.{field}", "variant"))
    number = lambda field: F.when(kind(field).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("item", f"$.{field}", "double"))
    words = items.select(*keys, "pos", number("start").alias("start"), number("end").alias("end"), F.when(kind("text") == "STRING", F.try_variant_get("item", "$.text", "string")).alias("text"))
    return sound_word_timings(words, keys)


def sound_word_timings(words: DataFrame, keys: list[str]) -> DataFrame:
    """The words of clips all of whose rows are good."""
    c = F.col
    clip = Window.partitionBy(*keys)
    before = F.coalesce(F.lag("start").over(clip.orderBy("pos")), F.lit(0.0))
    good = (c("start") >= 0) & (c("start") < c("end")) & (c("end") < float("inf")) & ~is_blank(c("text")) & (c("start") >= before)
    return words.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_all", F.bool_and("_good").over(clip)).where("_all").drop("_good", "_all")


def read_word_timings(spark: SparkSession, path: str) -> DataFrame:
    """Words of ``*.words.json`` sidecars, by job and clip (the file's name without its two suffixes)."""
    files = whole_files(spark, path).withColumn("clip", F.regexp_extract("path", r"([^/]*)\.words\.json$", 1))
    return parse_word_timings(files, ["job_id", "clip"])


PROBE = "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,duration:string,tags:struct<language:string,handler_name:string>,disposition:struct<default:int>>>>"


def parse_probes(documents: DataFrame, content: str = "content", store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Probe documents as structs (column ``probe``), and (job_id, reason) of invalid ones."""
    reason = F.when(F.try_parse_json(content).isNull(), "invalid JSON")
    good, bad = _once(documents.withColumns({"probe": F.from_json(content, PROBE), "reason": reason}).drop(content), store)
    return good, bad.select("job_id", "reason")


def read_probe_documents(spark: SparkSession, path: str, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_probes(whole_files(spark, path), store=store)


def parse_manifests(documents: DataFrame, content: str = "content", store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Job manifests with all their fields, and (path, reason) of those that are invalid, have no proper id, or a field
    out of its domain. Fields that are left out have their defaults; overflow rows stay as they are written.
    """
    m = lambda name: F.col(f"m.{name}")
    known = m("status").isin(*STATUSES) & F.coalesce(m("failed_stage").isin(*STATUSES), F.lit(True)) & m("progress").between(0, 100)
    options = F.struct(
        F.coalesce(m("options.target_language"), F.lit(TARGET_LANGUAGE)).alias("target_language"),
        *[m(f"options.{k}").alias(k) for k in ("keep_original_audio", "duck_original_audio", "burn_subtitles", "source_language")],
        F.coalesce(m("options.glossary"), F.create_map().cast("map<string,string>")).alias("glossary"),
    )
    defaults = {"status": F.lit("queued"), "progress": F.lit(0), "stage_message": F.lit(STAGE_MESSAGE), "overflow_segments": F.array().cast("array<variant>"), "metadata": F.create_map().cast("map<string,string>")}
    parsed = documents.withColumn("m", F.from_json(content, MANIFEST))
    filled = F.struct(*[(options if f == "options" else F.coalesce(m(f), defaults[f]) if f in defaults else m(f)).alias(f) for f in parsed.schema["m"].dataType.names])
    parsed = parsed.withColumn("invalid", F.try_parse_json(content).isNull()).withColumn("m", filled)
    reason = (
        F.when(F.col("invalid"), "invalid JSON")
        .when(~F.coalesce(m("id").rlike(r"\A[a-f0-9]{32}\z"), F.lit(False)), "bad id")
        .when(m("source").isNull(), "no source")
        .when(~known, "invalid value")
    )
    good, bad = _once(parsed.select("path", "m", reason.alias("reason")), store)
    return good.select("m.*"), bad.select("path", "reason")


def manifest_options(manifests: DataFrame) -> DataFrame:
    """(job_id and the three switches of a job's options): what ``effective_options`` takes."""
    return manifests.select(F.col("id").alias("job_id"), *[F.col(f"options.{k}").alias(k) for k in ("keep_original_audio", "duck_original_audio", "burn_subtitles")])


def manifest_jobs(manifests: DataFrame) -> DataFrame:
    """The columns that ``job_report`` takes; the detected language is a part of the metadata."""
    names = ("status", "failed_stage", "error", "segments_path", "translations_path", "output_path", "subtitle_path", "english_subtitle_path")
    return manifests.select(F.col("id").alias("job_id"), *names, F.col("metadata")["detected_language"].alias("detected_language"))


def read_manifests(spark: SparkSession, path: str, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_manifests(whole_files(spark, path), store=store)


def parse_glossaries(documents: DataFrame, content: str = "content", store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Terms (job_id, term, translation), and (job_id, reason) of documents that are not objects of strings."""
    held = documents.select("job_id", F.try_parse_json(content).alias("v"))
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    entries = F.map_entries(F.from_json(F.to_json(F.when(whole, F.col("v"))), "map<string,variant>"))
    held = held.select("job_id", "v", whole.alias("whole"), entries.alias("e"))
    strings = F.forall("e", lambda x: F.schema_of_variant(x["value"]) == "STRING")
    reason = F.when(F.col("v").isNull(), "invalid JSON").when(~F.col("whole"), "no object").when(~strings, "not a string")
    terms = F.when(reason.isNull(), F.transform("e", lambda x: F.struct(x["key"].alias("term"), F.try_variant_get(x["value"], "$", "string").alias("translation"))))
    good, bad = _once(held.select("job_id", terms.alias("terms"), reason.alias("reason")), store)
    return good.select("job_id", F.explode("terms").alias("e")).select("job_id", "e.*"), bad.select("job_id", "reason")


def read_glossary(spark: SparkSession, path: str, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    return parse_glossaries(whole_files(spark, path), store=store)


def parse_interval_drafts(documents: DataFrame, content: str = "content") -> DataFrame:
    """(job_id, kind, pos, start_s, end_s) of ``original_audio_windows`` and ``segments``; rows are pairs or objects.

    A row that is neither keeps its place with null times; ``interval_faults`` names the drafts that have such rows.
    """
    held = documents.select("job_id", F.try_parse_json(content).alias("v"))
    found = None
    for kind, field in (("window", "original_audio_windows"), ("segment", "segments")):
        items = held.select("job_id", F.lit(kind).alias("kind"), F.posexplode(F.try_variant_get("v", f"$.{field}", "array<variant>")).alias("pos", "i"))
        end = lambda name, at: F.coalesce(F.try_variant_get("i", f"$.{name}", "double"), F.try_variant_get("i", f"$[{at}]", "double"))
        rows = items.select("job_id", "kind", "pos", end("start", 0).alias("start_s"), end("end", 1).alias("end_s"))
        found = rows if found is None else found.unionByName(rows)
    return found


def interval_faults(intervals: DataFrame) -> DataFrame:
    """(job_id, kind, n_bad) of drafts with rows that are no pair of finite times, the first before the second."""
    good = (F.col("start_s") < F.col("end_s")) & (F.col("start_s") >= 0) & (F.col("end_s") < float("inf"))
    return intervals.where(~F.coalesce(good, F.lit(False))).groupBy("job_id", "kind").agg(F.count("*").alias("n_bad"))


def read_interval_drafts(spark: SparkSession, path: str) -> DataFrame:
    return parse_interval_drafts(whole_files(spark, path))


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))


def pick_media_file(files: DataFrame) -> DataFrame:
    """The largest media file of each job among (job_id, name, length); of equally large ones the first by name.

    Only files named ``source.*`` count, and no side files.
    """
    media = files.where(F.col("name").startswith("source.") & ~suffix(F.col("name")).isin(*SIDE_SUFFIXES))
    ranked = media.groupBy("job_id").agg(F.max("length").alias("length"))
    # a maximum, then the first name of that length: both are aggregated before the shuffle
    return media.join(ranked, ["job_id", "length"], "left_semi").groupBy("job_id").agg(F.min("name").alias("name"), F.max("length").alias("length"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(job_id, name, length) of files below job folders; contents are not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.select(F.element_at(F.split("path", "/"), -2).alias("job_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "length")


def local_sources(files: DataFrame) -> DataFrame:
    """Local inputs with ``accepted`` (by suffix) and a title, the name without its suffix."""
    return files.withColumn("accepted", suffix(F.col("name")).isin(*LOCAL_SUFFIXES)).withColumn("title", F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""))


def _open(path: str):
    """A stream of the bytes of a file, in the file system that its scheme names."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream(re.sub("^file:/*", "/", path))
    system, place = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return system.open_input_stream(place)


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, length, sha256) of files of any size.

    Spark lists the files and deals them to tasks by their lengths; a task opens each of its files and reads it a chunk
    at a time, so that no file is ever a value. File systems are those that pyarrow opens (file, hdfs, s3, gs, abfs).
    Spark's reader does not list empty files: an audit reports them as missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for place in b.column("path").to_pylist():
                digest = hashlib.sha256()
                with _open(place) as stream:
                    while chunk := stream.read(HASH_CHUNK):
                        digest.update(chunk)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "sha256"])

    files = spark.read.format("binaryFile").load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return files.mapInArrow(run, "path string, name string, length long, sha256 string")


def hash_contents(files: DataFrame) -> DataFrame:
    """(path, name, length, sha256) of files whose ``content`` already is in a table, beside its ``path``."""
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.octet_length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))
