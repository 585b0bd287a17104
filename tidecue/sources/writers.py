"""Writers: subtitle text, segment arrays, drafts and versioned bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidecue.functions.text import safe_output_name, srt_timestamp, subtitle_text

#: Buckets of packed documents and of bundle indexes; each path keeps the number it was first written with.
BUCKETS = 64


def srt_blocks(cues: DataFrame, source_text: bool = False, source: str = "source_text", translated: str = "translated_text") -> DataFrame:
    """(job_id, position, block): numbered subtitle blocks in order of idx."""
    c = F.col
    text = subtitle_text(F.lit(None).cast("string") if source_text else c(translated), c(source))
    position = F.row_number().over(Window.partitionBy("job_id").orderBy("idx"))
    block = F.concat_ws("\n", position.cast("string"), F.concat(srt_timestamp(c("start_s")), F.lit(" --> "), srt_timestamp(c("end_s"))), text, F.lit(""))
    return cues.select("job_id", position.alias("position"), block.alias("block"))


def to_srt(cues: DataFrame, **options) -> DataFrame:
    """(job_id, srt): one subtitle document per job."""
    blocks = srt_blocks(cues, **options).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("position", "block"))).alias("b"))
    return blocks.select("job_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n").alias("srt"))


def write_srt(cues: DataFrame, path: str, packed: bool = False, **options) -> None:
    """Subtitle documents as ``write_documents`` writes them."""
    # the sink ends each value with a line feed, which is the document's own last one
    write_documents(to_srt(cues, **options).select("job_id", F.regexp_replace("srt", r"\n\z", "").alias("value")), path, packed)


def segment_arrays(segments: DataFrame) -> DataFrame:
    """(job_id, value): the segments of a job as one JSON array in order of idx; nulls are written."""
    c = F.col
    row = F.struct(c("idx").alias("index"), c("start_s").alias("start"), c("end_s").alias("end"), "source_text", "translated_text", "speaker", "tts_file")
    rows = segments.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return rows.select("job_id", F.to_json("rows", {"ignoreNullFields": "false"}).alias("value"))


def draft_documents(translations: DataFrame) -> DataFrame:
    """(job_id, value): drafts ``{"segments":[{"id","text","en"?}]}`` in order of id; ``en`` only where there is one."""
    rows = translations.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("id", "text", "en"))).alias("segments"))
    return rows.select("job_id", F.to_json(F.struct("segments"), {"ignoreNullFields": "true"}).alias("value"))


def write_documents(documents: DataFrame, path: str, packed: bool = False, buckets: int = BUCKETS) -> None:
    """Documents (job_id, value) as text files in one folder per job; jobs of the path that are not among them stay.

    A job's documents replace those it had; they come into place when all are written, so that a write that fails
    leaves the old ones. Writing the same documents again changes nothing. One writer at a time.

    A folder per job is what players and editors take, and too much for a file system beyond some 100,000 jobs:
    ``packed`` deals jobs to buckets by a hash, as Parquet files sorted by job, so that one is found by a filter. Only
    buckets of the given jobs are read and written anew. Their number is fixed for a path; ``buckets`` of some
    100 MB suit tables of which a part changes at a time.
    """
    if packed:
        _replace_in_buckets(documents.select("job_id", "value"), path, buckets)
    else:
        documents.select("job_id", "value").repartition("job_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").text(path)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col("job_id").cast("string")), F.lit(buckets)).cast("int")


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _of_buckets(spark: SparkSession, path: str, schema: StructType, rows: DataFrame, buckets: int) -> DataFrame:
    """Stored rows of the buckets that the given rows fall into; other buckets' files are not listed for reading."""
    stored = spark.read.schema(StructType([*schema.fields, StructField("bucket", IntegerType())])).parquet(path)
    touched = [r[0] for r in rows.select(_bucket(buckets)).distinct().collect()]  # ``buckets`` numbers at most
    right = F.assert_true(F.col("bucket") == _bucket(buckets), F.lit(f"{path} was not written with {buckets} buckets"))
    return stored.where(F.col("bucket").isin(touched)).where(right.isNull()).drop("bucket")


def _replace_in_buckets(documents: DataFrame, path: str, buckets: int) -> None:
    spark = documents.sparkSession
    kept = documents
    if exists(spark, path):
        stored = _of_buckets(spark, path, documents.schema, documents, buckets).withColumnRenamed("job_id", "_job")
        given = documents.select("job_id").distinct()
        kept = stored.join(given, F.col("_job").eqNullSafe(F.col("job_id")), "left_anti").select(F.col("_job").alias("job_id"), "value").union(documents)
    dealt = kept.withColumn("bucket", _bucket(buckets)).repartition("bucket").sortWithinPartitions("bucket", "job_id")
    # files are replaced when the job ends, so that it may read what it replaces
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_documents(spark: SparkSession, path: str, packed: bool = False, job_id: str = "string") -> DataFrame:
    """(job_id, value) of documents written by ``write_documents``; text files end in the sink's line feed."""
    reader = spark.read.schema(f"value string, job_id {job_id}")
    found = spark.read.schema(f"job_id {job_id}, value string").parquet(path) if packed else reader.text(path, wholetext=True)
    return found.select("job_id", "value")


def bundle_index(renders: DataFrame, order: Sequence[str] = ("rendered_at",), more: Sequence[str] = ()) -> DataFrame:
    """Names of a job's output files, with a version that counts its renders in order of ``rendered_at``; ``more`` columns stay."""
    c = F.col
    version = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    name = safe_output_name(F.coalesce("title", F.lit("video")), c("job_id"))
    stem = F.regexp_replace(name, r"\.mp4$", "")
    return renders.select("job_id", version.alias("version"), name.alias("video"), F.concat(stem, F.lit(".zh-CN.srt")).alias("subtitles"), F.concat(stem, F.lit(".en.srt")).alias("english_subtitles"), *more)


INDEX = "job_id string, version long, video string, subtitles string, english_subtitles string, title string, rendered_at {kind}, nth int, batch string"


def write_bundle_index(renders: DataFrame, path: str, batch: str, buckets: int = BUCKETS) -> None:
    """Add a batch of renders (job_id, title, rendered_at) to an index of versions; no render ever replaces another.

    A job's versions go on after the largest that the index holds for it, in order of ``rendered_at``, then title. A batch
    that is written again, whole or because it was cut off in between, adds only what the index does not hold of it. The
    index is dealt to ``buckets`` by job, a number fixed for a path: only buckets of the batch's jobs are read, and files
    are only added. One writer at a time.
    """
    c = F.col
    spark = renders.sparkSession
    render = ["job_id", "title", "rendered_at"]
    kind = renders.schema["rendered_at"].dataType.simpleString()
    schema = StructType.fromDDL(INDEX.format(kind=kind))
    # equal renders of a batch are told apart by their number
    given = renders.select(c("job_id").cast("string").alias("job_id"), "title", "rendered_at")
    given = given.withColumn("nth", F.row_number().over(Window.partitionBy(*render).orderBy(F.lit(0))))
    last = None
    if exists(spark, path):
        stored = _of_buckets(spark, path, schema, given, buckets)
        own = stored.where(c("batch") == batch).select(*[c(x).alias(f"_{x}") for x in (*render, "nth")])
        given = given.join(own, [c(x).eqNullSafe(c(f"_{x}")) for x in (*render, "nth")], "left_anti")
        last = stored.groupBy(c("job_id").alias("_job")).agg(F.max("version").alias("_last"))
    added = bundle_index(given, ["rendered_at", "title", "nth"], ("title", "rendered_at", "nth")).withColumn("batch", F.lit(batch))
    if last is not None:
        added = added.join(last, c("job_id").eqNullSafe(c("_job")), "left").withColumn("version", c("version") + F.coalesce("_last", F.lit(0)))
    added = added.select(*[c(f.name).cast(f.dataType).alias(f.name) for f in schema], _bucket(buckets).alias("bucket"))
    added.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_bundle_index(spark: SparkSession, path: str, rendered_at: str = "timestamp") -> DataFrame:
    """The index: a row per render, with its job, version, file names and batch."""
    return spark.read.schema(INDEX.format(kind=rendered_at)).parquet(path)
