"""Aggregations per job: overflow reports, requests, levels, measures, packed utterances, strides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecue.functions.text import strip
from tidecue.functions.timing import cue_duration, max_zh_chars, rounded

MAX_TEMPO = 1.8
FRAME_SECONDS = 0.05
FRAME_SAMPLES = 2400


def overflow_report(clips: DataFrame, limit: float = MAX_TEMPO) -> DataFrame:
    """(job_id, n_overflows, overflows) for jobs with a clip that needs more than the greatest tempo.

    ``clips`` has job_id, idx, slot_s and audio_s (measured speech). Values are rounded to 3 places.
    """
    c = F.col
    tempo = c("audio_s") / F.greatest(F.lit(0.05), c("slot_s"))
    over = clips.withColumn("tempo", tempo).where(c("tempo") > limit)
    row = F.struct(c("idx").alias("id"), rounded(c("audio_s"), 3).alias("audio_seconds"), rounded(F.greatest(F.lit(0.05), c("slot_s")), 3).alias("slot_seconds"), rounded(c("tempo"), 3).alias("required_tempo"))
    return over.groupBy("job_id").agg(F.count("*").alias("n_overflows"), F.sort_array(F.collect_list(row)).alias("overflows"))


def fitting_clips(clips: DataFrame, limit: float = MAX_TEMPO) -> DataFrame:
    """Clips of jobs without any overflow."""
    return clips.join(overflow_report(clips, limit).select("job_id"), "job_id", "left_anti")


def batch_rows(segments: DataFrame, size: int = 12, order: str = "idx") -> DataFrame:
    """Add ``batch``: consecutive groups of ``size`` (1 at least) rows of a job in order."""
    number = F.row_number().over(Window.partitionBy("job_id").orderBy(order))
    return segments.withColumn("batch", F.floor((number - 1) / max(1, size)).cast("int"))


def translation_requests(segments: DataFrame, target_language: str, size: int = 12, glossary: DataFrame | None = None) -> DataFrame:
    """One request per batch of a job: (job_id, batch, n_segments, target_language, glossary, payload).

    ``glossary`` has (job_id, term, translation); a job without terms gets ``{}``.
    """
    c = F.col
    row = F.struct(
        c("idx").alias("id"), rounded(c("start_s"), 3).alias("start"), rounded(c("end_s"), 3).alias("end"), rounded(cue_duration(c("start_s"), c("end_s")), 2).alias("seconds"),
        max_zh_chars(c("start_s"), c("end_s")).alias("max_zh_chars"), c("source_text").alias("text"),
    )
    batches = batch_rows(segments, size).groupBy("job_id", "batch").agg(F.count("*").alias("n_segments"), F.to_json(F.array_sort(F.collect_list(row))).alias("payload"))
    if glossary is None:
        terms = batches.withColumn("glossary", F.lit("{}"))
    else:
        own = glossary.groupBy("job_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct("term", "translation"))))).alias("glossary"))
        terms = batches.join(own, "job_id", "left").withColumn("glossary", F.coalesce("glossary", F.lit("{}")))
    return terms.select("job_id", "batch", "n_segments", F.lit(target_language).alias("target_language"), "glossary", "payload")


def frame_rms(samples: DataFrame, per_frame: int = FRAME_SAMPLES) -> DataFrame:
    """(job_id, track, frame_no, rms) of sample rows (job_id, track, n, x): both channels are rows of the same n."""
    return samples.groupBy("job_id", "track", F.floor(F.col("n") / per_frame).alias("frame_no")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def frame_array_rms(frames: DataFrame, samples: str = "samples") -> DataFrame:
    """Add ``rms`` to frames that hold their samples as an array; an empty frame has none."""
    total = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return frames.withColumn("rms", F.sqrt(total / F.nullif(F.size(samples), F.lit(0))))


def exact_percentiles(values: DataFrame, shares: dict[str, float], value: str = "value", key: str = "job_id") -> DataFrame:
    """(key, one column per share): percentiles of each key's values, interpolated between neighbours; nulls do not count.

    Values are counted before the shuffle, and a key's distinct values pass once in order with a running count: no
    buffer holds the values of a key.
    """
    c = F.col
    counts = values.where(c(value).isNotNull()).groupBy(c(key).alias("_key"), c(value).alias("_value")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_key").orderBy("_value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    totals = counts.groupBy(c("_key").alias("_of")).agg(F.sum("_n").alias("_total"))
    ranked = counts.withColumn("_upto", upto).join(totals, c("_key").eqNullSafe(c("_of")))
    place = {out: (c("_total") - 1) * share for out, share in shares.items()}
    # the values at the places below and above: the first whose running count passes them
    at = lambda end: F.min(F.when(c("_upto") > end, c("_value")))
    found = ranked.groupBy(c("_key").alias(key), "_total").agg(*[at(end(p)).alias(f"_{name}_{out}") for out, p in place.items() for name, end in (("low", F.floor), ("high", F.ceil))])
    low, high = (lambda out: c(f"_low_{out}")), (lambda out: c(f"_high_{out}"))
    mixed = lambda out, p: F.when(low(out) == high(out), low(out)).otherwise((F.ceil(p) - p) * low(out) + (p - F.floor(p)) * high(out))
    return found.select(key, *[mixed(out, p).alias(out) for out, p in place.items()])


def soundtrack_measures(frames: DataFrame) -> DataFrame:
    """Seconds of speech, overlap and narration per job, and median and 95th percentile of the added level.

    ``frames`` has booleans source_speech, bed_speech and narration, and fade and added_rms.
    """
    c = F.col
    seconds = lambda what: rounded(F.count_if(what) * FRAME_SECONDS, 2)
    level = F.when(c("narration") & (c("fade") < 0.01), c("added_rms"))
    shares = {"median_narration_bed_rms": 0.5, "p95_narration_bed_rms": 0.95}
    levels = exact_percentiles(frames.select(c("job_id").alias("_job"), level.alias("_level")), shares, "_level", "_job")
    measured = frames.groupBy("job_id").agg(
        seconds(c("source_speech")).alias("source_speech_seconds"),
        seconds(c("source_speech") & c("bed_speech")).alias("bed_speech_overlap_seconds"),
        seconds(c("narration")).alias("narration_seconds"),
    )
    joined = measured.join(levels, c("job_id").eqNullSafe(c("_job")), "left")
    return joined.select(*measured.columns, *[F.coalesce(x, F.lit(0.0)).alias(x) for x in shares])


def _ascii_word(character: Column) -> Column:
    return F.coalesce(character.rlike("^[A-Za-z0-9]$"), F.lit(False))


def pack_utterances(pieces: DataFrame, strides: DataFrame) -> DataFrame:
    """One row per utterance of (job_id, utterance, idx, ordinal, text, start_s, end_s, source_text, speaker).

    Texts are trimmed and joined, with one space only between two ASCII letters or digits. The id is the
    first piece's cue plus its ordinal times the job's stride.
    """
    c = F.col
    row = F.struct("idx", "ordinal", strip(c("text")).alias("t"), "start_s", "end_s", "source_text", "speaker")
    packed = pieces.groupBy("job_id", "utterance").agg(F.array_sort(F.collect_list(row)).alias("p"))
    joined = F.aggregate(
        "p",
        F.lit(""),
        lambda a, x: F.concat(a, F.when(_ascii_word(F.right(a, F.lit(1))) & _ascii_word(F.left(x["t"], F.lit(1))), " ").otherwise(""), x["t"]),
    )
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    return packed.join(strides.select("job_id", "stride"), "job_id").select(
        "job_id", "utterance", (first["idx"] + first["ordinal"] * c("stride")).alias("utterance_id"), first["start_s"].alias("start_s"), last["end_s"].alias("end_s"),
        joined.alias("text"), first["source_text"].alias("source_text"), first["speaker"].alias("speaker"), F.size("p").alias("n_fragments"),
    )


def index_stride(segments: DataFrame) -> DataFrame:
    """(job_id, stride, unique_ids): the span of a job's cue numbers, and whether none repeats."""
    return segments.groupBy("job_id").agg((F.max("idx") - F.min("idx") + 1).alias("stride"), (F.count("*") == F.countDistinct("idx")).alias("unique_ids"))
