"""Row checks and projections over media, URLs, options and recognized speech."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecue.functions.text import casefolded, strip

MAX_VIDEO_SECONDS = 7200
#: Hosts that are allowed by default, and accepted names of the target language.
ALLOWED_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "youtu.be", "bilibili.com", "www.bilibili.com", "b23.tv")
TARGET_LANGUAGE = "简体中文"
TARGET_ALIASES = ("简体中文", "中文", "普通话", "汉语", "简体", "zh", "zh-cn", "zh-hans", "zh-hans-cn", "chinese", "simplified chinese", "chinese (simplified)", "mandarin", "mandarin chinese")
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*"


def is_ip_address(host: Column) -> Column:
    """Whether a host, without brackets, is a valid address of either kind, and not only looks like one."""
    plain = F.regexp_replace(F.lower(host), "%[^%]+$", "")  # the zone
    groups6 = F.regexp_replace(plain, f":{_IP4}$", ":0:0")
    groups = F.filter(F.split(groups6, ":"), lambda x: x != "")
    short = groups6.contains("::")
    right = groups6.rlike("^[0-9a-f:]+$") & ~groups6.rlike(":::|::.*::|^:[^:]|[^:]:$") & F.forall(groups, lambda x: F.length(x) <= 4)
    return host.rlike(f"^{_IP4}$") | (host.contains(":") & right & F.when(short, F.size(groups) <= 7).otherwise(F.size(groups) == 8))


def check_source_urls(urls: DataFrame, url: str = "url", allowed: tuple[str, ...] = ALLOWED_HOSTS) -> DataFrame:
    """Add ``clean_url`` and ``reason``: the trimmed URL, or the first rule that it breaks.

    Rules in order: scheme http or https, no credentials, a host, no IP address, a host on the list. A URL
    that cannot be parsed (none at all, or brackets that hold no address) breaks the first.
    """
    clean = strip(F.col(url))
    whole = F.regexp_replace(clean, "[\\t\\r\\n]", "")
    authority = F.regexp_extract(whole, f"{_SCHEME}://([^/?#]*)", 1)
    place = F.regexp_extract(authority, "([^@]*)$", 1)
    bracketed = F.regexp_extract(place, "\\[([^\\]]*)\\]", 1)
    torn = place.rlike("[\\[\\]]") & ~(place.rlike("^\\[[^\\[\\]]*\\](?::[^:]*)?$") & is_ip_address(bracketed))
    host = F.regexp_replace(F.lower(F.when(place.startswith("["), bracketed).otherwise(F.regexp_extract(place, "^([^:]*)", 1))), r"\.+$", "")
    scheme = F.lower(F.regexp_extract(whole, f"({_SCHEME}):", 1))
    reason = (
        F.when(~F.coalesce(scheme.isin("http", "https") & ~torn, F.lit(False)), "scheme")
        .when(~F.regexp_extract(authority, "^(.*)@", 1).isin("", ":"), "credentials")
        .when(host == "", "host")
        .when(is_ip_address(host), "ip address")
        .when(~host.isin(*[h.strip().lower() for h in allowed]), "not allowed")
    )
    return urls.withColumn("reason", reason).withColumn("clean_url", F.when(F.col("reason").isNull(), clean))


def duration_gate(media: DataFrame, duration: str = "duration", probed: bool = False, limit: int = MAX_VIDEO_SECONDS) -> DataFrame:
    """Add ``too_long``: before download by whole seconds, where null and 0 pass; after probing by any excess."""
    d = F.col(duration)
    value = d if probed else F.coalesce(d.cast("int"), F.lit(0))
    return media.withColumn("too_long", F.coalesce(value > limit, F.lit(False)))


def media_metadata(media: DataFrame) -> DataFrame:
    """Public facts of single videos; playlists are dropped, empty values fall back to the URL and file stem."""
    c = F.col
    filled = lambda name, other: F.coalesce(F.nullif(c(name), F.lit("")), c(other))
    single = media.where(~F.coalesce(c("_type").isin("playlist", "multi_video"), F.lit(False)))
    return single.select(
        "job_id", F.lit("remote").alias("source_type"), "extractor", filled("webpage_url", "url").alias("webpage_url"),
        "duration", "uploader", "id", filled("title", "file_stem").alias("title"),
    )


def clean_asr_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    """Trim recognized text, drop empty rows, and repair times; positions stay, with gaps."""
    c = F.col
    trimmed = rows.withColumn(text, strip(c(text))).where(c(text) != "")
    return trimmed.withColumns({"start_s": F.greatest(F.lit(0.0), c("start_s")), "end_s": F.greatest(c("end_s"), c("start_s") + 0.05)})


def check_cue_times(cues: DataFrame, total: str | None = "total_s", order: str = "idx") -> DataFrame:
    """Clip ends to the media and give every cue a ``reason`` (null if sound) and ``job_ok`` for its whole job."""
    c = F.col
    per_job = Window.partitionBy("job_id")
    in_order = per_job.orderBy(order, "start_s", "end_s")
    end = F.least("end_s", total) if total else c("end_s")
    bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    checked = cues.withColumn("end_s", end).withColumn("_before", F.coalesce(F.lag("start_s").over(in_order), F.lit(0.0)))
    checked = checked.withColumn("_same", F.count("*").over(Window.partitionBy("job_id", "idx")))
    wrong = F.coalesce(bad(c("start_s")) | bad(c("end_s")) | (c("start_s") < c("_before")) | (c("end_s") <= c("start_s")), F.lit(True))
    reason = F.when(c("_same") > 1, "duplicate").when(wrong, "times")
    checked = checked.withColumn("reason", reason).drop("_before", "_same")
    return checked.withColumn("job_ok", F.count("reason").over(per_job) == 0)


def media_facts(probes: DataFrame, probe: str = "probe") -> DataFrame:
    """duration (null if it cannot be read, is not finite or not positive), has_audio and audio_duration of probes.

    ``probe`` is a struct with ``format.duration`` and ``streams`` of codec_type and duration.
    """
    c = F.col
    streams = c(f"{probe}.streams")
    stated = F.coalesce(c(f"{probe}.format.duration"), F.get(F.filter(F.transform(streams, lambda s: s["duration"]), lambda d: d.isNotNull()), F.lit(0)))
    value = stated.try_cast("double")
    good = (value > 0) & (value < float("inf"))
    facts = probes.withColumn("duration", F.when(good, value)).withColumn("has_audio", F.coalesce(F.exists(streams, lambda s: F.coalesce(s["codec_type"] == "audio", F.lit(False))), F.lit(False)))
    return facts.withColumn("audio_duration", F.when(c("has_audio"), c("duration")))


def is_english(detected: Column, requested: Column) -> Column:
    """Whether the detected language, or the requested one where none is detected, is a kind of English."""
    named = F.coalesce(F.nullif(detected, F.lit("")), requested, F.lit(""))
    return F.substring_index(F.translate(F.lower(named), "_", "-"), "-", 1) == "en"


def normalize_target_language(jobs: DataFrame, language: str = "language") -> DataFrame:
    """Add ``target_language``: the one value that all accepted aliases stand for; null if not accepted."""
    plain = F.regexp_replace(strip(F.translate(casefolded(F.col(language)), "_", "-")), r"(?U)[\s\x1c-\x1f]+", " ")
    return jobs.withColumn("target_language", F.when(plain.isin(*TARGET_ALIASES), F.lit(TARGET_LANGUAGE)))


def effective_options(jobs: DataFrame, defaults: dict[str, bool]) -> DataFrame:
    """A job's own options where it has them, the settings elsewhere."""
    return jobs.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def job_report(jobs: DataFrame, errors: DataFrame, log_root: str = "jobs") -> DataFrame:
    """One row per job; with an error the status is failed and the output paths are hidden.

    ``errors`` has (job_id, run_error) for jobs whose last run failed.
    """
    c = F.col
    joined = jobs.join(errors, "job_id", "left")
    shown = {p: F.when(c("run_error").isNull(), c(p)) for p in ("output_path", "subtitle_path", "english_subtitle_path")}
    return joined.withColumns(shown).select(
        "job_id", F.when(c("run_error").isNotNull(), "failed").otherwise(c("status")).alias("status"), "failed_stage",
        F.coalesce("run_error", "error").alias("error"), "segments_path", "translations_path", *shown,
        F.concat(F.lit(log_root), F.lit("/"), c("job_id").cast("string"), F.lit("/pipeline.log")).alias("log_path"), "detected_language",
    )


def passthrough_translation(segments: DataFrame, text: str = "text") -> DataFrame:
    """The source text as its own translation."""
    return segments.withColumn("translated_text", F.col(text))
