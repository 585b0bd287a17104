"""Text functions on columns: subtitle text and time stamps, names, keys, spoken characters, JSON in replies."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space in the sense of Python's strip(): Unicode's, and the four separators U+001C to U+001F.
_SPACE = r"[\s\x1c-\x1f]"
#: Line breaks in the sense of Python's splitlines(); a carriage return and a line feed are one.
_LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null or holds white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def srt_timestamp(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``, rounded half to even; negative times count as zero, hours may pass 99."""
    ms = F.greatest(F.lit(0), F.rint(seconds * 1000)).cast("long")
    whole = lambda x, n: F.floor(x / n).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", whole(ms, 3_600_000), whole(ms % 3_600_000, 60_000), whole(ms % 60_000, 1000), ms % 1000)


def subtitle_text(translated: Column, source: Column) -> Column:
    """The translation, or the source where there is none, as one trimmed line."""
    return F.regexp_replace(strip(F.coalesce(F.nullif(translated, F.lit("")), source)), _LINE_BREAK, " ")


def safe_output_name(title: Column, job_id: Column) -> Column:
    """A file name from a title: at most 80 characters and 200 bytes, and the job's first 8 characters."""
    cleaned = F.left(F.regexp_replace(title, r"(?U)[^\w\x{4e00}-\x{9fff}.-]+", "-"), F.lit(80))
    fitting = lambda x: F.array_max(F.filter(F.sequence(F.lit(0), F.lit(80)), lambda n: F.octet_length(F.left(x, n)) <= 200))
    # an element of an array: inside the inner lambda the title would be cleaned again for every length
    cut = F.get(F.transform(F.array(cleaned), lambda x: F.left(x, fitting(x))), F.lit(0))
    name = F.nullif(F.regexp_replace(cut, "^[-._]+|[-._]+$", ""), F.lit(""))
    return F.concat(F.coalesce(name, F.lit("translated-video")), F.lit("-"), F.left(job_id, F.lit(8)), F.lit(".mp4"))


@F.pandas_udf(StringType())
def _spoken(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else "".join(x for x in unicodedata.normalize("NFKC", t).casefold() if x.isalnum()))


#: Characters that lower-casing folds, once ß is written as ss, and that neither compose nor come apart, but for punctuation
#: that comes apart into punctuation: Latin, ideographs, kana, and usual marks. Few ranges, since each character is tried on them in turn.
SIMPLE = (
    "\\x00-\\x7f\\xa1\\xa7\\xa9\\xab\\xae\\xb0\\xb6\\xb7\\xbb\\xbf-\\xff\\u0100-\\u012f\\u0131\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e"
    "\\u2010-\\u2016\\u2018-\\u201f\\u2026\\u4e00-\\u9fef\\u3001-\\u3003\\u3008-\\u3011\\u3041-\\u3096\\u30a1-\\u30fe\\u3400-\\u4db5\\uff01\\uff08\\uff09\\uff0c\\uff0e\\uff1a\\uff1b\\uff1f"
)


def _simple(text: Column) -> Column:
    return text.rlike(rf"\A[{SIMPLE}]*\z")


def _lowered(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def simply_spoken(text: Column) -> Column:
    """The spoken characters of simple texts; null for others."""
    return F.when(_simple(text), F.regexp_replace(_lowered(text), r"[^\p{L}\p{N}]", ""))


def spoken_characters(text: Column) -> Column:
    """Letters and numbers of the compatibility-normalized and case-folded text; only texts that are not simple go through Python."""
    return F.coalesce(simply_spoken(text), _spoken(F.when(~_simple(text), text)))


def is_spoken(character: str) -> bool:
    """Whether a character is a letter or number, or its compatibility form holds one."""
    return character.isalnum() or any(x.isalnum() for x in unicodedata.normalize("NFKC", character))


@lru_cache
def _formed_ranges() -> str:
    """Characters that are no letters or numbers, but whose compatibility form holds some, as a part of a regex class."""
    found = [i for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and not chr(i).isalnum() and is_spoken(chr(i))]
    known = set(found)
    ends = zip([i for i in found if i - 1 not in known], [i for i in found if i + 1 not in known], strict=True)
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ends)


def has_spoken(text: Column) -> Column:
    """Whether a text has spoken characters: letters or numbers, also in compatibility forms."""
    # most texts have the former; the class of the latter is long and tested only if need be
    return text.rlike(r"[\p{L}\p{N}]") | text.rlike(f"[{_formed_ranges()}]")


def spoken_weight(text: Column) -> Column:
    """Number of spoken characters, 1 at least."""
    return F.greatest(F.lit(1), F.length(spoken_characters(text)))


def casefolded(text: Column) -> Column:
    """Case-folded; only texts beyond simple ones go through Python."""
    return F.when(_simple(text), _lowered(text)).otherwise(_casefolded(F.when(~_simple(text), text)))


def word_characters(text: Column) -> Column:
    """Case-folded word characters (letters, numbers, underscores), to compare the end of a text with a heard word."""
    return casefolded(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))


@F.pandas_udf(StringType())
def _casefolded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def json_object_text(reply: Column) -> Column:
    """The object in a reply: without a code fence, from the first ``{`` to the last ``}``; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(strip(reply), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def json_object(reply: Column) -> Column:
    """The object in a reply as a variant; null where it is missing, invalid or no object."""
    value = F.try_parse_json(json_object_text(reply))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value)


def speech_key(model: str, voice: str, speed: float, text: Column) -> Column:
    """Content key of a synthesized clip."""
    return F.sha2(F.concat(F.lit(f"{model}/{voice}/{speed!r}"), F.char(F.lit(0)), text), 256)
