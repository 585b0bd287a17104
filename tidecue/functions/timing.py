"""Time functions on columns: durations, reading limits, clipping and tempo plans. Times are double seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_DURATION = 0.05
CHARACTERS_PER_SECOND = 4.5
TAIL_SECONDS = 0.18


def cue_duration(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(LEAST_DURATION), end - start)


def max_zh_chars(start: Column, end: Column) -> Column:
    """Characters that can be read aloud in a cue."""
    return F.greatest(F.lit(4), (cue_duration(start, end) * CHARACTERS_PER_SECOND).cast("int"))


def clip_interval(start: Column, end: Column, duration: Column) -> tuple[Column, Column]:
    """Both ends within [0, duration]; the caller drops what is empty."""
    return F.greatest(F.lit(0.0), start), F.least(duration, end)


def measured_seconds(file_seconds: Column, word_end: Column) -> Column:
    """Length of speech in a clip: up to a short tail after its last word, if that is known and earlier."""
    trims = (word_end > 0) & (word_end < file_seconds - TAIL_SECONDS)
    return F.when(trims, word_end + TAIL_SECONDS).otherwise(file_seconds)


def applied_tempo(required: Column, limit: float, strict: bool = True) -> Column:
    """How much a clip is sped up; lenient mode leaves 2 % alone."""
    return F.when(required > (1.0 if strict else 1.02), F.least(required, F.lit(limit))).otherwise(F.lit(1.0))


def tempo_chain(factor: Column) -> Column:
    """A filter chain of factors within [0.5, 2]; null where the factor is not positive.

    The number of halvings (or doublings) is the ceiling of the logarithm; since halving a double is exact,
    the remainder equals that of repeated division.
    """
    steps = lambda x: F.greatest(F.lit(0), F.ceil(F.log2(x))).cast("int")
    n = F.when(factor > 2, steps(factor / 2)).when((factor > 0) & (factor < 0.5), steps(0.5 / factor)).otherwise(F.lit(0))
    whole = F.when(factor > 2, F.lit(2.0)).otherwise(F.lit(0.5))
    parts = F.concat(F.array_repeat(whole, n), F.array(factor / F.pow(whole, n)))
    return F.when(factor > 0, F.array_join(F.transform(parts, lambda p: F.format_string("atempo=%.6f", p)), ","))


def rounded(x: Column, places: int) -> Column:
    """Rounded as Python rounds: to the nearest decimal of the number that a double is exactly, halves to even.

    The product with 10**places is rounded to a double; where that looks like a half, what the rounding lost
    decides. The loss is exact: both parts of a double have few enough digits to be multiplied without error.
    """
    scale = 10.0**places
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    lost = (high * scale - product) + (x - high) * scale
    whole = F.rint(product)
    rest = product - whole
    mended = whole + F.when((rest == 0.5) & (lost > 0), 1.0).when((rest == -0.5) & (lost < 0), -1.0).otherwise(0.0)
    return F.when(F.abs(product) < 2.0**52, mended / scale).otherwise(x)
