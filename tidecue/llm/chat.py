"""Chat formatting of preference data: a shared prompt and two completions with character masks.

A row holds the turns of a chosen and of a rejected conversation. Their longest common prefix of turns is
rendered once as the prompt; what follows is rendered as one completion each. A mask lists the spans of a
completion that are trained on: the contents of assistant turns with their end mark.

Texts are rendered as they are: a turn marker inside a text is not escaped, and a tokenizer that reads markers
as special tokens would take it for one. ``has_markers`` finds such rows, for callers that want to leave them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def gather_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row per conversation with its turns in order, as ``array<struct<role,text>>``.

    Null roles and texts count as empty; turns of equal number are ordered by role and text. A conversation
    is one output row, so its turns meet in one task whatever is done.
    """
    c = F.col
    turn = F.struct(c(order), F.coalesce(c("role"), F.lit("")).alias("role"), F.coalesce(c("text"), F.lit("")).alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return turns.where(c(key).isNotNull()).groupBy(key).agg(ordered.alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two conversations have in common from the start."""
    least = F.least(F.size(a), F.size(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: (i <= least) & (F.get(a, i - 1) != F.get(b, i - 1)))
    return F.coalesce(F.get(differ, F.lit(0)) - 1, least)


def render(turns: Column) -> Column:
    """Turns as one text, each with its role and an end mark."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE + "\n"))), "")


def has_markers(turns: Column) -> Column:
    """Whether a role or text of the turns holds a turn marker."""
    return F.exists(turns, lambda t: F.contains(t["text"], F.lit(OPEN)) | F.contains(t["text"], F.lit(CLOSE)) | F.contains(t["role"], F.lit(OPEN)) | F.contains(t["role"], F.lit(CLOSE)))


def mask(turns: Column) -> Column:
    """Spans (start, end) in characters of the rendered turns that are trained on."""
    head = len(OPEN) + 1
    tail = len(CLOSE) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + head + F.length(t["role"])
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((begin + F.length(t["text"]) + tail).cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_preferences(pairs: DataFrame, key: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Prompt, completions and masks of every pair.

    Null turn arrays count as empty. Equal conversations give a prompt and two empty completions.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    split = pairs.select(F.col(key), a.alias("a"), b.alias("b"), common_prefix(a, b).cast("int").alias("n_prompt_turns"))
    rest = lambda x: F.slice(x, F.col("n_prompt_turns") + 1, F.greatest(F.size(x) - F.col("n_prompt_turns"), F.lit(0)))
    return split.select(
        key, "n_prompt_turns",
        render(F.slice("a", F.lit(1), F.col("n_prompt_turns"))).alias("prompt"),
        render(rest("a")).alias("chosen"), render(rest("b")).alias("rejected"),
        mask(rest("a")).alias("chosen_mask"), mask(rest("b")).alias("rejected_mask"),
    )


def echo_pairs(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """Preference pairs from plain conversations: the rejected one ends in a reply that only repeats the user.

    The text of the last assistant turn is replaced by that of the turn before it (empty if it is the first
    turn). A conversation without an assistant turn is paired with itself.
    """
    rows = gather_turns(conversations, key)
    last = F.size("turns") - F.array_position(F.transform(F.reverse("turns"), lambda t: t["role"]), "assistant").cast("int")
    found = F.exists("turns", lambda t: t["role"] == "assistant")
    rows = rows.withColumn("last", F.when(found, last).otherwise(F.lit(-1)))
    before = F.coalesce(F.get("turns", F.col("last") - 1)["text"], F.lit(""))
    rejected = F.transform("turns", lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), before.alias("text"))).otherwise(t))
    return rows.select(key, F.col("turns").alias("chosen"), rejected.alias("rejected"))
