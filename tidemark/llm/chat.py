"""Preference pairs as one prompt and two masked completions, all in DataFrame functions.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role and text) is rendered once as the
prompt; the turns after it are rendered as the two completions. What is trained on are the texts of assistant turns
with their end marks, given as spans of characters in each completion; the prompt is masked whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string, text:string>>"


def turns(conversations: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """(pair_id, chosen, rejected) arrays of turns, from rows (turn, role, text); ``chosen`` says on which side a row is.

    Turns stand in order of turn, then role and text, nulls first. Null roles and texts are empty. A pair
    of which a side has no turns is left out.
    """
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    sides = conversations.groupBy(pair.alias("pair_id")).agg(
        F.collect_list(F.when(chosen, t)).alias("c"), F.collect_list(F.when(~chosen, t)).alias("r")
    )
    return sides.filter(F.col("pair_id").isNotNull() & (F.size("c") > 0) & (F.size("r") > 0)).select("pair_id", plain("c").alias("chosen"), plain("r").alias("rejected"))


def _text(x: Column) -> Column:
    """The marks of the format are broken up where a text holds them."""
    return F.replace(x["text"], F.lit("<|im_"), F.lit("<| im_"))


def rendered(side: str) -> Column:
    return F.array_join(F.transform(side, lambda x: F.concat(F.lit(OPEN), x["role"], F.lit("\n"), _text(x), F.lit(CLOSE))), "")


def spans(side: str) -> Column:
    """(start, end) in characters of the assistant's texts with end marks in the rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int, end:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + len(OPEN) + 1 + F.length(x["role"])
        end = start + F.length(_text(x)) + len(CLOSE)
        more = F.when(x["role"] == "assistant", F.concat(s["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(s["found"])
        return F.struct(end.alias("at"), more.alias("found"))

    return F.aggregate(side, zero, step, lambda s: s["found"])


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (chosen, rejected: arrays of role and text) with n_prompt_turns, prompt, chosen_completion, rejected_completion and
    chosen_spans, rejected_spans. Equal conversations are prompt alone, with empty completions and no spans."""
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b))
    n = F.when(F.array_contains("_same", False), F.array_position("_same", False).cast("int") - 1).otherwise(F.size("_same"))
    out = pairs.withColumn("_same", same).withColumn("n_prompt_turns", n)
    out = out.withColumns(
        {
            "_prompt": F.slice("chosen", F.lit(1), F.col("n_prompt_turns")),
            "_c": F.slice("chosen", F.col("n_prompt_turns") + 1, F.size("chosen")),
            "_r": F.slice("rejected", F.col("n_prompt_turns") + 1, F.size("rejected")),
        }
    )
    return out.withColumns(
        {
            "prompt": rendered("_prompt"),
            "chosen_completion": rendered("_c"),
            "rejected_completion": rendered("_r"),
            "chosen_spans": spans("_c"),
            "rejected_spans": spans("_r"),
        }
    ).drop("_same", "_prompt", "_c", "_r")


def listed(column: str) -> Column:
    """Spans as text: start-end, comma-separated."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")
