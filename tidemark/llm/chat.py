"""Preference formatting: the common prefix of chosen and rejected conversations once, and the two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template; a turn is its header, text and end.
HEAD, TAIL = "<|{role}|>\n", "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(TAIL))


def masks(turns: Column) -> Column:
    """The spans (start, end in characters) of a completion that are trained on: texts and ends of assistants' turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + F.length(F.concat(F.lit("<|"), turn["role"], F.lit("|>\n")))
        end = state["at"] + F.length(rendered(turn))
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(state["out"], own)).otherwise(state["out"]).alias("out"))

    return F.aggregate(turns, start, step)["out"]


def preferences(turns: DataFrame) -> DataFrame:
    """One row per pair of `turns` (pair_id, side: 'chosen' or 'rejected', turn, role, text).

    Returns pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask and rejected_mask. The prompt is the longest common prefix of
    turns that agree in role and text; it is rendered once. Turns come by number; equal numbers by role and text; a null number first.
    Null roles and texts count as empty. Repeated rows are turns of their own. A side without turns is an empty conversation: then the
    prompt is empty and the other side is its completion whole. Rows of a null pair_id or another side form no pair and are left out. A row holds one
    pair's turns; one conversation is the unit of output, so it is never split.
    """
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    own = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select("pair_id", "side", turn.alias("turn_"))
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("turn_")))).alias(s)
    pairs = own.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    differ = lambda i: (F.get("chosen", i)["role"] != F.get("rejected", i)["role"]) | (F.get("chosen", i)["text"] != F.get("rejected", i)["text"])
    first = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), shorter - 1), differ), F.lit(0)), shorter)
    pairs = pairs.withColumn("n_prompt_turns", F.when(shorter == 0, 0).otherwise(first))
    n = F.col("n_prompt_turns")
    rest = lambda c: F.slice(F.col(c), n + 1, F.size(c))
    text = lambda a: F.array_join(F.transform(a, rendered), "")
    return pairs.select(
        "pair_id", "n_prompt_turns", text(F.slice("chosen", F.lit(1), n)).alias("prompt"), text(rest("chosen")).alias("chosen"), text(rest("rejected")).alias("rejected"),
        masks(rest("chosen")).alias("chosen_mask"), masks(rest("rejected")).alias("rejected_mask"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs of neighbouring conversations: the even conv_id is chosen, the odd one after it rejected."""
    pair = F.shiftright(F.col("conv_id").cast("long"), 1)
    return conversations.select(pair.alias("pair_id"), F.when(F.pmod(F.col("conv_id"), F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")


def digest(pairs: DataFrame) -> DataFrame:
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    return pairs.select("pair_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))
