"""Preference formatting: a shared prompt, and a chosen and a rejected completion.

The chosen and the rejected conversation of a pair are compared turn by turn. The longest
common prefix of turns is rendered once as the prompt; what follows in each is rendered as
its completion, with the character spans that a loss counts: the text of assistant turns.
DataFrame functions only.

Scale: turns meet their counterparts by (pair, turn), and the first turn that differs is
a partial minimum per pair, so a pair of very many turns is no hot key. The rendered
conversation is put together per conversation, which is the size of the output row.

Defined cases: turns are ordered by their number, gaps count for nothing. A turn with no
counterpart differs from it. Null role or text is an empty string. Repeated turns of a
number are one, the one that sorts first. Rows with a null pair or side take no part; a
pair with one side only has an empty prompt and a null completion for the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worktide.llm.frames import named

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"


def rendered(role: Column, text: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), role, F.lit(after), text, F.lit(CLOSE))


def lead_chars(role: Column) -> Column:
    return F.char_length(role) + len(OPEN) - len("{role}")


def _joined(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Rendered text and spans of assistant text, for the turns of each key in order."""
    whole = turns.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    whole = whole.withColumn("parts", F.transform("turns", lambda t: rendered(t["role"], t["text"])))
    # Where each turn starts: a running sum of the lengths of those before.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + lead_chars(turn["role"])
        end = begin + F.char_length(turn["text"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(turn["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    return whole.select(*keys, F.array_join("parts", "").alias("text"),
                        F.aggregate("turns", start, step)["spans"].alias("mask"), F.size("turns").alias("n"))


def preference_pairs(
    turns: DataFrame,
    pair_col: str,
    side_col: str,
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row for each pair: (pair, prompt, prompt_turns, chosen, chosen_mask, rejected, rejected_mask).

    `side_col` is true for turns of the chosen conversation, false for the rejected. Masks
    are arrays of (start, end) in characters of the completion.
    """
    rows = named(turns, pair=pair_col, side=side_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.filter("pair IS NOT NULL AND side IS NOT NULL").select(
        "pair", "side", "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.groupBy("pair", "side", "turn").agg(F.min(F.struct("role", "text")).alias("said"))
    rows = rows.select("pair", "side", "turn", "said.role", "said.text")
    # A turn is shared when both sides have it alike; the first other one ends the prompt.
    alike = rows.groupBy("pair", "turn").agg(
        F.count_distinct(F.struct("role", "text")).alias("kinds"), F.count(F.lit(1)).alias("sides"))
    ends = alike.groupBy("pair").agg(
        F.min(F.struct("turn")).alias("any"),
        F.min(F.when((F.col("kinds") > 1) | (F.col("sides") < 2), F.struct("turn"))).alias("first"))
    placed = rows.join(ends.select("pair", "first"), "pair")
    before = F.col("first").isNull() | (F.struct("turn") < F.col("first"))
    prompt = _joined(placed.filter(before & F.col("side")), ["pair"])
    rest = _joined(placed.filter(~before), ["pair", "side"])
    sides = rows.groupBy("pair").agg(F.bool_or("side").alias("yes"), F.bool_or(~F.col("side")).alias("no"))
    good = rest.filter("side").select("pair", F.col("text").alias("good"), F.col("mask").alias("good_mask"))
    bad = rest.filter("NOT side").select("pair", F.col("text").alias("bad"), F.col("mask").alias("bad_mask"))
    start = prompt.select("pair", F.col("text").alias("prompt"), F.col("n").alias("prompt_turns"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return sides.join(start, "pair", "left").join(good, "pair", "left").join(bad, "pair", "left").select(
        "pair", F.coalesce("prompt", F.lit("")).alias("prompt"),
        F.coalesce("prompt_turns", F.lit(0)).alias("prompt_turns"),
        F.when(F.col("yes"), F.coalesce("good", F.lit(""))).alias("chosen"),
        F.when(F.col("yes"), F.coalesce("good_mask", none)).alias("chosen_mask"),
        F.when(F.col("no"), F.coalesce("bad", F.lit(""))).alias("rejected"),
        F.when(F.col("no"), F.coalesce("bad_mask", none)).alias("rejected_mask"))
