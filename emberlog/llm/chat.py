"""Preference pairs for chat models: one prompt, two completions, masks of what is learnt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The turn format: an opening with the role, the text, a closing.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Turns of this role are learnt.
LEARNT = "assistant"


def turns(rows: DataFrame, pair: Column, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a pair: its conversation's turns in order, as structs of role and text.

    Null roles and texts are empty; turns of an equal number are in order of role and
    text; rows of a null turn come first; rows of a null conversation are left out.  A
    conversation is one row, as a model reads it whole, so it must fit into a task.
    """
    t = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.filter(F.col(conv).isNotNull()).select(pair.alias("pair_id"), t.alias("t")).groupBy("pair_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def plain(part: Column) -> Column:
    """Roles and texts without openings and closings of turns: these get a backslash."""
    return F.regexp_replace(part, r"<\|(im_start|im_end)\|>", r"<\\|$1|>")


def rendered(t: Column) -> Column:
    return F.concat(F.lit(OPEN), plain(t["role"]), F.lit(MIDDLE), plain(t["text"]), F.lit(CLOSE))


def prefix(chosen: Column, rejected: Column) -> Column:
    """Number of turns from the first on that have equal role and text in both."""
    same = F.zip_with(
        F.slice(chosen, 1, F.least(F.size(chosen), F.size(rejected))),
        F.slice(rejected, 1, F.least(F.size(chosen), F.size(rejected))),
        lambda x, y: ((x["role"] == y["role"]) & (x["text"] == y["text"])).cast("int"),
    )
    first_other = F.array_position(same, 0)
    return F.when(first_other > 0, first_other - 1).otherwise(F.size(same)).cast("int")


def _spans(rest: Column) -> Column:
    """[from, to) in characters of the completion for each learnt turn, its closing included."""
    step = F.aggregate(
        rest,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from: int, to: int>>").alias("out")),
        lambda s, t: F.struct(
            (s["at"] + F.length(rendered(t))).alias("at"),
            F.when(
                t["role"] == LEARNT,
                F.concat(s["out"], F.array(F.struct((s["at"] + F.length(F.lit(OPEN + MIDDLE)) + F.length(plain(t["role"]))).cast("int").alias("from"), (s["at"] + F.length(rendered(t))).cast("int").alias("to")))),
            )
            .otherwise(s["out"])
            .alias("out"),
        ),
        lambda s: s["out"],
    )
    return step


def preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pair two sets of conversations (pair_id, turns) as prompt and masked completions.

    Returns pair_id, n_prompt_turns, prompt (the common turns, rendered once), chosen and
    rejected (the turns after them), and for each a mask: the spans [from, to) in
    characters that are learnt, those of assistant turns without their openings.  A pair
    without one of its conversations has no row; equal conversations give two empty
    completions; without a common turn the prompt is empty.  Where a role or text holds an
    opening or closing of turns, a backslash is put into it, so that it makes no turn.
    """
    both = chosen.select("pair_id", F.col("turns").alias("c")).join(rejected.select("pair_id", F.col("turns").alias("r")), "pair_id")
    both = both.withColumn("n", prefix(F.col("c"), F.col("r")))
    rest = {s: F.slice(F.col(s), F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))) for s in ("c", "r")}
    text = lambda t: F.array_join(F.transform(t, rendered), "")
    return both.select(
        "pair_id",
        F.col("n").alias("n_prompt_turns"),
        text(F.slice(F.col("c"), F.lit(1), F.col("n"))).alias("prompt"),
        text(rest["c"]).alias("chosen"),
        text(rest["r"]).alias("rejected"),
        _spans(rest["c"]).alias("chosen_mask"),
        _spans(rest["r"]).alias("rejected_mask"),
    )


def spans_text(mask: Column) -> Column:
    """Spans as text, as ``0-12,30-44``."""
    return F.array_join(F.transform(mask, lambda m: F.concat(m["from"].cast("string"), F.lit("-"), m["to"].cast("string"))), ",")
