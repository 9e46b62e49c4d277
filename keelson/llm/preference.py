"""Preference pairs: the common turns of chosen and rejected once as prompt, the rest as masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let


def render(turns: Column) -> Column:
    """``<|role|>\\n text <|end|>\\n`` of each turn, joined."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def mask(turns: Column) -> Column:
    """Character spans of a rendering that are trained on: text and end mark of the assistant's turns."""
    head = lambda t: F.length(t["role"]) + 5
    size = lambda t: head(t) + F.length(t["text"]) + 8
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda a, t: F.struct((a["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.array_append(a["spans"], F.struct((a["at"] + head(t)).alias("start"), (a["at"] + size(t)).alias("end")))).otherwise(a["spans"]).alias("spans"))
    return F.aggregate(turns, start, step, lambda a: a["spans"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) with side ``chosen`` or ``rejected`` -> one row a pair.

    prompt: the longest run of first turns equal in role and text on both sides, rendered once; chosen and
    rejected: the rendered rest; chosen_mask and rejected_mask: spans of each rest that count for the loss.
    The prompt and a completion put together are the rendering of that side. A null role or text is an empty
    string; turns sort by (turn, role, text), null turns first; a repeated row of a side (same turn, role and
    text) counts once; a pair with one side has an empty prompt unless both are empty. A conversation is
    one output row, so its turns meet in one task; nothing else does."""
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter(F.col("side").isin("chosen", "rejected"))
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, t)))
    rows = rows.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))

    def split(p):
        c, r = p["c"], p["r"]
        most = F.least(F.size(c), F.size(r))
        differs = lambda i: (F.get(c, i)["role"] != F.get(r, i)["role"]) | (F.get(c, i)["text"] != F.get(r, i)["text"])
        places = F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))
        n = F.coalesce(F.get(F.filter(places, differs), F.lit(0)), most)
        tail = lambda x, k: F.slice(x, k + 1, F.greatest(F.size(x) - k, F.lit(0)))
        return let(n, lambda k: F.struct(k.alias("n"), F.slice(c, 1, k).alias("p"), tail(c, k).alias("c"), tail(r, k).alias("r")))

    rows = rows.select("pair_id", let(F.struct("c", "r"), split).alias("s"))
    return rows.select(
        "pair_id", F.col("s.n").alias("prompt_turns"), render(F.col("s.p")).alias("prompt"),
        render(F.col("s.c")).alias("chosen"), mask(F.col("s.c")).alias("chosen_mask"), render(F.col("s.r")).alias("rejected"), mask(F.col("s.r")).alias("rejected_mask"),
    )


def pairs_of(conversations: DataFrame) -> DataFrame:
    """Pairs of every conversation (the table has none); turns without a conv_id are left to ``lone_turns``.

    Chosen: the conversation. Rejected: its turns before the last of the assistant, then the last one of the
    assistant in the neighbour conversation (ids 2k and 2k + 1), if there is one. A conversation without an
    assistant's turn has no rejected side."""
    c = conversations.select("conv_id", "turn", "role", "text").filter("conv_id is not null")
    last = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    reply = c.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("m"))
    reply = reply.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("m.text").alias("reply"))
    c = c.join(last, "conv_id", "left")
    chosen = c.select(F.col("conv_id").alias("pair_id"), F.lit("chosen").alias("side"), "turn", "role", "text")
    before = c.filter("turn < last").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), "turn", "role", "text")
    other = last.join(reply, "conv_id").select(F.col("conv_id").alias("pair_id"), F.lit("rejected").alias("side"), F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text"))
    return chosen.unionByName(before).unionByName(other)


def lone_turns(conversations: DataFrame) -> DataFrame:
    """Turns without a conv_id, each as a pair of its own with a chosen side only: nothing says which belong together."""
    turn = F.array(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    none = F.slice(turn, 1, 0)
    rows = conversations.filter("conv_id is null").select(F.col("conv_id").alias("pair_id"), turn.alias("c"), none.alias("p"))
    return rows.select(
        "pair_id", F.lit(0).alias("prompt_turns"), render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"), mask(F.col("c")).alias("chosen_mask"), render(F.col("p")).alias("rejected"), mask(F.col("p")).alias("rejected_mask"),
    )


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    out = format_pairs(pairs_of(conversations)).unionByName(lone_turns(conversations))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ";")
    return out.select(F.col("pair_id").alias("conv_id"), F.col("prompt_turns").cast("long"), "prompt", "chosen", "rejected", spans(F.col("chosen_mask")).alias("chosen_mask"), spans(F.col("rejected_mask")).alias("rejected_mask"))
