"""Chat formatting with collapse of cumulative snapshots.

Logs often hold a conversation several times, each time a few turns longer. Every
conversation gets a rolling hash after each turn. One whose last hash is a
shorter conversation's place in a longer one is a snapshot: it is dropped by an anti-join with the proper
prefixes of all conversations, as are all but the first of equal ones. The
rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelsieve.storage import materialise

START, END = "<|im_start|>", "<|im_end|>"


def conversations_of(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: ``turns`` in order and ``hashes``, rolling, one for each turn.

    Repeated rows count once. Turns of one number are ordered by role, then
    text; null numbers come first; null roles and texts are empty. A
    conversation is one output string, so its turns meet in one row.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("turns"))

    def roll(hashes: Column, t: Column) -> Column:
        before = F.coalesce(F.try_element_at(hashes, F.lit(-1)), F.lit(""))
        framed = F.concat(before, F.length(t["role"]), F.lit(":"), t["role"], t["text"])
        return F.concat(hashes, F.array(F.sha2(framed, 256)))

    return grouped.withColumn(
        "hashes", F.aggregate("turns", F.array().cast("array<string>"), roll)
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """Conversations that are no prefix of a longer one, the smallest conv_id of equal ones."""
    ends = conversations.select(
        "conv_id", F.element_at("hashes", -1).alias("hash"), F.col("hashes").alias("all")
    )
    prefixes = ends.select(
        F.explode(F.slice("all", F.lit(1), F.size("all") - 1)).alias("hash")
    ).distinct()
    firsts = ends.groupBy("hash").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first")
    )
    kept = firsts.join(prefixes, "hash", "left_anti").select(F.col("first.conv_id").alias("conv_id"))
    return conversations.alias("c").join(
        kept.alias("k"), F.col("c.conv_id").eqNullSafe(F.col("k.conv_id")), "left_semi"
    )


def render(turns: Column | str) -> Column:
    """The turns in chat markup. Markup inside roles and texts is made harmless."""
    parts = F.transform(
        turns,
        lambda t: F.concat(
            F.lit(START), plain(t["role"]), F.lit("\n"), plain(t["text"]), F.lit(END + "\n")
        ),
    )
    return F.array_join(parts, "")


def plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``rendered`` of the maximal conversations.

    Other columns of the table are left out; an empty table gives no rows.
    """
    whole = materialise(conversations_of(turns), "conversations")
    return maximal(whole).select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), render("turns").alias("rendered")
    )
