"""Preference pairs rendered for training, in DataFrame operations only.

The turns of a chosen and of a rejected conversation meet by pair id in one
grouping.  Their longest common turn prefix is rendered once as the prompt;
what follows on either side is a completion with a mask: the character spans
of assistant text, on which alone a loss should be taken.

A pair is one output row, so its turns are gathered in one place by the
nature of the result; different pairs are independent and nothing else is
grouped, so a first turn that many conversations share isn't a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|", "|>"
END = "<|end|>"
TRAINED_ROLE = "assistant"


def _clean(text: Column) -> Column:
    """Null is empty; a marker inside a text is broken up, so no text can forge a turn."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _clean(t["role"]), F.lit(CLOSE + "\n"))


def _body(t: Column) -> Column:
    return F.concat(_clean(t["text"]), F.lit(END + "\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Spans (start, stop) in characters of the rendered turns on which a loss is taken: assistant text and its end marker."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def step(state, t):
        begin = state["at"] + F.char_length(_head(t))
        stop = begin + F.char_length(_clean(t["text"])) + len(END)
        span = F.struct(begin.alias("start"), stop.alias("stop"))
        more = F.when(F.coalesce(t["role"] == TRAINED_ROLE, F.lit(False)), F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((stop + 1).alias("at"), more.alias("spans"))

    return F.aggregate(turns, start, step, lambda s: s["spans"])


def preference_format(chosen: DataFrame, rejected: DataFrame, pair_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair id found on either side: pair id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask, informative.

    Turns go by number, ties by role and text; repeated rows count as they
    come.  Null turns sort first; a null role or text renders empty and equals
    only null.  A side without turns has an empty completion.  If both sides
    agree in all turns the completions are empty and informative is false.
    Null pair ids are one pair.  Extra columns are ignored.
    """

    def side(df: DataFrame, n: int) -> DataFrame:
        return df.select(F.col(pair_id).alias("_id"), F.struct(F.lit(n).alias("side"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("_t"))

    both = side(chosen, 0).unionByName(side(rejected, 1)).groupBy("_id").agg(F.array_sort(F.collect_list("_t")).alias("_all"))
    c, r = F.filter("_all", lambda t: t["side"] == 0), F.filter("_all", lambda t: t["side"] == 1)
    pairs = both.select("_id", c.alias("_c"), r.alias("_r"))
    agree = F.zip_with("_c", "_r", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]), F.lit(False)))
    first_off = F.array_position(F.array_append(agree, F.lit(False)), False)
    pairs = pairs.withColumn("_n", (first_off - 1).cast("int"))
    rest = lambda side: F.slice(side, F.col("_n") + 1, F.greatest(F.size(side) - F.col("_n"), F.lit(0)))
    pairs = pairs.select("_id", "_n", F.slice("_c", F.lit(1), F.col("_n")).alias("_p"), rest("_c").alias("_c"), rest("_r").alias("_r"))
    return pairs.select(
        F.col("_id").alias(pair_id),
        F.col("_n").cast("long").alias("n_common"),
        rendered(F.col("_p")).alias("prompt"),
        rendered(F.col("_c")).alias("chosen"),
        rendered(F.col("_r")).alias("rejected"),
        mask(F.col("_c")).alias("chosen_mask"),
        mask(F.col("_r")).alias("rejected_mask"),
        ((F.size("_c") > 0) | (F.size("_r") > 0)).alias("informative"),
    )
