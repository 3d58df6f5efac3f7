"""Exact duplicates by progressive refinement, in DataFrame operations only.

Rows are first grouped by the length of their normalised text, what survives
(groups of two and more) by a hash of the first characters, and only what
survives that by the digest of the whole text.  Rows that fall out at any
step are alone and need no further comparison.

Lengths and first characters are counted in one reading.  The second reading
goes to the whole texts of surviving groups only: a sieve of those rows,
tested where the text is read, lets few others through, so texts never move
between executors and few are digested in vain (with more than the sieve can hold,
all are digested and the join alone decides).  Every grouping adds up
before it shuffles, so a text that a third of all rows share costs one row
per task; steps that join on a length are dealt out by the first characters
too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut, keep, sieve, tagged

#: Characters whose hash decides the second step, and parts into which the rows of a length are dealt.
PREFIX = 64
PARTS = 16


def normalised(text):
    """Null is empty; every run of white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest(text):
    """SHA-256 of the normalised text in UTF-8, in lower-case hex."""
    return F.sha2(normalised(text), 256)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_tag, keep_id, group_size, kept.

    Of equal texts the row with the smallest doc_id stays.  Null text equals
    empty text; a null doc_id sorts last; of rows that repeat both doc_id and
    text one stays (row_tag, unique in the result, tells them apart).  Texts
    of any length are compared whole.  An empty table gives an empty result.
    Other columns of docs are not read and may have any name.
    """
    rows = tagged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    length, head = F.octet_length("whole").alias("length"), F.xxhash64(F.substring("whole", 1, PREFIX)).alias("head")
    whole = rows.select("doc_id", "row_tag", normalised(F.col("text")).alias("whole"))
    keys = keep(whole.select("doc_id", "row_tag", length, head))
    heads = cut(keys.groupBy("length", "head").agg(F.count("*").alias("n")))
    step1 = heads.groupBy("length").agg(F.sum("n").alias("all")).where("all > 1").select("length", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    step2 = heads.withColumn("part", F.pmod("head", F.lit(PARTS)).cast("int")).join(step1, ["length", "part"], "left_semi").where("n > 1")
    left = cut(keys.join(step2.select("length", "head"), ["length", "head"], "left_semi"))
    read = rows.select("row_tag", "text").where(sieve(left, "row_tag")).select("row_tag", F.unhex(digest(F.col("text"))).alias("sha"))
    left = keep(left.join(read, "row_tag"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row_tag").alias("tag"))).alias("first")
    groups = cut(left.groupBy("length", "head", "sha").agg(F.count("*").alias("n"), first).where("n > 1"))
    found = left.select("row_tag", "length", "head", "sha").join(groups, ["length", "head", "sha"]).select("row_tag", "n", "first")
    alone = F.col("n").isNull()
    return keys.select("doc_id", "row_tag").join(found, "row_tag", "left").select(
        "doc_id",
        "row_tag",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_tag") == F.col("first.tag"))).alias("kept"),
    )
