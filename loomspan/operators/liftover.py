"""Coordinates moved to another genome build through a chain's aligned blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 1 << 20


def lift_points(points: DataFrame, blocks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """chrom, pos, new_pos for the distinct points that a block holds.

    blocks: chain_id, score, chrom, block_start, block_end, new_start (of the
    first base, on the strand of new_strand), new_strand, new_length.  Of
    several blocks the one with the best chain decides, ties by chain_id.
    The chromosome isn't changed.
    """
    dealt = blocks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("block_start") / bucket), F.floor((F.col("block_end") - 1) / bucket))))
    at = points.select("chrom", "pos").distinct().withColumn("_b", F.floor(F.col("pos") / bucket))
    met = at.join(dealt, ["chrom", "_b"]).where("pos >= block_start and pos < block_end")
    forward = F.col("new_start") + F.col("pos") - F.col("block_start")
    moved = met.withColumn("new_pos", F.when(F.col("new_strand") == "-", F.col("new_length") - 1 - forward).otherwise(forward))
    return moved.groupBy("chrom", "pos").agg(F.max_by("new_pos", F.struct("score", -F.col("chain_id"))).alias("new_pos"))


def liftover(rows: DataFrame, blocks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """rows with new_start, new_end and status: ok, unmapped (an end has no place) or resized (length changes by over a tenth, or was 0)."""
    ends = rows.select("chrom", F.explode(F.array("cstart", "cend")).alias("pos"))
    lifted = lift_points(ends, blocks, bucket)
    out = rows
    for old, new in (("cstart", "new_start"), ("cend", "new_end")):
        out = out.join(lifted.select("chrom", F.col("pos").alias(old), F.col("new_pos").alias(new)), ["chrom", old], "left")
    before, after = F.col("cend") - F.col("cstart"), F.col("new_end") - F.col("new_start")
    status = F.when(F.col("new_start").isNull() | F.col("new_end").isNull(), "unmapped").when((before > 0) & (10 * F.abs(after - before) <= before), "ok").otherwise("resized")
    return out.withColumn("status", status)


def lifted(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """rows that could be lifted, in new coordinates."""
    ok = liftover(rows, blocks).where("status = 'ok'")
    return ok.select(*(F.col({"cstart": "new_start", "cend": "new_end"}.get(c, c)).alias(c) for c in rows.columns))


def liftover_log(judged: DataFrame, by: Sequence[str] = ("sample", "svtype")) -> DataFrame:
    """by, before, after, failed_liftover, failed_size_change and their percentages."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = judged.groupBy(*by).agg(F.count("*").alias("before"), is_("ok").alias("after"), is_("unmapped").alias("failed_liftover"), is_("resized").alias("failed_size_change"))
    pct = lambda c: F.col(c) * 100.0 / F.col("before")
    return out.withColumns({"pct_succeeded": pct("after"), "pct_failed_liftover": pct("failed_liftover"), "pct_failed_size_change": pct("failed_size_change")})


