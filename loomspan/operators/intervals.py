"""Interval algebra on DataFrames.

Intervals are 0-based and half open in the columns chrom, cstart, cend; any
further key columns (sample, svtype ...) are given by name.  Intervals that
are empty or have a null bound meet nothing.

Spark has no interval join: an equi-join on the keys alone compares all
intervals of a group.  The joins here put a place into the join key, chosen
so that every true pair meets exactly once and few false ones do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the smaller side up to which an exclusion list is sent to all tasks.
BROADCAST_ROWS = 500_000
REGION_BUCKET = 1 << 17


def length(prefix: str = "") -> Column:
    return F.col(f"{prefix}cend") - F.col(f"{prefix}cstart")


def overlap(a: str, b: str) -> Column:
    return F.least(F.col(f"{a}cend"), F.col(f"{b}cend")) - F.greatest(F.col(f"{a}cstart"), F.col(f"{b}cstart"))


def proper(df: DataFrame) -> DataFrame:
    return df.where("cend > cstart and chrom is not null")


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _power(level: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def reciprocal_join(a: DataFrame, b: DataFrame, on: Sequence[str] = (), fraction: float = 0.5, extra: Column | None = None) -> DataFrame:
    """Pairs (columns a_*, b_*) whose overlap is at least `fraction` of either interval, with equal chrom and `on` columns.

    For a fraction of 0.5 and more the lengths of a pair differ by at most a
    factor of two and b starts between half of b's length before and half of
    a's after a's start.  So b is keyed once, by the power of two of its
    length and the place of its start in steps of that power; a looks up the
    two or three places each in the three powers that can match.  Work
    follows the number of intervals of like size at a place, whatever the
    lengths, and a crowded group is split by place.
    """
    if not 0.5 <= fraction <= 1:
        raise ValueError("fraction must be from 0.5 to 1; use overlap_join for less")
    level = lambda n: F.floor(F.log2(n.cast("double"))).cast("int")
    left = _renamed(proper(a), "a_").withColumn("_l", level(length("a_")))
    left = left.withColumn("_level", F.explode(F.sequence(F.col("_l") - 1, F.col("_l") + 1))).where("_level >= 0")
    step = _power(F.col("_level") + 1)
    first, last = F.floor((F.col("a_cstart") - _power(F.col("_level"))) / step), F.floor((F.col("a_cstart") + length("a_") / 2) / step)
    left = left.withColumn("_place", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    right = _renamed(proper(b), "b_").withColumn("_lb", level(length("b_")))
    right = right.withColumn("_pb", F.floor(F.col("b_cstart") / _power(F.col("_lb") + 1)).cast("long"))
    meet = (F.col("_level") == F.col("_lb")) & (F.col("_place") == F.col("_pb"))
    for k in ("chrom", *on):
        meet &= F.col(f"a_{k}") == F.col(f"b_{k}")
    ov = overlap("a_", "b_")
    num, den = fraction.as_integer_ratio()
    enough = (ov * den >= length("a_") * num) & (ov * den >= length("b_") * num)
    return left.join(right, meet & enough & (F.lit(True) if extra is None else extra)).drop("_l", "_level", "_place", "_lb", "_pb")


def overlap_join(a: DataFrame, b: DataFrame, on: Sequence[str] = (), bucket: int = 100_000) -> DataFrame:
    """All pairs (a_*, b_*) that share a base: both sides are dealt to the buckets they touch and a pair counts in the bucket of the later start."""

    def dealt(df: DataFrame, p: str) -> DataFrame:
        return _renamed(proper(df), p).withColumn(f"_{p}", F.explode(F.sequence(F.floor(F.col(p + "cstart") / bucket), F.floor((F.col(p + "cend") - 1) / bucket))))

    meet = F.col("_a_") == F.col("_b_")
    for k in ("chrom", *on):
        meet &= F.col(f"a_{k}") == F.col(f"b_{k}")
    once = F.col("_a_") == F.floor(F.greatest("a_cstart", "b_cstart") / bucket)
    return dealt(a, "a_").join(dealt(b, "b_"), meet & once & (overlap("a_", "b_") > 0)).drop("_a_", "_b_")


def without_covered(calls: DataFrame, regions: DataFrame, bucket: int = REGION_BUCKET) -> DataFrame:
    """calls of which no single region covers half or more.

    A region that covers half of a call covers one of its two middle bases,
    so each call is looked up at those two places and never multiplied.  The
    regions are sent to all tasks only if their dealt-out rows are counted to
    be BROADCAST_ROWS at most; beyond that the anti-joins shuffle.
    """
    dealt = _renamed(proper(regions).select("chrom", "cstart", "cend"), "r_").withColumn("_b", F.explode(F.sequence(F.floor(F.col("r_cstart") / bucket), F.floor((F.col("r_cend") - 1) / bucket))))
    if dealt.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dealt = F.broadcast(dealt)
    out = calls
    for middle in (F.floor((length() - 1) / 2), F.floor(length() / 2)):
        at = F.floor((F.col("cstart") + middle) / bucket)
        covered = 2 * (F.least("cend", "r_cend") - F.greatest("cstart", "r_cstart")) >= length()
        out = out.join(dealt, (F.col("chrom") == F.col("r_chrom")) & (at == F.col("_b")) & covered & (F.col("cend") > F.col("cstart")), "left_anti")
    return out


def merge(df: DataFrame, by: Sequence[str], collect: str | None = None) -> DataFrame:
    """by, chrom, cstart, cend: the union of intervals per key and chromosome; those that overlap or touch become one.

    collect: an array column; the result has the sorted distinct elements.
    """
    keys = [*by, "chrom"]
    w = Window.partitionBy(*keys).orderBy("cstart", "cend")
    reach = F.max("cend").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = proper(df).withColumn("_new", F.when(F.col("cstart") <= reach, 0).otherwise(1))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(collect)))).alias(collect)] if collect else []
    return islands.groupBy(*keys, "_island").agg(F.min("cstart").alias("cstart"), F.max("cend").alias("cend"), *more).drop("_island")


def complement(df: DataFrame, genome: DataFrame) -> DataFrame:
    """chrom, cstart, cend: what the intervals leave of each chromosome of the genome (chrom, length)."""
    merged = merge(df, []).join(genome.select("chrom", "length"), "chrom").where("cstart < length")
    w = Window.partitionBy("chrom").orderBy("cstart")
    gaps = merged.select("chrom", F.coalesce(F.lag("cend").over(w), F.lit(0)).alias("_from"), F.col("cstart").alias("_to"))
    tails = genome.select("chrom", "length").join(merged.groupBy("chrom").agg(F.max("cend").alias("_from")), "chrom", "left")
    ends = tails.select("chrom", F.coalesce("_from", F.lit(0)).alias("_from"), F.col("length").alias("_to"))
    return gaps.unionByName(ends).where("_from < _to").select("chrom", F.col("_from").cast("long").alias("cstart"), F.col("_to").cast("long").alias("cend"))


def genome_sorted(df: DataFrame, genome: DataFrame) -> DataFrame:
    """Rows in the genome's chromosome order, then by start and end; a chromosome the genome lacks comes last."""
    ordered = df.join(F.broadcast(genome.select("chrom", "ord")), "chrom", "left")
    return ordered.orderBy(F.col("ord").asc_nulls_last(), "chrom", "cstart", "cend").drop("ord")
