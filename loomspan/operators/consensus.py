"""Consensus of several callers: exclusion, pairwise reciprocal overlaps, merged intersections and unions, and their log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import merge, reciprocal_join, without_covered

KEYS = ("sample", "svtype")
TOOLS = ("cnvpytor", "delly", "gatk")


def whitelisted(calls: DataFrame, genome: DataFrame) -> DataFrame:
    """Calls on chromosomes of the genome table (a few dozen rows)."""
    return calls.join(F.broadcast(genome.select("chrom")), "chrom", "left_semi")


def driven_by(calls: DataFrame, tool: str | None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Only the samples and types that `tool` has calls for; all of them if it is None."""
    if tool is None:
        return calls
    return calls.join(calls.where(F.col("tool") == tool).select(*keys).distinct(), list(keys), "left_semi")


def prepared(calls: DataFrame, genome: DataFrame | None, regions: DataFrame | None) -> DataFrame:
    """Typed calls on known chromosomes that no excluded region covers by half."""
    out = calls.where(F.col("svtype").isin("DEL", "DUP"))
    out = out if genome is None else whitelisted(out, genome)
    return out if regions is None else without_covered(out, regions)


def tool_pairs(calls: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pairs of calls of two tools (a_tool < b_tool) that overlap by half of either.

    The last tool by name is never on the left and the first never on the
    right, so their calls aren't dealt out there.  calls is read for the two
    names first and should be staged.
    """
    first, last = calls.agg(F.min("tool"), F.max("tool")).first()
    return reciprocal_join(calls.where(F.col("tool") < last), calls.where(F.col("tool") > first), keys, extra=F.col("a_tool") < F.col("b_tool"))


def _tools():
    return F.array("a_tool", "b_tool").alias("sources")


def clipped(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The shared stretch of each pair."""
    return pairs.select(*(F.col(f"a_{k}").alias(k) for k in (*keys, "chrom")), F.greatest("a_cstart", "b_cstart").alias("cstart"), F.least("a_cend", "b_cend").alias("cend"), _tools())


def both_sides(pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Both calls of each pair, whole."""
    sides = F.explode(F.array(*(F.struct(F.col(f"{s}cstart").alias("cstart"), F.col(f"{s}cend").alias("cend")) for s in ("a_", "b_"))))
    return pairs.select(*(F.col(f"a_{k}").alias(k) for k in (*keys, "chrom")), sides.alias("_s"), _tools()).select(*keys, "chrom", "_s.cstart", "_s.cend", "sources")


def consensus(pairs: DataFrame, method: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, chrom, cstart, cend, sources (a|b|c): merged intersections or unions of the pairs; both use one join."""
    rows = {"intersection": clipped, "union": both_sides}[method](pairs, keys)
    return merge(rows, keys, "sources").withColumn("sources", F.array_join("sources", "|"))


def log(calls: DataFrame, kept: DataFrame, pairs: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, before_<tool>, after_<tool>, <tool>_<tool>: counts of a run."""

    def counted(df: DataFrame, prefix: str) -> DataFrame:
        return df.groupBy(*keys).agg(*(F.count_if(F.col("tool") == t).alias(f"{prefix}_{t}") for t in TOOLS))

    named = pairs.select(*(F.col(f"a_{k}").alias(k) for k in keys), "a_tool", "b_tool")
    met = named.groupBy(*keys).agg(*(F.count_if((F.col("a_tool") == a) & (F.col("b_tool") == b)).alias(f"{a}_{b}") for i, a in enumerate(TOOLS) for b in TOOLS[i + 1 :]))
    out = counted(calls, "before").join(counted(kept, "after"), list(keys), "left").join(met, list(keys), "left")
    return out.fillna(0)


def change_rows(logged: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, caller, before, after, abs_change, pct_change (null if before is 0): what exclusion took, one row per caller."""
    stacked = F.explode(F.array(*(F.struct(F.lit(t).alias("caller"), F.col(f"before_{t}").alias("before"), F.col(f"after_{t}").alias("after")) for t in TOOLS)))
    rows = logged.select(*keys, stacked.alias("_r")).select(*keys, "_r.*").where("before is not null and after is not null")
    change = F.col("before") - F.col("after")
    return rows.withColumns({"abs_change": change, "pct_change": F.when(F.col("before") > 0, change * 100.0 / F.col("before"))})


def change_means(rows: DataFrame, by: Sequence[str] = ("caller",)) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg("abs_change").alias("abs_change"), F.avg("pct_change").alias("pct_change"))
