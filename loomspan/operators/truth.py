"""The truth set: samples common to all benchmarks, counts and merged intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import merge


def common_samples(headers: DataFrame) -> DataFrame:
    """sample: those that every benchmark's header names, whether it has records of them or not; headers has bench and sample."""
    n = headers.select("bench").distinct().count()
    return headers.groupBy("sample").agg(F.count_distinct("bench").alias("_n")).where(F.col("_n") == n).select("sample")


def truth_counts(truth: DataFrame) -> DataFrame:
    """bench, sample, n_all, n_del, n_dup."""
    is_type = lambda t: F.count_if(F.col("svtype") == t)
    return truth.groupBy("bench", "sample").agg(F.count("*").alias("n_all"), is_type("DEL").alias("n_del"), is_type("DUP").alias("n_dup"))


def truth_merged(truth: DataFrame) -> DataFrame:
    """sample, svtype, chrom, cstart, cend over all benchmarks."""
    return merge(truth.where(F.col("svtype").isin("DEL", "DUP")), ("sample", "svtype"))


def merge_log(truth: DataFrame, merged: DataFrame) -> DataFrame:
    """sample, svtype, source (a benchmark or "merged"), n."""
    parts = truth.groupBy("sample", "svtype", F.col("bench").alias("source")).agg(F.count("*").alias("n"))
    return parts.unionByName(merged.groupBy("sample", "svtype").agg(F.count("*").alias("n")).withColumn("source", F.lit("merged")))
