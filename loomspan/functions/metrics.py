"""Metrics as columns over tp, fp and fn; size bins; smoothing weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(bottom > 0, top.cast("double") / bottom).otherwise(F.lit(0.0))


def precision(tp: str = "tp", fp: str = "fp") -> Column:
    return _ratio(F.col(tp), F.col(tp) + F.col(fp))


def recall(tp: str = "tp", fn: str = "fn") -> Column:
    return _ratio(F.col(tp), F.col(tp) + F.col(fn))


def f1(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> Column:
    return _ratio(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))


def size_bins(spark: SparkSession, start: float, end: float, points: int, kind: str = "histogram") -> DataFrame:
    """bin, lower, upper: log-spaced size intervals.

    histogram: neighbouring points; cumulative: from start to each point;
    complementary_cumulative: from each point to the end.
    """
    a, b = math.log10(start), math.log10(end)
    at = lambda i: F.pow(F.lit(10.0), F.lit(a) + i * F.lit((b - a) / (points - 1)))
    i = F.col("id").cast("double")
    lower, upper = {"histogram": (at(i), at(i + 1)), "cumulative": (F.lit(float(start)), at(i + 1)), "complementary_cumulative": (at(i), F.lit(float(end)))}[kind]
    return spark.range(points - 1).select(F.col("id").cast("int").alias("bin"), lower.alias("lower"), upper.alias("upper"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a normalised Gaussian kernel cut off at truncate sigmas."""
    radius = int(truncate * sigma + 0.5)
    raw = {k: math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)}
    total = sum(raw.values())
    return [(k, w / total) for k, w in raw.items()]
