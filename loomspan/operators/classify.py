"""True positives, false positives and false negatives, their counts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import f1, precision, recall
from .intervals import reciprocal_join
from .stage import staged

KEYS = ("sample", "svtype")
PLACE = ("chrom", "cstart", "cend")
SCHEMA = "classification string, input_set string, sample string, svtype string, pred_chrom string, pred_start long, pred_end long, sources string, truth_chrom string, truth_start long, truth_end long, pred_size long, truth_size long"


def classify(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per TP pair, FP call and FN interval (SCHEMA) for each input set of pred.

    pred: input_set, sample, svtype, chrom, cstart, cend, sources.  truth:
    sample, svtype, chrom, cstart, cend.  A sample or type that one side lacks
    counts as empty there.  Only truth of samples that an input set has is
    held against it.  FP and FN are what no pair names: the pairs are staged,
    so the interval join runs once.
    """
    sets = pred.select("input_set", "sample").distinct()
    held = truth.join(sets, "sample")
    pairs = staged(reciprocal_join(pred, held, ("input_set", *KEYS)))
    keys = ["input_set", *KEYS, *PLACE]
    side = lambda df, p: df.select(*(F.col(f"{p}{k}").alias(k) for k in keys)).distinct()
    fp = pred.join(side(pairs, "a_"), keys, "left_anti")
    fn = held.join(side(pairs, "b_"), keys, "left_anti")

    def row(name: str, df: DataFrame, p: str | None, t: str | None, base: str) -> DataFrame:
        none = lambda kind: F.lit(None).cast(kind)
        place = lambda pre, c, kind: none(kind) if pre is None else F.col(pre + c).cast(kind)
        size = lambda pre: none("long") if pre is None else (F.col(f"{pre}cend") - F.col(f"{pre}cstart")).cast("long")
        return df.select(
            F.lit(name).alias("classification"), *(F.col(base + k).alias(k) for k in ("input_set", *KEYS)),
            place(p, "chrom", "string").alias("pred_chrom"), place(p, "cstart", "long").alias("pred_start"), place(p, "cend", "long").alias("pred_end"), (none("string") if p is None else F.col(f"{p}sources")).alias("sources"),
            place(t, "chrom", "string").alias("truth_chrom"), place(t, "cstart", "long").alias("truth_start"), place(t, "cend", "long").alias("truth_end"), size(p).alias("pred_size"), size(t).alias("truth_size"),
        )

    return row("TP", pairs, "a_", "b_", "a_").unionByName(row("FP", fp, "", None, "")).unionByName(row("FN", fn, None, "", ""))


def filter_by_size(rows: DataFrame, lower: int, upper: int, strict: bool = False) -> DataFrame:
    """Rows within [lower, upper]: by called size, and for TP and FN by truth size, whose bounds are half and double unless strict."""
    low, high = (lower, upper) if strict else (lower * 0.5, upper / 0.5)
    pred, truth = F.col("pred_size").between(lower, upper), F.col("truth_size").between(low, high)
    kind = F.col("classification")
    return rows.where(F.when(kind == "TP", pred & truth).when(kind == "FP", pred).when(kind == "FN", truth).otherwise(True))


def counts(rows: DataFrame, by: Sequence[str] = ("input_set", *KEYS)) -> DataFrame:
    """by, tp, fp, fn as row counts."""
    kind = lambda k: F.count_if(F.col("classification") == k).alias(k.lower())
    return rows.groupBy(*by).agg(kind("TP"), kind("FP"), kind("FN"))


def scored(counted: DataFrame, metrics: Sequence[tuple[str, Column]] | None = None) -> DataFrame:
    """counted with a column for each metric: precision, recall and f1 unless others are given."""
    metrics = metrics or [("precision", precision()), ("recall", recall()), ("f1", f1())]
    return counted.withColumns(dict(metrics))


def summary(rows: DataFrame) -> DataFrame:
    """input_set, sample, svtype, tp, fp, fn, precision, recall, f1 for every sample with every type of its input set."""
    seen = rows.select("input_set", "sample").distinct().join(rows.select("input_set", "svtype").distinct(), "input_set")
    return scored(seen.join(counts(rows), ["input_set", *KEYS], "left").fillna(0, ["tp", "fp", "fn"]))


def size_classes(rows: DataFrame, classes: Sequence[tuple[str, int | None, int | None]] = (("all", None, None), ("10k-100k", 10_000, 100_000), ("100k-1M", 100_000, 1_000_000))) -> DataFrame:
    """summary() for each size class, in one pass over rows that fall in any."""
    parts = [summary(rows if lo is None else filter_by_size(rows, lo, hi)).withColumn("size_class", F.lit(name)) for name, lo, hi in classes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_samples(rows: DataFrame, mode: str = "all") -> DataFrame:
    """rows of samples that all input sets have ("all"), or that the last input set by name has ("last")."""
    if mode == "last":
        last = rows.agg(F.max("input_set")).first()[0]
        return rows.join(rows.where(F.col("input_set") == last).select("sample").distinct(), "sample", "left_semi")
    n = rows.select("input_set").distinct().count()
    common = rows.groupBy("sample").agg(F.count_distinct("input_set").alias("_n")).where(F.col("_n") == n)
    return rows.join(common, "sample", "left_semi")
