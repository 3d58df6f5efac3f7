"""Interval operators on hand-made boundary cases and against plain comparison."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import analysis, classify, consensus, intervals, liftover, truth

BED = "chrom string, cstart long, cend long"


def bed(spark, rows):
    return spark.createDataFrame([("chr1", a, b) for a, b in rows], BED)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("region, kept", [([(50, 200)], False), ([(0, 30), (70, 100)], True), ([(0, 10**6)], False), ([(51, 200)], True), ([], True), ([(0, 50)], False)])
def test_exclusion(spark, region, kept):
    assert intervals.without_covered(bed(spark, [(0, 100)]), bed(spark, region), bucket=64).count() == kept


def test_exclusion_against_comparison(spark):
    r = random.Random(1)
    calls = sorted({(a, a + r.randrange(1, 400)) for a in (r.randrange(0, 3000) for _ in range(300))})
    regions = [(a, a + r.randrange(1, 500)) for a in (r.randrange(0, 3000) for _ in range(12))]
    want = [c for c in calls if not any(2 * (min(c[1], e) - max(c[0], s)) >= c[1] - c[0] for s, e in regions)]
    assert got(intervals.without_covered(bed(spark, calls), bed(spark, regions), bucket=128), "cstart", "cend") == want


def test_reciprocal_boundaries(spark):
    a = bed(spark, [(0, 100)])
    assert intervals.reciprocal_join(a, bed(spark, [(0, 201)])).count() == 0
    pair = intervals.reciprocal_join(a, bed(spark, [(50, 150), (5, 5), (None, 3)])).collect()
    assert [(p["a_cstart"], p["b_cstart"], p["b_cend"]) for p in pair] == [(0, 50, 150)]
    with pytest.raises(ValueError):
        intervals.reciprocal_join(a, a, fraction=0.3)


@pytest.mark.parametrize("fraction", [0.5, 0.75])
def test_reciprocal_against_comparison(spark, fraction):
    r = random.Random(2)
    make = lambda: [(s, s + int(2 ** r.uniform(0, 9))) for s in (r.randrange(0, 900) for _ in range(250))]
    x, y = make(), make()
    want = []
    for a in x:
        for b in y:
            ov = min(a[1], b[1]) - max(a[0], b[0])
            if ov >= fraction * (a[1] - a[0]) and ov >= fraction * (b[1] - b[0]) and a[1] > a[0] and b[1] > b[0]:
                want.append((*a, *b))
    assert got(intervals.reciprocal_join(bed(spark, x), bed(spark, y), fraction=fraction), "a_cstart", "a_cend", "b_cstart", "b_cend") == sorted(want)
    every = sorted((*a, *b) for a in x for b in y if min(a[1], b[1]) > max(a[0], b[0]))
    assert got(intervals.overlap_join(bed(spark, x), bed(spark, y), bucket=50), "a_cstart", "a_cend", "b_cstart", "b_cend") == every


@pytest.mark.parametrize("rows, want", [([(0, 10), (10, 20)], [(0, 20)]), ([(0, 10), (11, 20)], [(0, 10), (11, 20)]), ([(0, 100), (10, 20), (90, 120)], [(0, 120)]), ([(3, 3)], []), ([], [])])
def test_merge(spark, rows, want):
    once = intervals.merge(bed(spark, rows), [])
    assert got(once, "cstart", "cend") == want
    assert got(intervals.merge(once, []), "cstart", "cend") == want


def test_complement(spark):
    genome = spark.createDataFrame([("chr1", 100, 0), ("chr2", 50, 1)], "chrom string, length long, ord long")
    assert got(intervals.complement(bed(spark, [(0, 10), (20, 30), (95, 100)]), genome), "chrom", "cstart", "cend") == [("chr1", 10, 20), ("chr1", 30, 95), ("chr2", 0, 50)]


def test_sources_and_log(spark):
    rows = [("S", t, "chr1", 0, 100, "DEL") for t in ("cnvpytor", "delly", "gatk")] + [("S", "delly", "chr1", 500, 600, "DUP")]
    calls = spark.createDataFrame(rows, "sample string, tool string, chrom string, cstart long, cend long, svtype string")
    pairs = consensus.tool_pairs(calls)
    assert got(consensus.consensus(pairs, "union"), "cstart", "cend", "sources") == [(0, 100, "cnvpytor|delly|gatk")]
    log = {r["svtype"]: r.asDict() for r in consensus.log(calls, calls.where("svtype = 'DEL'"), pairs).collect()}
    assert log["DUP"]["after_delly"] == 0 and log["DEL"]["delly_gatk"] == 1
    change = {(r["svtype"], r["caller"]): r["pct_change"] for r in consensus.change_rows(consensus.log(calls, calls.where("svtype = 'DEL'"), pairs)).collect()}
    assert change["DUP", "delly"] == 100.0 and change["DUP", "gatk"] is None


def classified(spark):
    pred = spark.createDataFrame([("A", "S1", "DEL", "chr1", 1000, 2000, "a|b"), ("A", "S1", "DEL", "chr1", 9000, 9600, "b"), ("A", "S2", "DUP", "chr1", 0, 700, "a"), ("B", "S1", "DEL", "chr1", 1000, 2000, "a")], "input_set string, sample string, svtype string, chrom string, cstart long, cend long, sources string")
    held = spark.createDataFrame([("S1", "DEL", "chr1", 1100, 2100), ("S1", "DEL", "chr1", 1200, 1900), ("S1", "DUP", "chr1", 5, 900), ("S9", "DEL", "chr1", 5, 900)], "sample string, svtype string, chrom string, cstart long, cend long")
    return classify.classify(pred, held)


def test_classify(spark):
    rows = classified(spark)
    assert got(classify.counts(rows, ("input_set",)), "input_set", "tp", "fp", "fn") == [("A", 2, 2, 1), ("B", 2, 0, 1)]
    scored = {r["input_set"]: r for r in classify.scored(classify.counts(rows, ("input_set",))).collect()}
    assert scored["A"]["precision"] == 0.5 and scored["B"]["recall"] == pytest.approx(2 / 3)
    assert classify.summary(rows).where("input_set = 'A'").count() == 4
    assert {r["sample"] for r in classify.shared_samples(rows).collect()} == {"S1"}
    relaxed = classify.filter_by_size(rows, 1000, 2000)
    assert relaxed.where("classification = 'TP'").count() == 4
    assert classify.filter_by_size(rows, 1000, 2000, strict=True).where("classification = 'TP'").count() == 2


def test_distributions(spark):
    rows = analysis.in_bounds(classified(spark))
    d = analysis.distributions(rows, 20)
    ids = {k: rows.where(F.col("input_set") == "A").where(F.col("classification") == k).select(analysis.record_id()).distinct().count() for k in ("TP", "FP", "FN")}
    last = d.where("input_set = 'A' and svtype = 'ALL' and dist_type = 'cumulative' and bin = 18").first()
    first = d.where("input_set = 'A' and svtype = 'ALL' and dist_type = 'complementary_cumulative' and bin = 0").first()
    assert (last["tp"], last["fp"], last["fn"]) == (first["tp"], first["fp"], first["fn"]) == (ids["TP"], ids["FP"], ids["FN"])
    assert d.count() == 2 * 3 * 3 * 19


def test_smoothing(spark):
    df = spark.createDataFrame([("a", i, float(i == 5)) for i in range(11)] + [("b", 0, 3.0)], "g string, bin int, v double")
    out = {(r["g"], r["bin"]): r["smooth_v"] for r in analysis.smoothed(df, "v", ("g",), sigma=1.0).collect()}
    assert out["b", 0] == 3.0 and out["a", 5] == pytest.approx(0.39894, abs=1e-3) and sum(v for (g, _), v in out.items() if g == "a") == pytest.approx(1.0)


def test_liftover(spark):
    blocks = spark.createDataFrame([(1, 100, "chr1", 0, 1000, 500, "+", 10**6), (2, 900, "chr1", 100, 200, 0, "-", 1000), (3, 1, "chr1", 1000, 1100, 1510, "+", 10**6)], "chain_id long, score long, chrom string, block_start long, block_end long, new_start long, new_strand string, new_length long")
    points = spark.createDataFrame([("chr1", 10), ("chr1", 150), ("chr1", 5000), ("chr2", 10)], "chrom string, pos long")
    assert got(liftover.lift_points(points, blocks, bucket=64), "pos", "new_pos") == [(10, 510), (150, 949)]
    rows = spark.createDataFrame([("chr1", 900, 1000, "x"), ("chr1", 890, 1000, "y"), ("chr1", 20, 20, "z"), ("chr1", 10, 9999, "w")], f"{BED}, name string")
    assert got(liftover.liftover(rows, blocks), "name", "status") == [("w", "unmapped"), ("x", "ok"), ("y", "ok"), ("z", "resized")]


def test_common_samples(spark):
    rows = spark.createDataFrame([("a", "S1"), ("b", "S1"), ("a", "S2")], "bench string, sample string")
    assert [r["sample"] for r in truth.common_samples(rows).collect()] == ["S1"]
