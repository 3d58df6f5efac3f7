"""Tables behind the figures: size distributions, three-set regions, densities, source mixes, box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import gaussian_weights, size_bins
from .classify import filter_by_size

TYPES = ("ALL", "DEL", "DUP")
BOUNDS = (500, 1_000_000)


def typed(rows: DataFrame) -> DataFrame:
    """rows once under their own type and once under ALL, in the column kind."""
    return rows.withColumn("kind", F.explode(F.array(F.lit("ALL"), F.col("svtype")))).where(F.col("kind").isin(*TYPES))


def record_id() -> Column:
    """What counts as one record: called coordinates for FP, truth coordinates for TP and FN, and the type; not the sample."""
    called = F.col("classification") == "FP"
    return F.struct(*(F.when(called, F.col(f"pred_{c}")).otherwise(F.col(f"truth_{c}")).alias(c) for c in ("chrom", "start", "end")), "svtype")


def _in_bins(rows: DataFrame, points: int, bounds: tuple[int, int]) -> DataFrame:
    """input_set, kind, classification, id, bin: distinct records of each size bin; bins overlap as sizes are inclusive and truth bounds are relaxed.

    A record is looked up in the few bins its size can be in: bins are log
    spaced, so the candidates come from the logarithm, and the exact bounds
    decide.  The bin table has points - 1 rows and is sent to all tasks.
    """
    import math

    bins = size_bins(rows.sparkSession, *bounds, points)
    edges = F.broadcast(bins.select("bin", F.floor("lower").cast("long").alias("lo"), F.floor("upper").cast("long").alias("hi")))
    kind = F.col("classification")
    size = F.when(kind == "FN", F.col("truth_size")).otherwise(F.col("pred_size")).cast("double")
    per = (math.log10(bounds[1]) - math.log10(bounds[0])) / (points - 1)
    slack = F.when(kind == "FN", math.ceil(math.log10(2) / per) + 1).otherwise(1)
    edge_slack = F.ceil(F.log10(1 + 2 / F.greatest(size, F.lit(1.0))) / per).cast("int")
    place = F.floor((F.log10(F.greatest(size, F.lit(0.5))) - math.log10(bounds[0])) / per).cast("int")
    reach = slack + edge_slack
    first, last = F.greatest(place - reach, F.lit(0)), F.least(place + reach, F.lit(points - 2))
    near = rows.where(size.isNotNull()).withColumn("bin", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    met = near.join(edges, "bin")
    pred = F.col("pred_size").between(F.col("lo"), F.col("hi"))
    truth = (2 * F.col("truth_size") >= F.col("lo")) & (F.col("truth_size") <= 2 * F.col("hi"))
    ok = F.when(kind == "TP", pred & truth).when(kind == "FP", pred).otherwise(truth)
    return typed(met.where(ok)).select("input_set", "kind", "classification", record_id().alias("id"), "bin").distinct()


def distributions(rows: DataFrame, points: int = 100, bounds: tuple[int, int] = BOUNDS) -> DataFrame:
    """input_set, svtype (ALL, DEL, DUP), dist_type, bin, x, tp, fp, fn: distinct records per size bin, at or below it, and at or above it.

    A record joins the running count at its first bin and the reverse one at
    its last, so both are sums over per-bin counts.
    """
    spark = rows.sparkSession
    keys = ["input_set", "kind"]
    found = _in_bins(rows, points, bounds)
    ends = found.groupBy(*keys, "classification", "id").agg(F.min("bin").alias("first"), F.max("bin").alias("last"))

    def per_bin(df: DataFrame, bin_column: str, dist: str) -> DataFrame:
        count = lambda k: F.count_if(F.col("classification") == k).alias(k.lower())
        return df.groupBy(*keys, F.col(bin_column).alias("bin")).agg(count("TP"), count("FP"), count("FN")).withColumn("dist_type", F.lit(dist))

    counted = per_bin(found, "bin", "histogram").unionByName(per_bin(ends, "first", "cumulative")).unionByName(per_bin(ends, "last", "complementary_cumulative"))
    kinds = spark.sql("select explode(array('histogram', 'cumulative', 'complementary_cumulative')) as dist_type").join(F.broadcast(size_bins(spark, *bounds, points)))
    groups = rows.select("input_set").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, TYPES))))
    grid = groups.join(F.broadcast(kinds))  # input sets x 3 x 3 x bins
    full = grid.join(counted, [*keys, "dist_type", "bin"], "left").fillna(0, ["tp", "fp", "fn"])
    up = Window.partitionBy(*keys, "dist_type").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys, "dist_type").orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    dist = F.col("dist_type")
    run = lambda c: F.when(dist == "histogram", F.col(c)).when(dist == "cumulative", F.sum(c).over(up)).otherwise(F.sum(c).over(down)).cast("long").alias(c)
    x = F.when(dist == "histogram", F.sqrt(F.col("lower") * F.col("upper"))).when(dist == "cumulative", F.col("upper")).otherwise(F.col("lower"))
    return full.select("input_set", F.col("kind").alias("svtype"), "dist_type", "bin", x.alias("x"), run("tp"), run("fp"), run("fn"))


def smoothed(df: DataFrame, value: str, by: Sequence[str], order: str = "bin", sigma: float = 5.0) -> DataFrame:
    """df with smooth_<value>: a Gaussian filter over rows 0..n-1 of each group by `order`, mirrored at the ends, edge value twice.

    Groups are curves of a few hundred points at most; each is gathered in an
    array.  A sigma of 0 and a group of one row leave values as they are.
    """
    out = f"smooth_{value}"
    if sigma <= 0:
        return df.withColumn(out, F.col(value).cast("double"))
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    taken = df.withColumn("_v", F.collect_list(F.col(value).cast("double")).over(w)).withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)
    n = F.size("_v")
    kernel = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("w")) for k, v in gaussian_weights(sigma)))

    def term(p: Column) -> Column:
        t = F.pmod(F.col("_i") + p["k"], 2 * n)
        return p["w"] * F.get(F.col("_v"), F.when(t < n, t).otherwise(2 * n - 1 - t).cast("int"))

    total = F.aggregate(F.transform(kernel, term), F.lit(0.0), lambda a, b: a + b)
    return taken.withColumn(out, F.when(n > 1, total).otherwise(F.col(value).cast("double"))).drop("_v", "_i")


def venn3(rows: DataFrame, sets: Sequence[str], svtype: str = "ALL") -> DataFrame:
    """region (100 ... 111), n, detected, truth, pct_detected, pct_truth, pct_1, pct_2, pct_3: distinct true records found by exactly those of three input sets.

    pct_k: the region's share of all that set k found, null if the set isn't in the region.
    Total truth is what any set found plus what the first set missed.
    """
    if len(sets) != 3:
        raise ValueError("three input sets are needed")
    own = rows if svtype == "ALL" else rows.where(F.col("svtype") == svtype)
    name = ["truth_chrom", "truth_start", "truth_end", "svtype"]
    tp = own.where((F.col("classification") == "TP") & F.col("input_set").isin(*sets))
    bits = F.bit_or(F.when(F.col("input_set") == sets[0], 4).when(F.col("input_set") == sets[1], 2).otherwise(1)).alias("mask")
    fn = own.where((F.col("classification") == "FN") & (F.col("input_set") == sets[0]))
    by_id = tp.groupBy(*name).agg(bits).unionByName(fn.select(*name).distinct().withColumn("mask", F.lit(0)))
    best = by_id.groupBy(*name).agg(F.max("mask").alias("mask")).groupBy("mask").agg(F.count("*").alias("n"))
    totals = best.agg(F.coalesce(F.sum(F.when(F.col("mask") > 0, F.col("n"))), F.lit(0)).alias("detected"), F.coalesce(F.sum("n"), F.lit(0)).alias("truth"))
    regions = rows.sparkSession.range(1, 8).select(F.col("id").cast("int").alias("mask"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) * 100.0 / F.col(whole)).otherwise(0.0)
    out = regions.join(best, "mask", "left").fillna(0, ["n"]).join(F.broadcast(totals))  # 7 rows and one
    found = best.agg(*(F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(b) > 0, F.col("n"))), F.lit(0)).alias(f"found_{k}") for k, b in ((1, 4), (2, 2), (3, 1))))
    out = out.join(F.broadcast(found))  # 7 rows and one
    of = [F.when(F.col("mask").bitwiseAND(b) > 0, share("n", f"found_{k}")).alias(f"pct_{k}") for k, b in ((1, 4), (2, 2), (3, 1))]
    return out.select(F.lpad(F.bin("mask"), 3, "0").alias("region"), "n", "detected", "truth", share("n", "detected").alias("pct_detected"), share("n", "truth").alias("pct_truth"), *of)


def venn3_methods(rows: DataFrame, sets: Sequence[str], svtype: str = "ALL") -> DataFrame:
    """input_set, n, pct_detected, pct_truth of each of three sets."""
    regions = venn3(rows, sets, svtype)
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("input_set"), (F.substring("region", i + 1, 1) == "1").alias("on")) for i, s in enumerate(sets))))
    n = F.sum(F.when(F.col("_e.on"), F.col("n")).otherwise(0))
    share = lambda whole: F.when(F.max(whole) > 0, n * 100.0 / F.max(whole)).otherwise(0.0)
    return regions.withColumn("_e", each).groupBy(F.col("_e.input_set").alias("input_set")).agg(n.alias("n"), share("detected").alias("pct_detected"), share("truth").alias("pct_truth"))


def size_samples(rows: DataFrame, benchmark_of: str | None = None) -> DataFrame:
    """source, svtype, size: called sizes (TP and FP) of each input set and, under "benchmark", truth sizes (TP and FN) of one."""
    kind = F.col("classification")
    pred = rows.where(kind.isin("TP", "FP")).select(F.col("input_set").alias("source"), "svtype", F.col("pred_size").alias("size"))
    if benchmark_of is None:
        return pred.where("size > 0")
    truth = rows.where(kind.isin("TP", "FN") & (F.col("input_set") == benchmark_of)).select(F.lit("benchmark").alias("source"), "svtype", F.col("truth_size").alias("size"))
    return pred.unionByName(truth).where("size > 0")


def size_histogram(sizes: DataFrame, bins: int = 40, by: Sequence[str] = ("source",)) -> DataFrame:
    """by, bin, lower, upper, n, density: equal bins of log10(size) over the range of all sizes, density normalised per group."""
    logs = sizes.where("size > 0").withColumn("_x", F.log10(F.col("size").cast("double")))
    span = logs.agg(F.min("_x").alias("_a"), F.max("_x").alias("_b"))
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("_x") - F.col("_a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    binned = logs.join(F.broadcast(span)).withColumns({"_w": width, "bin": at})  # one row
    counted = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.min("_a").alias("_a"), F.min("_w").alias("_w"))
    total = F.sum("n").over(Window.partitionBy(*by))
    edge = lambda k: F.pow(F.lit(10.0), F.col("_a") + (F.col("bin") + k) * F.col("_w"))
    return counted.select(*by, "bin", edge(0).alias("lower"), edge(1).alias("upper"), "n", F.when(F.col("_w") > 0, F.col("n") / (total * F.col("_w"))).alias("density"))


def size_kde(sizes: DataFrame, grid: int = 200, cut: float = 3.0, by: Sequence[str] = ("source",)) -> DataFrame:
    """by, point, size, density: Gaussian kernel density of log10(size), Scott's bandwidth, on a grid that reaches `cut` bandwidths past the data.

    Sizes are whole numbers, so equal ones are counted first; a group's work
    is its distinct sizes times the grid.
    """
    keys = list(by)
    counted = sizes.where("size > 0").groupBy(*keys, "size").agg(F.count("*").alias("c")).withColumn("x", F.log10(F.col("size").cast("double")))
    sums = counted.groupBy(*keys).agg(F.sum("c").alias("n"), (F.sum(F.col("c") * F.col("x")) / F.sum("c")).alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    spread = counted.join(F.broadcast(sums), keys).groupBy(*keys).agg(F.sum(F.col("c") * F.pow(F.col("x") - F.col("mean"), 2)).alias("ss"))
    shape = sums.join(spread, keys).where("n > 1 and ss > 0").withColumn("h", F.sqrt(F.col("ss") / (F.col("n") - 1)) * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    points = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("g", F.col("lo") - cut * F.col("h") + F.col("point") * (F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (grid - 1))
    met = counted.join(F.broadcast(points), keys)
    kernel = F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("g") - F.col("x")) / F.col("h"), 2)))
    out = met.groupBy(*keys, "point", "g", "n", "h").agg(kernel.alias("_k"))
    return out.select(*keys, "point", F.pow(F.lit(10.0), F.col("g")).alias("size"), (F.col("_k") / (F.col("n") * F.col("h") * 2.5066282746310002)).alias("density"))


def source_mix(rows: DataFrame, by: Sequence[str] = ("input_set", "sample", "svtype")) -> DataFrame:
    """by, metric, caller_or_combination, percentage: share of TP pair rows that name a caller (raw_count), and that have a combination (combination_count)."""
    tp = rows.where((F.col("classification") == "TP") & F.col("sources").isNotNull())
    total = tp.groupBy(*by).agg(F.count("*").alias("_n"))
    raw = tp.withColumn("caller_or_combination", F.explode(F.split("sources", r"\|"))).withColumn("metric", F.lit("raw_count"))
    combo = tp.withColumn("caller_or_combination", F.array_join(F.array_sort(F.split("sources", r"\|")), "|")).withColumn("metric", F.lit("combination_count"))
    cols = [*by, "metric", "caller_or_combination"]
    counted = raw.select(*cols).unionByName(combo.select(*cols)).groupBy(*cols).agg(F.count("*").alias("_c"))
    return counted.join(total, list(by)).select(*cols, (F.col("_c") * 100.0 / F.col("_n")).alias("percentage"))


def entity_order(df: DataFrame, entity: str = "caller_or_combination") -> DataFrame:
    """Most callers first, then by name."""
    return df.orderBy(F.size(F.split(entity, r"\|")).desc(), entity)


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """by, n, q1, median, q3, whisker_low, whisker_high, lowest, highest: exact quartiles, whiskers at the last value within 1.5 of their distance."""
    own = df.where(F.col(value).isNotNull())
    q = own.groupBy(*by).agg(F.count("*").alias("n"), F.expr(f"percentile({value}, array(0.25, 0.5, 0.75))").alias("_q"), F.min(value).cast("double").alias("lowest"), F.max(value).cast("double").alias("highest"))
    q = q.select(*by, "n", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "lowest", "highest")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    within = own.join(q, list(by)).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return q.join(within.groupBy(*by).agg(F.min(value).cast("double").alias("whisker_low"), F.max(value).cast("double").alias("whisker_high")), list(by))


def in_bounds(rows: DataFrame, bounds: tuple[int, int] = BOUNDS) -> DataFrame:
    """What the analysis starts from: rows strictly within the size bounds."""
    return filter_by_size(rows, *bounds, strict=True)
