"""One query per operator, over the interval fixtures; see oracle.py for the same in plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import metrics, svtype
from ..operators import analysis, classify, consensus, intervals, liftover, truth
from ..operators.stage import shared_path, staged
from ..sources import tables, vcf
from .fixtures import fixture, table

POINTS = 41
SETS = ("intersections", "unions", "gatk")


class Run:
    """The tables of one run, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self.made:
            self.made[name] = getattr(self, f"_{name}")() if f"_{name}" in type(self).__dict__ else fixture(self.spark, self.dir, name)
        return self.made[name]

    # what several tables are made of is computed once

    def _driven(self):
        return staged(consensus.driven_by(self.calls.where("svtype <> 'NA'"), "delly"))

    def _kept(self):
        return staged(consensus.prepared(self.driven, self.genome, self.regions))

    def _pairs(self):
        return staged(consensus.tool_pairs(self.kept))

    def _intersection(self):
        return consensus.consensus(self.pairs, "intersection")

    def _union(self):
        return consensus.consensus(self.pairs, "union")

    def _merged(self):
        common = truth.common_samples(self.headers)
        return staged(truth.truth_merged(self.truth.join(common, "sample", "left_semi")))

    def _log(self):
        return consensus.log(self.driven, self.kept, self.pairs)

    def _pred(self):
        gatk = self.kept.where("tool = 'gatk'").select("sample", "svtype", "chrom", "cstart", "cend", F.col("tool").alias("sources"))
        parts = [df.withColumn("input_set", F.lit(n)) for n, df in zip(SETS, (self.intersection, self.union, gatk), strict=True)]
        return staged(parts[0].unionByName(parts[1]).unionByName(parts[2]))

    def _classified(self):
        return staged(classify.classify(self.pred, self.merged))

    def _scored(self):
        return classify.scored(classify.counts(self.classified))

    def _in_bounds(self):
        return analysis.in_bounds(self.classified)

    def _dist(self):
        return staged(analysis.distributions(self.in_bounds, POINTS))

    def _sizes(self):
        return analysis.size_samples(self.in_bounds, SETS[0])

    def _lifted(self):
        return liftover.liftover(self.calls.where("svtype <> 'NA'"), self.blocks)


def _r(*names: str, digits: int = 6) -> list:
    return [F.round(F.col(n), digits).alias(n) for n in names]


PLACE = ("chrom", "cstart", "cend")
KEYS = ("sample", "svtype")
QUERIES: dict[str, Callable[[Run], DataFrame]] = {}


def query(f: Callable[[Run], DataFrame]) -> Callable[[Run], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# scalar rules


@query
def genome_whitelist(t):
    return consensus.whitelisted(t.calls, t.genome)


@query
def svtype_sanitize_calls(t):
    return t.records.select("record_no", "info_svtype", svtype.of_call(F.col("info_svtype")).alias("svtype")).distinct()


@query
def svtype_sanitize_truth(t):
    return t.records.select("record_no", svtype.of_truth(F.col("info_svtype"), F.col("record_id")).alias("svtype")).distinct()


@query
def sex_threshold(t):
    return t.records.where(F.col("chrom").isin(*svtype.SEX_CHROMOSOMES) & F.col("rdcn").isNotNull()).groupBy("file_id").agg(svtype.sex_threshold("rdcn").alias("threshold"))


@query
def rdcn_svtype(t):
    return t.records.select("record_no", svtype.of_copy_number(F.col("rdcn"), F.col("chrom"), F.lit(1.0)).alias("svtype")).distinct()


@query
def svtype_method_dispatch(t):
    rows = t.records.select(
        F.col("file_id").cast("string").alias("path"), F.lit("x").alias("sample"), F.col("record_no").alias("place"), "chrom", "pos", F.col("record_id").alias("id"), "alt",
        F.concat(F.lit("Q=1;SVTYPE="), "info_svtype").alias("info"), F.when(F.col("rdcn").isNotNull(), "GT:RDCN").otherwise("GT").alias("format"),
        F.array(F.concat_ws(":", F.lit("0/1"), F.col("rdcn").cast("string"))).alias("calls"),
    )
    return vcf.typed(rows).groupBy(F.col("path").cast("long").alias("file_id"), "method", "svtype").agg(F.count("*").alias("n"))


# files: what the fixtures say is written as a file of the format and read by its reader


def _text(t, rows: DataFrame, line: str, what: str, head: str | None = None) -> str:
    """A folder file_id=<id> for each file of rows, with the lines that the SQL expression makes, in order of record_no."""
    path = shared_path(t.spark, what)
    body = F.expr(f"array_join(transform(array_sort(collect_list(struct(record_no, {line} as line))), x -> x.line), '\\n')")
    rows.groupBy("file_id").agg(body.alias("value")).select("file_id", F.concat(F.expr(head), "value").alias("value") if head else "value").write.partitionBy("file_id").text(path)
    return path


VCF_LINE = """concat_ws('\\t', chrom, pos, coalesce(record_id, '.'), 'N', alt, '.', 'PASS',
  coalesce(nullif(concat_ws(';', 'SVTYPE=' || info_svtype, 'END=' || info_end, 'SVLEN=' || info_svlen), ''), '.'), if(rdcn is null, 'GT', 'GT:RDCN'),
  concat_ws(':', concat_ws('/', if(allele_a < 0, '.', string(allele_a)), if(allele_b < 0, '.', string(allele_b))), cast(rdcn as string)))"""
VCF_HEAD = "concat('##fileformat=VCFv4.2\\n#CHROM\\tPOS\\tID\\tREF\\tALT\\tQUAL\\tFILTER\\tINFO\\tFORMAT\\tF', file_id, '\\n')"


def _vcf(t) -> str:
    return _text(t, t.records, VCF_LINE, "vcf", VCF_HEAD)


@query
def vcf_calls_scan(t):
    path = _vcf(t)
    found = vcf.calls(vcf.read(t.spark, [f"{path}/file_id=*/*.txt"], f"{path}/file_id={{id}}/*.txt"))
    return found.groupBy("sample", "chrom", "svtype").agg(F.count("*").alias("n"), F.sum("cstart").alias("starts"), F.sum("cend").alias("ends"))


@query
def vcf_truth_scan(t):
    path = _vcf(t)
    found = vcf.truth(vcf.read(t.spark, [f"{path}/**/*.txt"], "{header}"), t.genome)
    return found.groupBy("sample", "chrom", "svtype", "genotype", "id").agg(F.count("*").alias("n"), F.sum("cstart").alias("starts"), F.sum("cend").alias("ends"))


@query
def vcf_header_samples(t):
    return vcf.samples(t.spark, f"{_vcf(t)}/**/*.txt")


@query
def array_calls_scan(t):
    line = "concat_ws('  ', chrom || ':' || pos || '-' || (pos + 70), 'numsnp=4', 'state5,cn=' || cast(floor(rdcn) as string), '/data/S' || file_id || '.sig.tsv', 'startsnp=a')"
    found = tables.read_array_calls(t.spark, f"{_text(t, t.records, line, 'array')}/*/*.txt")
    return found.groupBy("sample", "chrom", "svtype").agg(F.count("*").alias("n"), F.sum("cstart").alias("starts"), F.sum("cend").alias("ends"))


@query
def chain_scan(t):
    path = shared_path(t.spark, "chain")
    lines = "concat(if(chain_id % 100 = 2, '# a note\\n', ''), concat_ws(' ', 'chain', score, chrom, 300000000, '+', block_start, block_end, 'q' || chrom, new_length, new_strand, new_start, new_start + 100010, chain_id), '\\n40000\\t10\\t20\\n', block_end - block_start - 40010, if(chain_id % 3 = 0, '\\n', '\\r\\n'))"
    t.blocks.selectExpr(f"{lines} as value").write.text(path)
    return tables.read_chain(t.spark, path)


@query
def bed_roundtrip(t):
    path = shared_path(t.spark, "bed")
    tables.write_bed(t.driven, path, "calls", ("tool", "sample"))
    found = tables.read_bed(t.spark, f"{path}/tool=*/sample=*", "calls")
    folder = F.regexp_extract("_metadata.file_path", "tool=([^/]+)/sample=([^/]+)/", 1), F.regexp_extract("_metadata.file_path", "tool=([^/]+)/sample=([^/]+)/", 2)
    return found.select(folder[0].alias("tool"), folder[1].alias("sample"), *PLACE, "svtype")


@query
def classified_roundtrip(t):
    path = shared_path(t.spark, "classified")
    for kind in ("TP", "FP", "FN"):
        tables.write_bed(t.classified.where(F.col("classification") == kind), f"{path}/{kind}", kind, ("input_set", *KEYS))
    return tables.read_classified(t.spark, path).select("classification", "input_set", *KEYS, "pred_chrom", "pred_start", "pred_end", "sources", "truth_chrom", "truth_start", "truth_end", "pred_size", "truth_size")


@query
def log_roundtrip(t):
    path = shared_path(t.spark, "log")
    tables.write_log(t.log, path)
    return tables.read_log(t.spark, path, ", ".join(f"{n} {k}" for n, k in t.log.dtypes))


@query
def genome_scan(t):
    path = shared_path(t.spark, "genome")
    t.genome.selectExpr("ord", "concat_ws('\\t', substring(chrom, 4), length) as value").coalesce(1).sortWithinPartitions("ord").select("value").write.text(path)
    return tables.read_genome(t.spark, path).select("chrom", "length", F.row_number().over(Window.orderBy("ord")).alias("place"))  # a row a chromosome


@query
def penncnv_cn_svtype(t):
    cn = F.floor(F.col("rdcn")).cast("int")
    return t.records.select(cn.alias("cn"), svtype.of_array_copies(cn).alias("svtype")).where("svtype is not null").groupBy("cn", "svtype").agg(F.count("*").alias("n"))


@query
def genotype_carrier(t):
    both = F.array(*(F.nullif(F.col(c), F.lit(-1)) for c in ("allele_a", "allele_b")))
    return t.records.select(svtype.genotype(both).alias("genotype"), svtype.is_carrier(both).alias("carrier"), svtype.is_carrier(both, False).alias("carrier_strict")).groupBy("genotype", "carrier", "carrier_strict").agg(F.count("*").alias("n"))


@query
def end_fallback(t):
    e, p = F.col("info_end"), F.col("pos")
    return t.records.select("record_no", svtype.call_end(e, p).alias("call_end"), svtype.truth_end(e, F.col("info_svlen"), p).alias("truth_end")).distinct()


@query
def chr_prefix(t):
    return t.records.select("chrom", svtype.with_chr(F.col("chrom")).alias("prefixed")).distinct()


@query
def display_names(t):
    names = {"delly": "Delly 2", "gatk": "GATK"}
    return t.calls.select("tool", svtype.display_name(F.col("tool"), names).alias("display"), svtype.source_key(F.concat(F.lit("My "), F.col("tool"))).alias("source")).distinct()


@query
def consensus_sources(t):
    pairs = t.pairs.select(F.concat_ws(",", "a_tool", "b_tool").alias("p"), "a_sample", "a_svtype").groupBy("a_sample", "a_svtype").agg(F.collect_set("p").alias("p"))
    return pairs.select(F.col("a_sample").alias("sample"), F.col("a_svtype").alias("svtype"), svtype.sources_text(F.col("p")).alias("sources"))


# consensus


@query
def excluded_antijoin(t):
    return intervals.without_covered(t.calls.where("svtype <> 'NA'"), t.regions)


@query
def reciprocal_pairs_clipped(t):
    return consensus.clipped(t.pairs).withColumn("sources", F.array_join("sources", ","))


@query
def reciprocal_pairs_full(t):
    return t.pairs.select("a_sample", "a_svtype", "a_chrom", "a_tool", "a_cstart", "a_cend", "b_tool", "b_cstart", "b_cend")


@query
def consensus_intersection(t):
    return t.intersection


@query
def consensus_union(t):
    return t.union


@query
def consensus_combined_sorted(t):
    return intervals.genome_sorted(t.intersection, t.genome)


@query
def consensus_log(t):
    return t.log


@query
def excluded_change_rows(t):
    return consensus.change_rows(t.log).select(*KEYS, "caller", "before", "after", "abs_change", *_r("pct_change"))


@query
def excluded_change_means(t):
    return consensus.change_means(consensus.change_rows(t.log)).select("caller", *_r("abs_change", "pct_change"))


@query
def excluded_change_box(t):
    cols = ["n", "q1", "median", "q3", "whisker_low", "whisker_high", "lowest", "highest"]
    return analysis.box_stats(consensus.change_rows(t.log), "pct_change", ["caller"]).select("caller", "n", *_r(*cols[1:]))


@query
def interval_complement(t):
    return intervals.complement(t.regions, t.genome)


@query
def bucketed_overlap_join(t):
    named = t.kept.where("tool = 'delly'")
    pairs = intervals.overlap_join(named, t.kept.where("tool = 'gatk'"), KEYS)
    return pairs.select("a_sample", "a_svtype", "a_chrom", "a_cstart", "a_cend", "b_cstart", "b_cend")


@query
def genome_sort(t):
    return intervals.genome_sorted(t.regions, t.genome)


# truth


@query
def common_samples(t):
    return truth.common_samples(t.headers)


@query
def control_samples_of_interest(t):
    return t.calls.where("tool = 'gatk'").join(t.intersection.select("sample").distinct(), "sample", "left_semi").groupBy("sample").agg(F.count("*").alias("n"))


@query
def truth_counts(t):
    return truth.truth_counts(t.truth)


@query
def truth_merged(t):
    return t.merged


@query
def truth_merge_log(t):
    return truth.merge_log(t.truth, t.merged)


# liftover


@query
def liftover_points(t):
    ends = t.calls.where("svtype <> 'NA'").select("chrom", F.explode(F.array("cstart", "cend")).alias("pos"))
    return liftover.lift_points(ends, t.blocks)


@query
def liftover_size_filter(t):
    return t.lifted.where("status = 'ok'").select("sample", "tool", "svtype", *PLACE, "new_start", "new_end")


@query
def liftover_log(t):
    pcts = ["pct_succeeded", "pct_failed_liftover", "pct_failed_size_change"]
    return liftover.liftover_log(t.lifted).select(*KEYS, "before", "after", "failed_liftover", "failed_size_change", *_r(*pcts))


# classification


@query
def tp(t):
    return t.classified.where("classification = 'TP'").drop("classification")


@query
def fp(t):
    return t.classified.where("classification = 'FP'").select("input_set", *KEYS, "pred_chrom", "pred_start", "pred_end", "sources", "pred_size")


@query
def fn(t):
    return t.classified.where("classification = 'FN'").select("input_set", *KEYS, "truth_chrom", "truth_start", "truth_end", "truth_size")


@query
def classification_counts(t):
    return classify.counts(t.classified)


@query
def precision_recall_f1(t):
    return t.scored.select("input_set", *KEYS, "tp", "fp", "fn", *_r("precision", "recall", "f1"))


def _sizes(rows: DataFrame) -> DataFrame:
    return classify.counts(rows, ("input_set", "svtype"))


@query
def size_filter_strict(t):
    return _sizes(classify.filter_by_size(t.classified, 10_000, 100_000, strict=True))


@query
def size_filter_relaxed(t):
    return _sizes(classify.filter_by_size(t.classified, 10_000, 100_000))


@query
def summary_by_size_class(t):
    return classify.size_classes(t.classified.where("input_set <> 'gatk'")).select("size_class", "input_set", *KEYS, "tp", "fp", "fn", *_r("precision", "recall", "f1"))


# analysis


@query
def size_bins(t):
    parts = [metrics.size_bins(t.spark, 500, 1e6, 100, k).withColumn("kind", F.lit(k)) for k in ("histogram", "cumulative", "complementary_cumulative")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "bin", *_r("lower", "upper", digits=4))


def _dist(t, name: str) -> DataFrame:
    return t.dist.where(F.col("dist_type") == name).select("input_set", "svtype", "bin", *_r("x", digits=4), "tp", "fp", "fn")


@query
def dist_histogram(t):
    return _dist(t, "histogram")


@query
def dist_cumulative(t):
    return _dist(t, "cumulative")


@query
def dist_comp_cumulative(t):
    return _dist(t, "complementary_cumulative")


@query
def dist_metrics(t):
    return classify.scored(t.dist).select("input_set", "svtype", "dist_type", "bin", *_r("precision", "recall", "f1"))


@query
def gaussian_smooth(t):
    scored = classify.scored(t.dist.where("dist_type = 'histogram'"))
    return analysis.smoothed(scored, "recall", ("input_set", "svtype")).select("input_set", "svtype", "bin", *_r("smooth_recall"))


@query
def venn3_regions(t):
    return analysis.venn3(t.in_bounds, SETS).select("region", "n", "detected", "truth")


@query
def venn3_percentages(t):
    return analysis.venn3(t.in_bounds, SETS).select("region", *_r("pct_detected", "pct_truth"))


@query
def venn3_methods(t):
    return analysis.venn3_methods(t.in_bounds, SETS, "DEL").select("input_set", "n", *_r("pct_detected", "pct_truth"))


@query
def venn3_shares(t):
    return analysis.venn3(t.in_bounds, SETS).select("region", *_r("pct_1", "pct_2", "pct_3"))


@query
def benchmark_sizes(t):
    sizes = analysis.size_samples(t.in_bounds, SETS[0]).where("source = 'benchmark'")
    return sizes.groupBy("source", "svtype", "size").agg(F.count("*").alias("n"))


@query
def excluded_abs_change_box(t):
    cols = ["q1", "median", "q3", "lowest", "highest"]
    return analysis.box_stats(consensus.change_rows(t.log), "abs_change", ["caller"]).select("caller", "n", *_r(*cols))


@query
def liftover_box(t):
    cols = ["q1", "median", "q3", "lowest", "highest"]
    return analysis.box_stats(liftover.liftover_log(t.lifted), "pct_succeeded", ["svtype"]).select("svtype", "n", *_r(*cols))


@query
def size_histogram_log(t):
    return analysis.size_histogram(t.sizes).select("source", "bin", *_r("lower", "upper", digits=3), "n", *_r("density"))


@query
def size_kde(t):
    return analysis.size_kde(t.sizes).select("source", "point", *_r("size", digits=3), *_r("density"))


def _mix(t, metric: str) -> DataFrame:
    return analysis.source_mix(t.in_bounds.where("input_set <> 'gatk'")).where(F.col("metric") == metric).select("input_set", *KEYS, "caller_or_combination", *_r("percentage"))


@query
def caller_raw_pct(t):
    return _mix(t, "raw_count")


@query
def caller_combo_pct(t):
    return _mix(t, "combination_count")


@query
def entity_sort(t):
    return analysis.entity_order(t.union.select(F.col("sources").alias("caller_or_combination")).distinct())


@query
def shared_samples(t):
    return classify.counts(classify.shared_samples(t.classified), ("input_set",))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: f(Run(spark, sf_dir)) for name, f in QUERIES.items()}


__all__ = ["QUERIES", "Run", "queries", "table"]
