"""The whole run from a YAML file: calls, consensus, control, liftover, truth, classification and analysis tables.

    python -m loomspan CONFIG                (or --config CONFIG)
    python -m loomspan analyse CONFIG        the analysis tables again, from what a run has written
    python -m loomspan summary CONFIG        its counts and scores by size class, printed too

Keys: output_dir; input: {set: {tool: path pattern}}, at least cnvpytor, delly
and gatk; benchmark_map: {name: path}; and as wanted genome_file,
excluded_regions_file, control: {name: path of array-caller text}, liftover:
{set: {chain: path}}, venn_sets: three input sets, analysis: names of the
tables wanted (all by default).  {id} in a pattern stands for the sample.  Any file
system that Spark reads will do.  Results are BED folders by sample and type,
Parquet tables for the analysis and JSON logs.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis, classify, consensus, liftover, truth
from ..operators.stage import staged
from ..sources import tables, vcf

REQUIRED_TOOLS = {"cnvpytor", "delly", "gatk"}
POINTS = 100
STEPS = ("run", "analyse", "summary")


def load_config(path: str) -> dict:
    import yaml

    with open(path) as f:
        return yaml.safe_load(f)


def parse_args(argv: Sequence[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("words", nargs="*", metavar="[run|analyse|summary] CONFIG")
    p.add_argument("--config", "-c")
    args = p.parse_args(argv)
    args.step = args.words.pop(0) if args.words and args.words[0] in STEPS else "run"
    args.config_file = args.words.pop(0) if args.words else None
    if args.words:
        p.error(f"not understood: {' '.join(args.words)}")
    args.config = args.config or args.config_file
    if not args.config:
        p.error("a configuration file is needed")
    return args


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def key(name: str) -> str:
    return name.replace(" ", "_")


class Pipeline:
    def __init__(self, spark: SparkSession, config: dict):
        self.spark, self.config = spark, config
        self.out = config["output_dir"].rstrip("/")
        self.logs: dict[str, DataFrame] = {}
        genome, regions = config.get("genome_file"), config.get("excluded_regions_file")
        self.genome = tables.read_genome(spark, genome) if genome else None
        self.regions = tables.read_bed(spark, regions) if regions else None

    def _files(self, pattern: str, sample: str | None = None) -> DataFrame:
        glob = vcf.pattern_glob(pattern)
        return vcf.read(self.spark, [glob], sample or pattern)

    def calls(self) -> DataFrame:
        """input_set, tool, sample, chrom, cstart, cend, svtype of all tools of all input sets."""
        parts = []
        for name, tools in self.config["input"].items():
            if missing := REQUIRED_TOOLS - set(tools):
                raise ValueError(f"input set {name!r} lacks {', '.join(sorted(missing))}")
            for tool, pattern in tools.items():
                rows = vcf.calls(self._files(pattern)).drop("path")
                parts.append(rows.withColumns({"input_set": F.lit(key(name)), "tool": F.lit(tool)}))
        return _union(parts).where("svtype in ('DEL', 'DUP')")

    def consensus(self, calls: DataFrame) -> DataFrame:
        """input_set (<set>_intersections, <set>_unions), sample, svtype, chrom, cstart, cend, sources."""
        keys = ("input_set", *consensus.KEYS)
        driven = staged(consensus.driven_by(calls, "delly", keys))
        kept = staged(consensus.prepared(driven, self.genome, self.regions))
        pairs = staged(consensus.tool_pairs(kept, keys))
        self.logs["consensus"] = consensus.log(driven, kept, pairs, keys)
        return _union([consensus.consensus(pairs, m, keys).withColumn("input_set", F.concat("input_set", F.lit(f"_{m}s"))) for m in ("intersection", "union")])

    def control(self, samples: DataFrame) -> DataFrame | None:
        """Control calls of the samples that the consensus has, as further input sets."""
        given = self.config.get("control") or {}
        parts = [tables.read_array_calls(self.spark, path).withColumns({"input_set": F.lit(key(name)), "sources": F.lit(key(name).lower())}) for name, path in given.items()]
        return _union(parts).join(samples, "sample", "left_semi") if parts else None

    def lifted(self, pred: DataFrame) -> DataFrame:
        """pred with the input sets that are to be lifted in new coordinates."""
        parts, logs, rest = [], [], pred
        for name, spec in (self.config.get("liftover") or {}).items():
            if spec.get("from") is not None and spec.get("from") == spec.get("to"):
                continue
            mine = F.col("input_set").isin(key(name), f"{key(name)}_intersections", f"{key(name)}_unions")
            blocks = tables.read_chain(self.spark, spec["chain"])
            judged = staged(liftover.liftover(pred.where(mine), blocks))
            ok = judged.where("status = 'ok'")
            parts.append(ok.select(*(F.col({"cstart": "new_start", "cend": "new_end"}.get(c, c)).alias(c) for c in pred.columns)))
            logs.append(liftover.liftover_log(judged, ("input_set", *consensus.KEYS)))
            rest = rest.where(~mine)
        if logs:
            self.logs["liftover"] = _union(logs)
        return _union([rest, *parts])

    def truth(self) -> DataFrame:
        """Merged intervals of the samples that all benchmarks name; a benchmark that is missing ends the run."""
        parts, heads = [], []
        for name, path in self.config["benchmark_map"].items():
            heads.append(vcf.samples(self.spark, path).withColumn("bench", F.lit(name)))
            rows = vcf.truth(self._files(path, "{header}"), self.genome)
            parts.append(rows.withColumn("bench", F.lit(name)))
        every = _union(parts)
        common = staged(every.join(truth.common_samples(_union(heads)), "sample", "left_semi"))
        merged = truth.truth_merged(common)
        self.logs["benchmark"] = truth.merge_log(common, merged)
        return merged

    def run(self) -> dict[str, DataFrame]:
        """Everything, written below output_dir; the analysis tables are also returned."""
        calls = staged(self.calls())
        tables.write_bed(calls, f"{self.out}/bed", "calls", ("input_set", "tool", "sample", "svtype"))
        found = staged(self.consensus(calls))
        control = self.control(found.select("sample").distinct())
        pred = found if control is None else found.unionByName(control)
        pred = staged(self.lifted(pred.select("input_set", *consensus.KEYS, "chrom", "cstart", "cend", "sources")))
        tables.write_bed(pred, f"{self.out}/predictions", "consensus", ("input_set", "sample", "svtype"))
        merged = staged(self.truth())
        tables.write_bed(merged, f"{self.out}/truth", "regions", ("sample", "svtype"))
        rows = staged(classify.classify(pred, merged))
        for kind in ("TP", "FP", "FN"):
            tables.write_bed(rows.where(F.col("classification") == kind), f"{self.out}/binary_classification/{kind}", kind, ("input_set", "sample", "svtype"))
        for name, log in self.logs.items():
            tables.write_log(log, f"{self.out}/logs/{name}")
        return self.written(self.analysis(rows))

    def written(self, results: dict[str, DataFrame]) -> dict[str, DataFrame]:
        for name, df in results.items():
            df.write.mode("overwrite").parquet(f"{self.out}/analysis/{name}")
        return results

    def load(self) -> DataFrame:
        """The classified rows of a run that is finished, and its logs."""
        for name in tables.subfolders(self.spark, f"{self.out}/logs"):
            self.logs[name] = tables.read_log(self.spark, f"{self.out}/logs/{name}", lines=True)
        return staged(tables.read_classified(self.spark, f"{self.out}/binary_classification"))

    def analyse(self) -> dict[str, DataFrame]:
        """The analysis tables of a run that is finished, written again."""
        return self.written(self.analysis(self.load()))

    def summary(self) -> dict[str, DataFrame]:
        """Counts and scores by size class of a run that is finished, written again."""
        return self.written({"summary": classify.size_classes(self.load())})

    def benchmark_set(self) -> str:
        """The input set whose true records stand for the benchmark: the first of venn_sets, else that of the first input."""
        return (self.config.get("venn_sets") or [f"{key(next(iter(self.config['input'])))}_intersections"])[0]

    def analysis(self, rows: DataFrame) -> dict[str, DataFrame]:
        within = staged(analysis.in_bounds(classify.shared_samples(rows, self.config.get("shared_samples", "all"))))
        dist = classify.scored(analysis.distributions(within, POINTS))
        out = {"summary": classify.size_classes(rows), "distributions": dist}
        for metric in ("precision", "recall", "f1"):
            out[f"smooth_{metric}"] = analysis.smoothed(dist, metric, ("input_set", "svtype", "dist_type"))
        sizes = analysis.size_samples(within, self.benchmark_set())
        out |= {"size_histogram": analysis.size_histogram(sizes), "size_kde": analysis.size_kde(sizes)}
        out["source_mix"] = analysis.source_mix(within.where(F.col("input_set").endswith("_intersections")))
        out["source_box"] = analysis.box_stats(out["source_mix"], "percentage", ("input_set", "svtype", "metric", "caller_or_combination"))
        changes = consensus.change_rows(self.logs["consensus"], ("input_set", *consensus.KEYS)) if "consensus" in self.logs else None
        if changes is not None:
            out["excluded_changes"] = consensus.change_means(changes, ("input_set", "caller"))
            for change in ("pct_change", "abs_change"):
                out[f"excluded_box_{change}"] = analysis.box_stats(changes, change, ("input_set", "caller", "svtype"))
        if "liftover" in self.logs:
            lifted = self.logs["liftover"]
            counts = ("before", "after", "failed_liftover", "failed_size_change")
            out["liftover_totals"] = lifted.groupBy("input_set").agg(*(F.sum(c).alias(c) for c in counts), (F.sum("after") == 0).alias("all_failed"))
            for share in ("pct_succeeded", "pct_failed_liftover", "pct_failed_size_change"):
                out[f"liftover_box_{share}"] = analysis.box_stats(lifted, share, ("input_set", "svtype"))
        sets = self.config.get("venn_sets")
        if sets:
            for kind in analysis.TYPES:
                out[f"venn_{kind}"] = analysis.venn3(within, sets, kind)
        wanted = self.config.get("analysis")
        return out if wanted is None else {k: v for k, v in out.items() if k in wanted}


def main(argv: Sequence[str] | None = None) -> None:
    spark = SparkSession.builder.appName("loomspan").getOrCreate()
    args = parse_args(argv)
    found = getattr(Pipeline(spark, load_config(args.config)), args.step)()
    if "summary" in found:
        found["summary"].groupBy("size_class", "input_set", "svtype").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))).orderBy("size_class", "input_set", "svtype").show(200, truncate=False)


if __name__ == "__main__":
    main()
