"""File formats on hand-made files."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from loomspan.functions import svtype
from loomspan.plans import pipeline
from loomspan.sources import tables, vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def line(chrom, pos, alt, info, fmt="GT", *calls, name="."):
    return "\t".join([chrom, str(pos), name, "N", alt, ".", ".", info, fmt, *calls]) + "\n"


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_array_calls(spark, tmp_path):
    text = "# note\n\nchr3:191067244-191070300  numsnp=4  length=3,057  state1,cn=0 /path/to/HG00144.sig.tsv startsnp=rs9821594 endsnp=kgp17677268\nchr1:5-9 a b state5,cn=3 /x/S2.txt\nchr1:5-9 a b state3,cn=2 /x/S2.txt\nchr1:5-9 a b state3 /x/S2.txt\nbad a b c,cn=1 /x/S2.txt\nchr1:5-9 short\nchr1:1-2 a b cn=1 /x/S3.bam.sig.cnv\n"
    assert rows(tables.read_array_calls(spark, write(tmp_path / "p.txt", text)), "chrom", "cstart", "cend", "svtype", "sample") == [("chr1", 1, 2, "DEL", "S3"), ("chr1", 5, 9, "DUP", "S2"), ("chr3", 191067244, 191070300, "DEL", "HG00144")]


def test_vcf_type_rules(spark, tmp_path):
    write(tmp_path / "a.vcf", HEAD + "HG1\n" + line("chr1", 101, "<DEL>", "SVTYPE=DEL;END=200", "GT", "0/1") + line("chr1", 301, "<INV>", "IMPRECISE;SVTYPE=INV", "GT", "0/1") + line("chr1", 401, ".", "SVTYPE=DUP", "GT", "0/1"))
    write(tmp_path / "b.vcf", HEAD + "HG2\n" + line("chr1", 11, "<DUP>", "END=x", "GT", "0/1"))
    with gzip.open(tmp_path / "c.vcf.gz", "wt") as f:
        f.write(HEAD + "HG3\n" + line("chr1", 11, "<CNV>", "END=50", "GT:RDCN", "0/1:2.0") + line("chr1", 61, "<CNV>", "END=70", "GT:RDCN", "0/1:2.5") + line("chrX", 5, "<CNV>", "END=9", "GT:RDCN", "1:1.2") + line("chrX", 15, "<CNV>", "END=19", "GT:RDCN", "1:0.9"))
    found = vcf.calls(vcf.read_text(spark, str(tmp_path)))
    want = [("HG1", "chr1", 100, 200, "DEL"), ("HG1", "chr1", 300, 301, "NA"), ("HG2", "chr1", 10, 11, "DUP"), ("HG3", "chr1", 10, 50, "DEL"), ("HG3", "chr1", 60, 70, "DUP"), ("HG3", "chrX", 4, 9, "DUP"), ("HG3", "chrX", 14, 19, "DEL")]
    assert rows(found, "sample", "chrom", "cstart", "cend", "svtype") == sorted(want)


def test_truth_vcf(spark, tmp_path):
    text = HEAD + "A\tB\n" + line("1", 101, "<DEL>", "SVTYPE=DEL:ME;SVLEN=-40", "GT", "0/1", "0/0", name="x") + line("chr1", 201, "<INS>", "SVTYPE=INS;END=300", "GT", "./.", "1|1") + line("chr1", 301, "<BND>", "SVTYPE=BND;END=300", "GT", "1/1", "1/1") + line("chr9", 1, "<DEL>", "SVTYPE=DEL;END=30", "GT", "1/1", "1/1")
    genome = spark.createDataFrame([("chr1",)], "chrom string")
    found = vcf.truth(vcf.read_text(spark, write(tmp_path / "t.vcf", text)), genome)
    assert rows(found, "sample", "chrom", "cstart", "cend", "id", "svtype", "genotype") == [("A", "chr1", 100, 141, "x", "DEL", "0/1"), ("A", "chr1", 200, 300, ".", "DUP", "-1/-1"), ("B", "chr1", 200, 300, ".", "DUP", "1/1")]


def bcf(path):
    head = '##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description="x">\n##contig=<ID=chr1>\n##contig=<ID=chr2>\n##INFO=<ID=SVTYPE,Number=1>\n##INFO=<ID=END,Number=1>\n##INFO=<ID=IMPRECISE,Number=0>\n##FORMAT=<ID=GT,Number=1>\n##FORMAT=<ID=RDCN,Number=1>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tHG9\0'.encode()
    text = lambda s: bytes([len(s) << 4 | 7]) + s.encode() if len(s) < 15 else bytes([0xF7, 0x11, len(s)]) + s.encode()
    small = lambda n: bytes([0x11, n])
    shared = struct.pack("<iiifII", 1, 100, 1, 0.0, 2 << 16 | 3, 2 << 24 | 1) + text("rec1") + text("N") + text("<DEL>") + b"\x00" + small(1) + text("DEL") + small(2) + b"\x12" + struct.pack("<h", 300) + small(3) + b"\x00"
    own = small(4) + b"\x21" + bytes([2, 4]) + small(5) + b"\x15" + struct.pack("<f", 1.5)
    path.write_bytes(gzip.compress(b"BCF\2\2" + struct.pack("<I", len(head)) + head + struct.pack("<II", len(shared), len(own)) + shared + own))
    return str(path)


def test_bcf(spark, tmp_path):
    found = vcf.read_bcf(spark, bcf(tmp_path / "x.bcf"))
    assert rows(found, "chrom", "pos", "id", "alt", "info", "format", "sample") == [("chr2", 101, "rec1", "<DEL>", "SVTYPE=DEL;END=300;IMPRECISE", "GT:RDCN", "HG9")]
    assert found.first()["calls"] == ["0/1:1.5"]
    assert rows(vcf.calls(found), "chrom", "cstart", "cend", "svtype") == [("chr2", 100, 300, "DEL")]


def test_chain(spark, tmp_path):
    text = "# note\nchain 4900 chr1 1000 + 100 160 chr1 2000 + 500 565 1\n20\t5\t10\n35\n\nchain 10 chr2 50 + 0 10 chr9 90 - 5 15 2\n10\n\n"
    found = tables.read_chain(spark, write(tmp_path / "c.chain", text))
    assert rows(found, "chain_id", "chrom", "block_start", "block_end", "new_chrom", "new_start", "new_strand", "new_length") == [(1, "chr1", 100, 120, "chr1", 500, "+", 2000), (1, "chr1", 125, 160, "chr1", 530, "+", 2000), (2, "chr2", 0, 10, "chr9", 5, "-", 90)]


def test_bed_and_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 1, 5, "DEL", "a|b", "S1"), ("chr2", 3, 9, "DUP", "a", "S2")], "chrom string, cstart long, cend long, svtype string, sources string, sample string")
    tables.write_bed(df, str(tmp_path / "bed"), "consensus", ("sample",))
    assert (tmp_path / "bed/sample=S1").exists()
    assert rows(tables.read_bed(spark, str(tmp_path / "bed/*/*.csv"), "consensus"), "chrom", "cstart", "cend", "svtype", "sources") == rows(df, "chrom", "cstart", "cend", "svtype", "sources")
    write(tmp_path / "in/S7.DUP.x.bed", "chr1\t1\t2\tDEL\n")
    assert rows(tables.read_bed(spark, str(tmp_path / "in"), "calls", named=True), "sample", "svtype") == [("S7", "DUP")]
    tables.write_log(df, str(tmp_path / "log"))
    assert tables.read_log(spark, str(tmp_path / "log"), "chrom string, cstart long").count() == 2
    write(tmp_path / "l.json", json.dumps({"set": [{"sample": "a"}]}, indent=1))
    assert tables.read_log(spark, str(tmp_path / "l.json")).select(F.explode("set.sample")).first()[0] == "a"


def test_names_and_rules(spark):
    assert vcf.pattern_glob("/d/{id}/x.*.vcf") == "/d/*/x.*.vcf"
    import re

    assert re.search(vcf.pattern_regex("/d/{id}/{id}.x.vcf"), "file:/d/S1/S1.x.vcf")[1] == "S1"
    assert not re.search(vcf.pattern_regex("/d/{id}/{id}.x.vcf"), "file:/d/S1/S2.x.vcf")
    df = spark.createDataFrame([("DEL:ME",), ("LINE1",), ("INS",), ("CNV",), (None,)], "t string")
    out = {r["t"]: (r["a"], r["b"]) for r in df.select("t", svtype.of_call(F.col("t")).alias("a"), svtype.of_truth(F.col("t"), F.lit("my_dup")).alias("b")).collect()}
    assert out == {"DEL:ME": ("NA", "DEL"), "LINE1": ("NA", "DUP"), "INS": ("DUP", "DUP"), "CNV": ("NA", "DUP"), None: ("NA", "NA")}
    with pytest.raises(Exception, match="unknown variant type"):
        df.select(svtype.of_truth(F.lit("XYZ"), F.lit(None).cast("string"), strict=True)).collect()
    limits = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("b", 1.0), ("b", 2.0)], "f string, x double").groupBy("f").agg(svtype.sex_threshold("x").alias("t"))
    assert rows(limits, "f", "t") == [("a", 2.0), ("b", 1.0)]


def test_arguments():
    assert pipeline.parse_args(["x.yml"]).config == pipeline.parse_args(["--config", "x.yml"]).config == "x.yml"
    assert [pipeline.parse_args(a).step for a in (["x.yml"], ["run", "x.yml"], ["analyse", "x.yml"], ["summary", "-c", "x.yml"])] == ["run", "run", "analyse", "summary"]
    with pytest.raises(SystemExit):
        pipeline.parse_args([])


def test_globs_of_any_depth(spark, tmp_path):
    for name in ("S1.vcf", "a/S2.vcf", "a/b c/S3.vcf", "a/b c/S3.txt"):
        write(tmp_path / name, HEAD + f"X{name[-5]}\n" + line("chr1", 1, "<DEL>", "SVTYPE=DEL;END=5", "GT", "0/1"))
    read = lambda p: rows(vcf.read_text(spark, f"{tmp_path}/{p}"), "sample")
    assert read("**/*.vcf") == [("X1",), ("X2",), ("X3",)]
    assert read("a/**/S*.vcf") == [("X2",), ("X3",)]
    assert read("*.vcf") == [("X1",)]
    assert rows(vcf.samples(spark, f"{tmp_path}/**/*.vcf"), "sample") == [("X1",), ("X2",), ("X3",)]
    assert rows(vcf.samples(spark, bcf(tmp_path / "x.bcf")), "sample") == [("HG9",)]


def test_whole_run(spark, tmp_path):
    for tool, shift in (("cnvpytor", 0), ("delly", 20), ("gatk", 40)):
        for s in ("S1", "S2"):
            write(tmp_path / f"in/{tool}/{s}.vcf", HEAD + f"{s}\n" + line("chr1", 10001 + shift, "<DEL>", f"SVTYPE=DEL;END={12000 + shift}", "GT", "0/1") + line("chr1", 50001 + shift, "<DUP>", f"SVTYPE=DUP;END={53000 + shift}", "GT", "0/1") + line("chrU", 1, "<DEL>", "SVTYPE=DEL;END=5000", "GT", "0/1"))
    write(tmp_path / "truth.vcf", HEAD + "S1\tS2\n" + line("chr1", 10001, "<DEL>", "SVTYPE=DEL;END=12000", "GT", "0/1", "1/1") + line("chr1", 90001, "<DEL>", "SVTYPE=DEL;END=92000", "GT", "0/1", "0/0"))
    write(tmp_path / "more.vcf", HEAD + "S2\tS1\tS5\n" + line("chr1", 10001, "<DEL>", "SVTYPE=DEL;END=12000", "GT", "0/0", "0/1", "0/1"))  # no carrier S2, no S5 elsewhere
    write(tmp_path / "genome.txt", "chr1\t1000000\n")
    write(tmp_path / "excluded.bed", "chr1\t50000\t53000\n")
    write(tmp_path / "control.txt", "chr1:10000-12000 a b cn=1 /x/S1.txt\n")
    write(tmp_path / "x.chain", "chain 1 chr1 1000000 + 0 1000000 chr1 1000000 + 0 1000000 1\n1000000\n\n")
    config = {"output_dir": str(tmp_path / "out"), "analysis": ["summary", "distributions", "source_mix", "size_histogram", "excluded_changes", "excluded_box_abs_change", "liftover_totals"], "input": {"my set": {t: f"{tmp_path}/in/{t}/{{id}}.vcf" for t in ("cnvpytor", "delly", "gatk")}}, "benchmark_map": {"a b": str(tmp_path / "truth.vcf"), "c": str(tmp_path / "more.vcf")}, "genome_file": str(tmp_path / "genome.txt"), "excluded_regions_file": str(tmp_path / "excluded.bed"), "control": {"Array": str(tmp_path / "control.txt")}, "liftover": {"Array": {"from": "hg19", "to": "hg38", "chain": str(tmp_path / "x.chain")}}}
    out = pipeline.Pipeline(spark, config).run()
    assert set(out) == set(config["analysis"])
    again = pipeline.Pipeline(spark, config)
    text = lambda df: sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    before = {k: text(df) for k, df in out.items()}
    after = again.analysis(again.load())
    assert {k: text(df) for k, df in after.items()} == before
    assert rows(out["liftover_totals"], "input_set", "before", "after", "all_failed") == [("Array", 1, 1, False)]
    assert {r["source"] for r in out["size_histogram"].collect()} >= {"benchmark", "Array"}
    whole = out["summary"].where("size_class = 'all'")
    assert rows(whole.where("input_set = 'my_set_intersections'"), "sample", "svtype", "tp", "fp", "fn") == [("S1", "DEL", 1, 0, 1), ("S2", "DEL", 1, 0, 0)]
    assert rows(whole.where("input_set = 'Array'"), "sample", "svtype", "tp", "fp", "fn") == [("S1", "DEL", 1, 0, 1)]
    log = tables.read_log(spark, str(tmp_path / "out/logs/consensus"), "sample string, svtype string, before_delly long, after_delly long")
    assert rows(log.where("sample = 'S1'"), "svtype", "before_delly", "after_delly") == [("DEL", 2, 1), ("DUP", 1, 0)]
    with pytest.raises(ValueError, match="lacks gatk"):
        pipeline.Pipeline(spark, config | {"input": {"x": {"delly": "a", "cnvpytor": "b"}}}).calls()
