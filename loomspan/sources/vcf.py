"""Variant files (.vcf, .vcf.gz, .bcf) as rows, and the calls and truth intervals they hold."""

from __future__ import annotations

import functools
import gzip
import io
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import svtype as rules

FIELDS = "chrom string, pos long, id string, alt string, info string, format string, calls array<string>"


def pattern_glob(pattern: str) -> str:
    return pattern.replace("{id}", "*")


def pattern_regex(pattern: str) -> str:
    """A Java and Python pattern whose first group is the id; a repeated {id} must repeat it."""
    out, seen = "", False
    for part in re.split(r"(\{id\}|\*+)", pattern):
        if part == "{id}":
            out += r"\1" if seen else "([^/]+)"
            seen = True
        elif part.startswith("*"):
            out += "[^/]*" if part == "*" else ".*"
        else:
            out += re.escape(part).replace("/", "/")
    return out + "$"


def files(spark: SparkSession, kind: str, path: str | list[str]) -> DataFrame:
    """The files at the paths or globs, read as text or binaryFile; ** stands for folders of any depth, none included.

    Spark's globs go one level deep, so a path with ** is read from the folder
    before its first glob, and files are told by their whole path.
    """
    paths = [path] if isinstance(path, str) else list(path)
    flat = [p for p in paths if "**" not in p]
    parts = [spark.read.format(kind).load(flat).withColumn("path", F.col("_metadata.file_path"))] if flat else []
    for p in (p for p in paths if "**" in p):
        top, last = re.split(r"[^/]*[*?\[{]", p, maxsplit=1)[0], p.rpartition("/")[2]
        found = spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", last if last != "**" else "*").load(top)
        pattern = re.escape(p).replace(r"\*\*/", "(?:.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
        parts.append(found.withColumn("path", F.col("_metadata.file_path")).where(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))).rlike(pattern + "$")))
    content = "value" if kind == "text" else "content"
    parts = [x.select(content, "path", F.col("_metadata.file_block_start").alias("block")) for x in parts]
    return parts[0] if len(parts) == 1 else functools.reduce(DataFrame.unionByName, parts)


def samples(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """sample: those that the headers of the files name, whether or not they have records."""
    paths = [path] if isinstance(path, str) else list(path)
    text, binary = [p for p in paths if not p.endswith(".bcf")], [p for p in paths if p.endswith(".bcf")]
    parts = []
    if text:
        parts.append(files(spark, "text", text).where(F.col("value").startswith("#CHROM")).select(F.explode(F.slice(F.split("value", "\t"), 10, 1 << 20)).alias("sample")))
    if binary:
        named = F.pandas_udf(lambda s: s.map(lambda data: _bcf_header(data)[2]), "array<string>")
        parts.append(files(spark, "binaryFile", binary).select(F.explode(named("content")).alias("sample")))
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.vcf)?(\.[^.]*)$", "")


def read_text(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, sample_names, sample, place (order in the file), and FIELDS, one row per record.

    sample is what {id} stands for in the pattern if it has one, else the
    first sample named in the file, else the file's name.
    """
    lines = files(spark, "text", path).select("value", "path", F.struct("block", F.monotonically_increasing_id().alias("row")).alias("place"))
    names = lines.where(F.col("value").startswith("#CHROM")).select("path", F.slice(F.split("value", "\t"), 10, 1 << 20).alias("sample_names"))
    w = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#") & (F.size(w) >= 8)).select("path", "place", w[0].alias("chrom"), w[1].try_cast("long").alias("pos"), w[2].alias("id"), w[4].alias("alt"), w[7].alias("info"), F.get(w, 8).alias("format"), F.slice(w, 10, 1 << 20).alias("calls"))
    return _named(rows.join(names, "path", "left"), pattern)


def _named(rows: DataFrame, pattern: str | None) -> DataFrame:
    first = F.coalesce(F.get("sample_names", 0), _stem(F.col("path")))
    if pattern and "{id}" in pattern:
        first = F.coalesce(F.nullif(F.regexp_extract("path", pattern_regex(pattern), 1), F.lit("")), _stem(F.col("path")))
    return rows.withColumn("sample", first)


def info(name: str) -> Column:
    return F.nullif(F.regexp_extract("info", rf"(?:^|;){name}=([^;]+)", 1), F.lit(""))


def call_field(call: Column, name: str) -> Column:
    at = F.array_position(F.split("format", ":"), name)
    return F.when(at > 0, F.get(F.split(call, ":"), (at - 1).cast("int")))


def has_alt() -> Column:
    return F.coalesce((F.col("alt") != ".") & (F.col("alt") != ""), F.lit(False))


def calls(vcf: DataFrame) -> DataFrame:
    """path, sample, chrom, cstart, cend, svtype of each record with an alternative allele, see typed()."""
    return typed(vcf).drop("method")


def typed(vcf: DataFrame) -> DataFrame:
    """path, sample, chrom, cstart, cend, svtype, method of each record with an alternative allele.

    Which rule gives the type is settled per file by its first telling record:
    INFO's SVTYPE if it is known there, else the symbolic allele, else the copy
    number if records have one, else INFO's.
    """
    by_info, by_alt = rules.of_call(info("SVTYPE")), rules.of_alt(F.get(F.split("alt", ","), 0))
    rdcn = call_field(F.get("calls", 0), "RDCN").try_cast("double")
    rows = vcf.withColumns({"_info": by_info, "_alt": by_alt, "_rdcn": rdcn})
    way = F.when(F.col("_info") != "NA", "info").when(F.col("_alt") != "NA", "alt").when(F.array_contains(F.split("format", ":"), "RDCN"), "rdcn").otherwise("info")
    telling = rows.where((F.col("_info") != "NA") | has_alt())
    ways = telling.groupBy("path").agg(F.min_by(way, "place").alias("_way"))
    limits = rows.where(F.col("chrom").isin(*rules.SEX_CHROMOSOMES) & F.col("_rdcn").isNotNull()).groupBy("path").agg(rules.sex_threshold("_rdcn").alias("_limit"))
    known = rows.where(has_alt()).join(ways, "path").join(limits, "path", "left")
    by_number = rules.of_copy_number(F.col("_rdcn"), F.col("chrom"), F.coalesce("_limit", F.lit(rules.DIPLOID)))
    kind = F.when(F.col("_way") == "alt", F.col("_alt")).when(F.col("_way") == "rdcn", by_number).otherwise(F.col("_info"))
    return known.select("path", "sample", "chrom", (F.col("pos") - 1).alias("cstart"), rules.call_end(info("END"), F.col("pos")).alias("cend"), kind.alias("svtype"), F.col("_way").alias("method"))


def alleles(call: Column) -> Column:
    """Numbers of a genotype's alleles, null for a missing one."""
    return F.transform(F.split(call_field(call, "GT"), r"[/|]"), lambda a: a.try_cast("int"))


def truth(vcf: DataFrame, genome: DataFrame | None = None, strict: bool = False, keep_missing: bool = True) -> DataFrame:
    """sample, chrom, cstart, cend, id, svtype, genotype: one row for each carrier of each typed record."""
    rows = vcf.where(has_alt()).withColumn("chrom", rules.with_chr(F.col("chrom")))
    if genome is not None:
        rows = rows.join(F.broadcast(genome.select("chrom")), "chrom", "left_semi")
    kind = rules.of_truth(info("SVTYPE"), F.col("id"), strict)
    end = rules.truth_end(info("END"), F.get(F.split(info("SVLEN"), ","), 0), F.col("pos"))
    typed = rows.withColumns({"svtype": kind, "cend": end}).where("svtype <> 'NA' and cend is not null")
    each = typed.withColumn("_c", F.explode(F.arrays_zip("sample_names", "calls"))).withColumn("_gt", alleles(F.col("_c.calls")))
    carriers = each.where(rules.is_carrier(F.col("_gt"), keep_missing))
    return carriers.select(F.col("_c.sample_names").alias("sample"), "chrom", (F.col("pos") - 1).alias("cstart"), "cend", F.coalesce("id", F.lit(".")).alias("id"), "svtype", rules.genotype(F.col("_gt")).alias("genotype"))


# BCF: the binary form, read file by file into the same rows

_INTS = {1: ("<b", 1, -128), 2: ("<h", 2, -32768), 3: ("<i", 4, -2147483648)}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out if len(out) > 1 else out[0]

    def kind(self) -> tuple[int, int]:
        b = self.take("<B")
        n, t = b >> 4, b & 15
        return t, (self.values(*self.kind())[0] if n == 15 else n)

    def values(self, t: int, n: int):
        """A string, a list of numbers (None: missing), or [] for nothing."""
        if t == 7:
            out = self.data[self.at : self.at + n].rstrip(b"\0").decode()
            self.at += n
            return out
        if t == 5:
            raw = [self.take("<I") for _ in range(n)]
            return [None if x == 0x7F800001 else struct.unpack("<f", struct.pack("<I", x))[0] for x in raw if x != 0x7F800002]
        if t in _INTS:
            form, _, missing = _INTS[t]
            raw = [self.take(form) for _ in range(n)]
            return [None if x == missing else x for x in raw if x != missing + 1]
        return []

    def typed(self):
        return self.values(*self.kind())


def _dictionaries(header: str) -> tuple[dict[int, str], dict[int, str], list[str]]:
    words: dict[int, str] = {0: "PASS"}
    contigs: dict[int, str] = {}
    seen = {"PASS"}
    names: list[str] = []
    for line in header.split("\n"):
        if m := re.match(r"##(contig|FILTER|INFO|FORMAT)=<.*?ID=([^,>]+)", line):
            i = re.search(r"[,<]IDX=(\d+)", line)
            if m[1] == "contig":
                contigs[int(i[1]) if i else len(contigs)] = m[2]
            elif m[2] not in seen or i:
                words[int(i[1]) if i else len(words)] = m[2]
                seen.add(m[2])
        elif line.startswith("#CHROM"):
            names = line.rstrip("\0").split("\t")[9:]
    return words, contigs, names


def _text(v) -> str:
    return v if isinstance(v, str) else ",".join("." if x is None else f"{x:g}" if isinstance(x, float) else str(x) for x in v)


def _genotype(raw) -> str:
    out = ""
    for k, g in enumerate(raw):
        g = g or 0
        out += ("" if k == 0 else "|" if g & 1 else "/") + ("." if g >> 1 == 0 else str((g >> 1) - 1))
    return out or "."


def _bcf_header(data: bytes) -> tuple[dict[int, str], dict[int, str], list[str]]:
    """As _dictionaries(), from the bytes of a BCF file; only its beginning is unpacked."""
    f = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    if f.read(5)[:4] != b"BCF\2":
        raise ValueError("not a BCF file")
    return _dictionaries(f.read(struct.unpack("<I", f.read(4))[0]).decode())


def decode_bcf(data: bytes) -> Iterator[tuple]:
    """(chrom, pos, id, alt, info, format, calls, sample names) of each record of a BCF file's bytes."""
    r = _Reader(gzip.GzipFile(fileobj=io.BytesIO(data)).read() if data[:2] == b"\x1f\x8b" else data)
    if r.data[:4] != b"BCF\2":
        raise ValueError("not a BCF file")
    r.at = 5
    n = r.take("<I")
    words, contigs, names = _dictionaries(r.data[r.at : r.at + n].decode())
    r.at += n
    while r.at < len(r.data):
        shared, own = r.take("<II")
        end = r.at + shared + own
        chrom, pos, _, _, counts, sizes = r.take("<iiifII")
        n_info, n_alleles, n_format, n_samples = counts & 0xFFFF, counts >> 16, sizes >> 24, sizes & 0xFFFFFF
        name = r.typed() or "."
        found = [r.typed() for _ in range(n_alleles)]
        r.typed()  # filters
        facts = []
        for _ in range(n_info):
            key = words[r.typed()[0]]
            t, k = r.kind()
            facts.append(f"{key}={_text(r.values(t, k))}" if k else key)
        keys, columns = [], []
        for _ in range(n_format):
            keys.append(words[r.typed()[0]])
            t, k = r.kind()
            columns.append([_genotype(r.values(t, k)) if keys[-1] == "GT" else _text(r.values(t, k)) or "." for _ in range(n_samples)])
        yield contigs[chrom], pos + 1, name, ",".join(found[1:]) or ".", ";".join(facts) or ".", ":".join(keys), [":".join(c[i] for c in columns) for i in range(n_samples)], names
        r.at = end


def read_bcf(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """As read_text(), for BCF; a file is decoded by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                rows = [(p, {"block": 0, "row": i}, *r) for i, r in enumerate(decode_bcf(content))]
                for i in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[i : i + 10_000], columns=["path", "place", "chrom", "pos", "id", "alt", "info", "format", "calls", "sample_names"])

    return _named(files(spark, "binaryFile", path).select("path", "content").mapInPandas(run, f"path string, place struct<block:long,row:long>, {FIELDS}, sample_names array<string>"), pattern)




def read(spark: SparkSession, paths: list[str], pattern: str | None = None) -> DataFrame:
    """All of the files, text and binary ones together."""
    binary = [p for p in paths if p.endswith(".bcf")]
    text = [p for p in paths if not p.endswith(".bcf")]
    parts = ([read_text(spark, text, pattern)] if text else []) + ([read_bcf(spark, binary, pattern)] if binary else [])
    if not parts:
        raise ValueError("no files")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
