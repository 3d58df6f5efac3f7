"""Interval files: BED in several roles, genome tables, chains, array-caller text, run logs; and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.svtype import of_array_copies, with_chr

PLACE = "chrom string, cstart long, cend long"
SCHEMAS = {
    "regions": PLACE,
    "calls": f"{PLACE}, svtype string",
    "control": f"{PLACE}, svtype string, source string",
    "consensus": f"{PLACE}, svtype string, sources string",
    "truth": f"{PLACE}, id string, svtype string, genotype string",
    "TP": "pred_chrom string, pred_start long, pred_end long, svtype string, sources string, truth_chrom string, truth_start long, truth_end long",
    "FP": "pred_chrom string, pred_start long, pred_end long, svtype string, sources string",
    "FN": "truth_chrom string, truth_start long, truth_end long",
}


def read_bed(spark: SparkSession, path: str | list[str], role: str = "regions", named: bool = False) -> DataFrame:
    """A BED file, folder or list of them.  named: sample and svtype are taken from names such as S1.DEL.bed and win over the file's column."""
    rows = spark.read.schema(SCHEMAS[role]).option("sep", "\t").option("comment", "#").csv(path)
    if not named:
        return rows
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    parts = F.split(name, r"\.")
    return rows.withColumns({"sample": parts[0], "svtype": parts[1]})


def write_bed(df: DataFrame, path: str, role: str = "regions", by: tuple[str, ...] = ()) -> None:
    """Tab-separated rows without a header, in folders by the given columns."""
    names = [c.split()[0] for c in SCHEMAS[role].split(", ")]
    names = [n for n in names if n not in by]
    df.select(*names, *by).write.mode("overwrite").partitionBy(*by).option("sep", "\t").csv(path)


def read_classified(spark: SparkSession, path: str) -> DataFrame:
    """What write_bed() wrote of the TP, FP and FN rows below a folder, with sizes, as classify() gives them."""
    parts = []
    for kind in ("TP", "FP", "FN"):
        names = [c for c in SCHEMAS[kind].split(", ") if c != "svtype string"]
        rows = spark.read.schema(", ".join([*names, "input_set string", "sample string", "svtype string"])).option("sep", "\t").csv(f"{path}/{kind}")
        sizes = {f"{side}_size": F.col(f"{side}_end") - F.col(f"{side}_start") for side in ("pred", "truth") if f"{side}_start long" in names}
        parts.append(rows.withColumn("classification", F.lit(kind)).withColumns(sizes))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """chrom (with chr), length, ord (the file's order; the file is one small split)."""
    rows = spark.read.schema("chrom string, length long").option("sep", "\t").csv(path)
    return rows.coalesce(1).select(with_chr(F.col("chrom")).alias("chrom"), "length", F.monotonically_increasing_id().alias("ord"))


def read_array_calls(spark: SparkSession, path: str) -> DataFrame:
    """Array-caller text: chrom, cstart, cend, svtype, sample.

    A line has a place chrN:start-end, a copy number cn=K and a path that
    names the sample, among words parted by white space.  Blank lines,
    comments, lines of under four words, those that lack a part, and two
    copies are left out.  The start isn't shifted.
    """
    line = F.trim("value")
    words = F.split(line, r"\s+")
    lines = spark.read.text(path).where((line != "") & ~line.startswith("#") & (F.size(words) >= 4)).withColumn("w", words)
    place = lambda n: F.regexp_extract(F.col("w")[0], r"^(chr[^:]+):(\d+)-(\d+)", n)
    holding = lambda text: F.get(F.filter("w", lambda x: x.contains(text)), 0)
    cn = F.regexp_extract(holding("cn="), r"cn=(\d+)", 1).try_cast("int")
    named = F.get(F.filter("w", lambda x: x.contains(".sig.tsv") | x.contains(".txt")), 0)
    given = F.coalesce(*(F.nullif(F.regexp_extract(named, p, 1), F.lit("")) for p in (r"([^/]+)\.sig\.tsv", r"([^/]+)\.txt")))
    base = F.element_at(F.split(F.get(F.filter("w", lambda x: x.contains("/")), 0), "/"), -1)
    spare = F.replace(F.replace(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit(".sig"), F.lit("")), F.lit(".bam"), F.lit(""))
    out = lines.select(place(1).alias("chrom"), place(2).try_cast("long").alias("cstart"), place(3).try_cast("long").alias("cend"), of_array_copies(cn).alias("svtype"), F.coalesce(given, F.nullif(spare, F.lit(""))).alias("sample"))
    return out.where("chrom <> '' and svtype is not null and sample is not null")


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """The aligned blocks of a chain file: chain_id, score, chrom, block_start, block_end, new_chrom, new_start, new_strand, new_length."""
    text = spark.read.option("lineSep", "\nchain").text(path)  # each row is a chain, mostly without that word
    lines = F.filter(F.split("value", r"\r?\n"), lambda s: (F.trim(s) != "") & ~s.startswith("#"))
    chains = text.where(F.col("value").startswith(" ") | F.col("value").startswith("chain ")).select(F.monotonically_increasing_id().alias("place"), lines.alias("l"))
    h = F.split(F.regexp_replace(F.trim(F.col("l")[0]), "^chain +", ""), r"\s+")
    head = [h[11].cast("long").alias("chain_id"), h[0].cast("long").alias("score"), h[1].alias("chrom"), h[4].cast("long").alias("t"), h[6].alias("new_chrom"), h[7].cast("long").alias("new_length"), h[8].alias("new_strand"), h[9].cast("long").alias("q")]
    each = chains.select("place", *head, F.posexplode(F.slice("l", 2, F.size("l"))).alias("i", "line")).withColumn("s", F.split(F.trim("line"), r"\s+"))
    step = lambda n: F.col("s")[0].cast("long") + F.coalesce(F.get("s", n).cast("long"), F.lit(0))
    before = Window.partitionBy("place").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    t, q = (F.col(c) + F.coalesce(F.sum(step(n)).over(before), F.lit(0)) for c, n in (("t", 1), ("q", 2)))
    return each.select("chain_id", "score", "chrom", t.alias("block_start"), (t + F.col("s")[0].cast("long")).alias("block_end"), "new_chrom", q.alias("new_start"), "new_strand", "new_length")


def read_log(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """JSON rows: one per line if a schema is given or lines is set, as write_log() writes them; else each file is one value over several lines."""
    reader = spark.read.option("multiLine", schema is None and not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_log(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, none if there is no such folder; for the few kinds of logs of a run."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()) if files.exists(place) else []
