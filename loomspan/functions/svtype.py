"""Scalar rules for variant types, ends, genotypes, names and source lists, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of deletions and duplications in calls and truth sets.
DELETIONS = ("DEL", "DELETION")
DUPLICATIONS = ("DUP", "DUPLICATION", "INS", "INSERTION")
MOBILE_ELEMENTS = ("LINE1", "ALU", "SVA")
NEITHER = ("BND", "INV", "TRA", "CTX")
SEX_CHROMOSOMES = ("chrX", "chrY", "X", "Y")

DIPLOID, HAPLOID, SEX_CUT = 2.0, 1.0, 1.5


def of_call(name: Column) -> Column:
    """DEL, DUP or NA by the exact name, in any case."""
    n = F.upper(name)
    return F.when(n.isin(*DELETIONS), "DEL").when(n.isin(*DUPLICATIONS), "DUP").otherwise("NA")


def of_alt(alt: Column) -> Column:
    """of_call() for a symbolic allele such as <DEL>."""
    return of_call(F.regexp_replace(alt, r"^<|>$", ""))


def of_truth(name: Column, record_id: Column, strict: bool = False) -> Column:
    """DEL, DUP or NA by what the name contains; a CNV goes by its record's id.

    Names that fit nothing are NA, or raise an error if strict.
    """
    n, i = F.upper(name), F.upper(F.coalesce(record_id, F.lit("")))
    has = lambda c, words: F.greatest(F.lit(False), *(c.contains(w) for w in words))
    unknown = F.raise_error(F.concat(F.lit("unknown variant type: "), n)) if strict else F.lit("NA")
    return (
        F.when(name.isNull(), "NA").when(has(n, DELETIONS), "DEL").when(has(n, DUPLICATIONS), "DUP").when(has(n, MOBILE_ELEMENTS), "DUP")
        .when(n.contains("CNV") & has(i, DELETIONS[:1]), "DEL").when(n.contains("CNV") & has(i, DUPLICATIONS[:1]), "DUP").when(has(n, NEITHER), "NA").otherwise(unknown)
    )


def of_copy_number(rdcn: Column, chrom: Column, sex_threshold: Column) -> Column:
    """DUP above the threshold, else DEL; NA without a number.  The threshold is 2 but on sex chromosomes."""
    limit = F.when(chrom.isin(*SEX_CHROMOSOMES), sex_threshold).otherwise(DIPLOID)
    return F.when(rdcn.isNull(), "NA").when(rdcn > limit, "DUP").otherwise("DEL")


def sex_threshold(numbers: str) -> Column:
    """Aggregate of the column of copy numbers on a file's sex chromosomes: 1 if their upper median is below 1.5, else 2."""
    middle = F.expr(f"percentile_disc(0.5) within group (order by {numbers} desc)")
    return F.when(middle < SEX_CUT, HAPLOID).otherwise(DIPLOID)


def of_array_copies(cn: Column) -> Column:
    """DEL for 0 and 1 copies, DUP for 3 and more, null for 2."""
    return F.when(cn <= 1, "DEL").when(cn >= 3, "DUP")


def call_end(end: Column, pos: Column) -> Column:
    return F.coalesce(end.try_cast("long"), pos)


def truth_end(end: Column, svlen: Column, pos: Column) -> Column:
    """END, else position plus absolute length, else null."""
    return F.coalesce(end.try_cast("long"), pos + F.abs(svlen.try_cast("long")))


def genotype(alleles: Column) -> Column:
    """The first two alleles as text, missing ones as -1."""
    return F.array_join(F.transform(F.slice(alleles, 1, 2), lambda a: F.coalesce(a, F.lit(-1)).cast("string")), "/")


def is_carrier(alleles: Column, keep_missing: bool = True) -> Column:
    """Whether any allele isn't the reference; a missing one counts unless told otherwise."""
    return F.exists(F.slice(alleles, 1, 2), lambda a: F.coalesce(a, F.lit(-1)) != 0 if keep_missing else F.coalesce(a, F.lit(0)) > 0)


def with_chr(chrom: Column) -> Column:
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def dataset_key(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def source_key(name: Column) -> Column:
    return F.lower(dataset_key(name))


def sources_text(tools: Column) -> Column:
    """Comma lists such as "a,b" and "b,c" (an array) as sorted distinct names, a|b|c."""
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(tools, lambda t: F.split(t, ","))))), "|")


def sorted_sources(sources: Column) -> Column:
    return F.array_join(F.array_sort(F.split(sources, r"\|")), "|")


def display_name(key: Column, names: dict[str, str]) -> Column:
    """The name for a key, the key itself if it has none."""
    if not names:
        return key
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(table[key], key)
