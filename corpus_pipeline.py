"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read
again, so a lost executor costs no more than tasks of one stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import decontaminate, exact_dedup, language_id, ngram_join, packing, queries
from loomspan.llm.frames import fixed, keep, relieve, row_tag, table, unused

#: No stage but the second can be said in SQL; each, and run(), is tested against a brute-force version in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def _kept(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """The rows of docs, which is fixed(), whose row_tag is in tags."""
    tag = unused(docs, "tag")
    return docs.withColumn(tag, row_tag(docs.sparkSession)).join(tags.select(F.col("row_tag").alias(tag)), tag, "left_semi").drop(tag)


def _stage(run: Callable) -> Callable:
    """run, begun with executors' memory as small as it gets, whatever ran in them before."""

    @functools.wraps(run)
    def out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        relieve(spark)
        return run(spark, docs, sf_dir)

    return out


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; learned from three quarters of the labelled ones, by id.

    Documents of null, empty or white text, and all if none is labelled, go.
    Repeated rows are each judged; an empty table gives an empty one; columns
    stay as they are.
    """
    model = language_id.fit(docs.where(~language_id.held_out()), order=F.col("doc_id"))
    own = {c: unused(docs, f"{c}_") for c in docs.columns if c.startswith("lang_")}  # the operator would replace some of these names
    judged = language_id.identify(docs.withColumnsRenamed(own), model)
    known = judged.where(~F.col("lang_rejected")).drop("lang_pred", "lang_score", "lang_rejected")
    return known.withColumnsRenamed({v: k for k, v in own.items()})


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that of the smallest doc_id; null and empty texts are one group.

    Of repeated rows one stays; an empty table gives an empty one; columns
    stay as they are.
    """
    docs = fixed(docs)
    return _kept(docs, exact_dedup.exact_dedup(docs).where("kept"))


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts, that of the smallest doc_id, null last.

    Texts without words are linked with nothing and all stay.  Of repeated
    rows one stays; an empty table gives an empty one; columns stay as they
    are.
    """
    docs = fixed(docs)
    found = ngram_join.near_duplicates(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_tag")).alias("first")
    ones = found.where("class_id is not null").groupBy("class_id").agg(first).select("first.row_tag")
    return _kept(docs, ones.unionByName(found.where("class_id is null").select("row_tag")))


@_stage
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts and repeated rows without one stay; an empty table
    gives an empty one; columns stay as they are.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in training sequences: the columns of op5's query.

    Every row is packed, a null or empty text as its end id, repeated rows
    each for themselves; an empty table gives an empty one.
    """
    return packing.pack(docs, queries.tokenizer_path()).drop("row_tag")


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("decontamination", clean), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
