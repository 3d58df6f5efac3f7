"""What steps leave in the processes that ran them."""

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import psutil
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import frames, ngram_join, packing, queries, word_repeats

#: MB of an idle worker with the libraries loaded, and some to spare.
IDLE = 130


def idle_workers():
    """MB of this process's Python workers, without mapped files."""
    out = []
    for p in psutil.Process().children(recursive=True):
        try:
            if "pyspark.daemon" in " ".join(p.cmdline()):
                out.append(sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text()))) >> 10)
        except (OSError, psutil.Error):
            pass
    return out


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """Four files of 2,000 different texts of 600 words, 5 MB each."""
    path = str(tmp_path_factory.mktemp("large"))
    word = lambda i: F.concat(F.lit("w"), F.conv(F.abs(F.xxhash64("doc_id", i)) % 10**6, 10, 36))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600)), word), " ")
    spark.range(0, 8000, 1, 4).withColumnRenamed("id", "doc_id").withColumn("text", text).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("operator", [word_repeats.word_repeats, ngram_join.near_duplicates])
def test_idle_workers_keep_nothing(spark, large, operator):
    assert operator(large).count() == 8000
    operator(large).write.format("noop").mode("overwrite").save()
    found = idle_workers()
    assert len(found) > 1 and max(found) < IDLE


def test_worker_forgets_words_for_other_steps(spark):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from series

    tokens = packing.word_tokens(queries.tokenizer_path())
    assert [list(s) for s in frames.lean(run, packing.word_tokens)([pd.Series([1])])] == [[1]]
    assert packing.word_tokens(queries.tokenizer_path()) is tokens
    assert [list(s) for s in frames.lean(run)([pd.Series([1])])] == [[1]]
    assert packing.word_tokens(queries.tokenizer_path()) is not tokens


def test_collection_runs_in_tasks(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if re.search("Old|MarkSweep|Copy", b.getName()))
    before = full()
    frames.collect_in_tasks(spark)
    assert full() > before


def test_stages_and_kept_tables_relieve_executors(spark, monkeypatch, large):
    seen = []
    monkeypatch.setattr(frames, "relieve", lambda s: seen.append("keep"))
    monkeypatch.setattr(corpus_pipeline, "relieve", lambda s: seen.append("stage"))
    frames.keep(spark.range(3))
    assert seen == ["keep"]
    few = large.limit(3).withColumn("lang", F.lit("en"))
    corpus_pipeline.language(spark, few, "")
    assert seen == ["keep", "stage"]
