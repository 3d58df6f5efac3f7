"""Each stage of the pipeline, and all in a row, against brute-force versions; and that each query can be called."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspan.llm import language_id, packing, queries
from loomspan.llm.frames import keep

from test_operators import components, edits_between

KINDS = {"aa": "the of and with in onto from under".split(), "bb": "der die das und mit auf aus bei".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_tag string, lang_rejected string, kept int, _loomspan_tag int"


def prose(kind, n, seed):
    r = random.Random(f"{kind}{seed}")
    return [r.choice(KINDS[kind]) + r.choice(["", "e", "en", "s"]) + str(r.randrange(9)) * r.randrange(2) for _ in range(n)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    items = [(i, " ".join(prose("aa", 14, 900 + i))) for i in range(4)] + [(9, None), (10, "")]
    rows = [(i, " ".join(prose(("aa", "bb")[i % 2], 50 + i, i)), ("aa", "bb")[i % 2]) for i in range(40)]
    near = rows[4][1].split()
    near[20] = "other"
    rows += [(50, rows[3][1], "bb"), (51, rows[3][1].replace(" ", "\n  "), None), (52, " ".join(near), "aa"), (53, rows[5][1].upper(), "bb"), (54, None, "aa"), (55, "", None), (56, " \n", None), (57, "12 34", None), (None, rows[7][1], None), (None, " ".join(prose("bb", 70, 777)), None)]
    rows += [(60 + i, " ".join(prose("aa", 30, 60 + i) + items[i][1].split() + prose("aa", 20, 80 + i)), "aa") for i in range(4)]
    rows += [(70, " ".join(prose("bb", 4000, 70)), "bb"), rows[0], rows[0]]
    full = [(i, t, k, "s", len(t or ""), "r", "x", 1, 2) for i, t, k in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.parquet(str(top / "documents.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(top / "none" / "documents.parquet"))
    for at in (top, top / "none"):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(top)


def first_of(rows, classes):
    """Of the rows of a class that with the smallest id, null last; rows of class None all."""
    best = {}
    for k, (row, c) in enumerate(zip(rows, classes)):
        best.setdefault(("alone", k) if c is None else c, []).append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in best.values()]


def brute(spark, name, rows, docs, folder):
    if name == "language_id":
        model = language_id.fit(docs.where(~language_id.held_out()), order=F.col("doc_id"))
        levels = language_id.coders(model)
        return [r for r in rows if not language_id.classify(r[1], model.languages, levels)[2]]
    if name == "exact_dedup":
        return first_of(rows, [re.sub("[ \t-\r]+", " ", r[1] or "") for r in rows])
    if name == "ngram_join":
        found = components([(i, r[1] or "") for i, r in enumerate(rows)])
        return first_of(rows, [c if n else None for _, n, c in found])
    items = [r["text"].split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"]]
    return [r for r in rows if not any(edits_between([w.lower() for w in x], (r[1] or "").lower().split()) <= len(x) // 5 for x in items)]


def pieces(rows):
    from tokenizers import Tokenizer

    coder, out = Tokenizer.from_file(queries.tokenizer_path()), collections.Counter()
    for r in rows:
        ids = [*coder.encode(r[1] or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            part = ids[at : at + packing.CAPACITY]
            out[r[0], n, at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    return out


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        want = collections.Counter(brute(spark, name, rows, docs, folder))
        got = stage(spark, docs.repartition(5), folder)  # not a plain read; run() below goes over those
        assert got.columns == docs.columns
        assert collections.Counter(map(tuple, got.collect())) == want, name
    now = docs
    for name, _ in corpus_pipeline.STAGES[:-1]:
        rows = brute(spark, name, rows, now, folder)
        now = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) > 20 and collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == pieces(rows)
    assert max(r["offset"] + r["length"] for r in out) <= packing.CAPACITY


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_queries_can_be_called(spark):
    """Each opN_ query on the smallest tables: its columns, and a row for each document or page where its contract says so."""
    at = "/root/testdata/sf0.001"
    n, pages = spark.read.parquet(f"{at}/documents.parquet").count(), spark.read.parquet(f"{at}/pages.parquet").count()
    asked = {
        1: ("doc_id held_out lang_pred score", n), 2: ("doc_id n_bytes n_removed n_spans kept_sha256", n), 3: ("doc_id n_shingles component_id", n), 4: ("doc_id", n), 5: ("doc_id piece start length ids_crc32 sequence_id offset", None),
        6: ("doc_id keep_id group_size kept text_sha256", n), 7: ("doc_id n_words n_removed kept_sha256", n), 8: ("doc_id item_id", None), 9: ("page_id host path rule verdict", pages), 10: ("conv_id", None),
    }
    for name, query in queries.queries().items():
        columns, rows = asked[int(name[2:].split("_")[0])]
        out = keep(query(spark, at))
        assert set(columns.split()) <= set(out.columns), name
        assert out.count() == rows if rows else out.count() > 0, name
