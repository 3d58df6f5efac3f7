"""The entry module and, on the smallest tables, its queries against their SQL."""

import os

import pytest

import __spark_entry__
from loomspan.plans import oracle
from loomspan.plans import queries as plans

DIR = "/root/testdata/sf0.001"
TABLES = ("nation", "part", "orders", "lineitem")
SOME = ["svtype_method_dispatch", "vcf_calls_scan", "vcf_truth_scan", "vcf_header_samples", "array_calls_scan", "chain_scan", "bed_roundtrip", "classified_roundtrip", "log_roundtrip", "genome_scan", "venn3_shares", "common_samples", "consensus_log", "svtype_sanitize_truth", "excluded_antijoin", "consensus_union", "liftover_size_filter", "interval_complement", "classification_counts", "dist_cumulative", "venn3_regions"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(oracle.oracle_sql()) == set(plans.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables aren't here")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    text = lambda rows: sorted("|".join("" if v is None else f"{float(v):.6g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    df = plans.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(columns)
    assert text(tuple(r[c] for c in columns) for r in df.collect()) == text(want.fetchall())
