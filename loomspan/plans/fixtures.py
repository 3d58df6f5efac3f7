"""Interval tables derived from the order tables, in SQL that Spark and DuckDB both run ({string} is the engine's text type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHROMOSOMES = 22

# the caller delly has nothing for S8
CALLS = """
select concat('S', cast(l_orderkey % 9 as {string})) as sample,
  case when l_linenumber % 3 = 0 then 'cnvpytor' when l_linenumber % 3 = 1 and l_orderkey % 9 <> 8 then 'delly' else 'gatk' end as tool,
  concat('chr', cast(l_suppkey % 22 + 1 as {string})) as chrom,
  l_partkey * 5000 + (l_orderkey % 7) * 300 as cstart,
  l_partkey * 5000 + (l_orderkey % 7) * 300 + cast(floor(l_quantity * l_quantity * 200) as bigint) as cend,
  case when l_returnflag = 'A' then 'DEL' when l_returnflag = 'N' then 'DUP' else 'NA' end as svtype
from lineitem
"""
TRUTH = """
select concat('S', cast(o_orderkey % 8 as {string})) as sample, o_orderstatus as bench,
  concat('chr', cast(o_custkey % 22 + 1 as {string})) as chrom,
  (o_orderkey % 2000) * 5000 as cstart,
  (o_orderkey % 2000) * 5000 + cast(floor(o_totalprice / 4) as bigint) as cend,
  case when o_orderkey % 3 = 0 then 'DEL' else 'DUP' end as svtype
from orders where not (o_orderstatus = 'P' and o_orderkey % 8 in (3, 5))
"""
# samples that the header of each benchmark names; P names S5, of which it has no record, but not S3
HEADERS = """
select distinct o_orderstatus as bench, concat('S', cast(o_orderkey % 10 as {string})) as sample
from orders where not (o_orderstatus = 'P' and o_orderkey % 10 = 3)
"""
REGIONS = """
select concat('chr', cast(p_partkey % 22 + 1 as {string})) as chrom, p_partkey * 5000 as cstart,
  p_partkey * 5000 + p_size * 2000 as cend
from part where p_partkey % 5 = 0
"""
# two chromosomes are left off the list, so that the whitelist has something to do
GENOME = """
select concat('chr', cast(n_nationkey + 1 as {string})) as chrom, cast(250000000 - n_nationkey * 5000000 as bigint) as length, cast((n_nationkey * 7) % 22 as bigint) as ord
from nation where n_nationkey < 20
"""
BLOCKS = """
select p_partkey as chain_id, cast(p_size * 100 as bigint) as score, concat('chr', cast(p_partkey % 22 + 1 as {string})) as chrom,
  p_partkey * 5000 - 40000 as block_start, p_partkey * 5000 + 60000 as block_end,
  p_partkey * 5000 + 1000 + p_size * 10 as new_start, case when p_size % 10 = 0 then '-' else '+' end as new_strand, cast(300000000 as bigint) as new_length
from part where p_partkey % 2 = 0
"""
# one record of a caller's file for each line item
RECORDS = """
select cast(l_orderkey % 50 as bigint) as file_id, l_orderkey * 1000000 + l_partkey * 100 + l_linenumber as record_no,
  case l_suppkey % 24 when 22 then 'X' when 23 then 'chrY' else concat('chr', cast(l_suppkey % 24 + 1 as {string})) end as chrom,
  l_partkey * 100 as pos,
  case l_linenumber when 1 then cast(l_partkey * 100 + 500 as {string}) when 2 then 'x' end as info_end,
  case when l_partkey % 4 = 0 then cast(0 - l_partkey as {string}) end as info_svlen,
  case l_orderkey % 50 % 4 when 0 then case l_partkey % 9 when 0 then 'del' when 1 then 'DUPLICATION' when 2 then 'INS' when 3 then 'BND' when 4 then 'CNV' when 5 then 'ALU' when 6 then 'insertion' when 7 then 'LINE1' end end as info_svtype,
  case l_orderkey % 50 % 4 when 1 then case l_partkey % 5 when 0 then '<DEL>' when 1 then '<DUP>' when 2 then '.' else '<INV>' end else 'A' end as alt,
  case when l_partkey % 3 = 0 then 'cnv_DEL_1' when l_partkey % 3 = 1 then 'cnv_DUP_2' end as record_id,
  case when l_orderkey % 50 % 4 = 2 then floor(l_quantity) / 10 end as rdcn,
  cast(l_linenumber % 3 - 1 as int) as allele_a, cast(l_partkey % 3 - 1 as int) as allele_b
from lineitem
"""
NAMES = {"calls": CALLS, "truth": TRUTH, "headers": HEADERS, "regions": REGIONS, "genome": GENOME, "blocks": BLOCKS, "records": RECORDS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = NAMES[name].format(string="string")
    source = sql.rpartition("from ")[2].split()[0]
    return spark.sql(sql.replace(f"from {source}", "from {source}"), source=table(spark, sf_dir, source))
