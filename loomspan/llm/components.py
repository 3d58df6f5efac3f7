"""Connected components of a graph given as links, in DataFrame operations.

Large-star and small-star steps in turn (Kiveris et al., "Connected Components
in MapReduce and Beyond", 2014).  A step is a minimum per node, which adds up
before it shuffles, and an equi-join back that Spark may split where a node
has very many links; no node's links are ever gathered.  Each round is cut
with a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut

ROUNDS = 60


def _total(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def connected(links: DataFrame) -> DataFrame:
    """links has u and v, in any order, repeats and loops allowed; returns node, root for all nodes of links, root being the smallest node reachable."""
    links = links.where("u is not null and v is not null and u <> v")
    now = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _total(now)
    rounds = 0
    while before[0]:
        rounds += 1
        if rounds > ROUNDS:
            raise RuntimeError(f"components still changed after {ROUNDS} rounds")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        after = _total(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
