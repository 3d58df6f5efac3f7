"""Documents whose sets of word shingles have a Jaccard similarity of 0.8 and more.

Adaptive multi-match prefixes (after Wang, Li and Feng, "Can we beat the
prefix filtering?", 2012).  All shingles have one global order, rare ones
first.  If two sets are similar, the prefixes of length n - ceil(0.8 n) + k
share at least k shingles, for every k; each document takes the k whose
estimated cost is least, and a pair is verified if its prefixes share the
smaller k of the two.

1. Equal sets become one: what follows works on distinct sets.
2. A first order sets most of them aside.  Shingles whose hash is in the
   lowest SHARE of all hashes come first, by how many sets have them, counted
   exactly and over all documents; then come the others, by hash.  As a
   prefix is a fifth of a set, it nearly always ends among the first kind, so
   only those travel; a set that has too few of them sends the others that
   its prefix may need.  A set whose prefix shares nothing with any other is
   alone.
3. The others are put in the full order: all of their shingles are counted
   among them.  Shingles that one set has are only counted: they take places
   in its prefix but make no pair.  Of the others a set keeps those in its
   prefix, whose length it chooses by the lengths of the lists they are in.
4. Rounds of leaders.  In each list the set with the fewest shingles of its
   own leads its size class.  Each set is verified against one leader, that
   with which it shares the most; components of these links label the sets.
   In the next rounds a label stands in a list with one set.  So a group of
   near copies comes to one label after a number of pairs that grows with its
   size, not its square.
5. Only pairs of sets with different labels are then counted over the part
   of their prefixes that their two sizes leave, filtered by k and verified.
   A pair with one label adds nothing to the components, and a pair that
   shares less isn't similar, so the components are exact.

Verification compares whole sets, made anew from the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected
from .frames import batches, cut, keep, lean, sieve, signed, tagged
from .texthash import U, mix, sequence_hashes, word_hashes

WIDTH = 5
THRESHOLD = 80  # in hundredths
MOST_MATCHES = 4
#: Of all hashes the share whose shingles are counted and come first in the first order.
SHARE = 0.25
SKETCH_BITS = 14
#: Lists above this many sets, by the estimate, are counted in several parts.
HOT_LIST = 100_000
#: Cost of verifying a pair, in list entries read.
VERIFY_COST = 50.0
LEADER_ROUNDS = 2


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, offsets = word_hashes(texts, lower=True)
    hashes, at = sequence_hashes(words, offsets, WIDTH)
    cuts = np.searchsorted(at, offsets)
    out = []
    for i in range(len(texts)):
        n = offsets[i + 1] - offsets[i]
        if n >= WIDTH:
            out.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
        elif n:
            short = np.array([n], np.uint64)
            for w in words[offsets[i] : offsets[i + 1]]:
                short = mix(short * U(0x9E3779B97F4A7C15) + w)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(shingles: np.ndarray, seed: int = 0) -> tuple[np.uint64, np.uint64]:
    """Two independent numbers for a set; equal sets have equal numbers."""
    more = U(2 * seed + 1) * U(0xA0761D6478BD642F)
    a = mix(shingles ^ more).sum(dtype=np.uint64, keepdims=True)
    b = mix(shingles + more).sum(dtype=np.uint64, keepdims=True)
    return mix(a + U(len(shingles)))[0], mix(b ^ U(len(shingles)))[0]


def least_common(n):
    """Shingles at least that a similar set has of a set of n."""
    return -(-THRESHOLD * n // 100)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= THRESHOLD * (len(a) + len(b) - common)


def tokens(shingles: np.ndarray, share: float) -> tuple[np.ndarray, int]:
    """(the shingles of a set that may be in its prefix, how many of them are of the first kind).  The others are in order."""
    n = len(shingles)
    first = n if share >= 1 else int(np.searchsorted(shingles, U(int(share * 2**64))))
    need = min(n, n - least_common(n) + 1)
    return shingles[: max(first, need)], first


def _read(rows: DataFrame, seed: int) -> DataFrame:
    """doc_id, row_tag, n_shingles, set_id, proof, first, tokens.  proof: differs where different sets have one set_id."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen = set()
        for column in series:
            out = []
            for _, texts in batches([column.to_frame("text")]):
                for s in shingle_sets(texts):
                    a, b = set_id(s, seed)
                    t, first = tokens(s, SHARE) if len(s) and a not in seen else (s[:0], 0)
                    seen.add(a)
                    out.append((len(s), signed(a), signed(b), first, signed(t)))
            yield pd.DataFrame(out, columns=["n", "id", "proof", "first", "tokens"])

    made = F.pandas_udf(lean(run), "n int, id long, proof long, first int, tokens array<long>")
    return rows.withColumn("_s", made("text")).select("doc_id", "row_tag", F.col("_s.n").alias("n"), F.col("_s.id").alias("set_id"), "_s.proof", "_s.first", "_s.tokens")


def _sets(rows: DataFrame) -> DataFrame:
    """As _read(); equal set_ids are equal sets."""
    for seed in range(64):
        out = keep(_read(rows, seed))
        if not out.groupBy("set_id").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo <> hi").limit(1).count():
            return out
    raise RuntimeError("different sets have equal numbers under 64 seeds")


def _once(sets: DataFrame) -> DataFrame:
    """One row of each set that isn't empty; in sets only the first row of a task has the tokens."""
    carrying = sets.where(F.size("tokens") > 0)
    again = carrying.groupBy("set_id").agg(F.count("*").alias("_c"), F.min("row_tag").alias("_one")).where("_c > 1").select("set_id", "_one")
    return carrying.join(again, "set_id", "left").where("_one is null or _one = row_tag").select("set_id", "row_tag", "n", "first", "tokens")


def _hot(every: DataFrame) -> dict[int, int]:
    """How many sets have shingles of a slot above the usual load, for slots where that is over HOT_LIST; a slot is the lowest bits of a hash."""
    slots = 1 << SKETCH_BITS
    found = {r["slot"]: r["n"] for r in every.groupBy(F.col("token").bitwiseAND(slots - 1).alias("slot")).agg(F.count("*").alias("n")).collect()}
    usual = float(np.median([found.get(i, 0) for i in range(slots)]))
    most = usual + 3 * np.sqrt(usual) + HOT_LIST
    return {i: int(n - usual) for i, n in found.items() if n > most}


def _shared(once: DataFrame) -> DataFrame:
    """token, set_id, n, code, df: shingles that several sets have; code: the number of the set's counted shingles, or -1 - place of one of the others.

    A list that a slot's load shows to be hot is counted in parts by set, and
    its estimated length stands for the exact one, alike in all its rows.
    """
    every = once.select("set_id", "n", "first", F.posexplode("tokens").alias("i", "token"))
    code = F.when(F.col("i") < F.col("first"), F.col("first")).otherwise(-1 - F.col("i"))
    packed = F.shiftleft(F.col("n").cast("long"), 32) + code.cast("long") + F.lit(1 << 31)
    rows = every.select("token", "set_id", packed.alias("info"))
    hot = _hot(once.select(F.explode("tokens").alias("token")))
    if hot:
        load = F.coalesce(F.element_at(F.from_json(F.lit("{" + ",".join(f'"{k}":{v}' for k, v in hot.items()) + "}"), "map<string,bigint>"), F.col("token").bitwiseAND((1 << SKETCH_BITS) - 1).cast("string")), F.lit(0))
        rows = rows.withColumn("load", load).withColumn("salt", F.pmod("set_id", F.floor(F.col("load") / HOT_LIST) + 1))
        counted = rows.withColumn("df", F.when(F.col("load") > 0, F.col("load") + 2).otherwise(F.expr("count(*) over (partition by token, salt)")))
    else:
        counted = rows.withColumn("df", F.expr("count(*) over (partition by token)"))
    found = counted.where("df > 1")
    code = F.col("info").bitwiseAND((1 << 32) - 1) - F.lit(1 << 31)
    return found.select("token", "set_id", F.shiftright("info", 32).cast("int").alias("n"), code.cast("int").alias("code"), "df")


def _prefixes(shared: DataFrame, most: int) -> DataFrame:
    """token, set_id, n, pos, need, own: the shared shingles in each set's prefix, at their places in it; need: how many of them a similar set must share, `most` at most; own: places before all that several sets have."""
    one = Window.partitionBy("set_id")  # the shingles of one document
    late = F.col("code") < 0
    rank = F.row_number().over(one.orderBy(late, F.when(late, -1 - F.col("code")).otherwise(F.col("df")), "token")) - 1
    own = F.max(F.col("code")).over(one) - F.count_if(~late).over(one)
    base = F.col("n") - F.ceil(F.col("n") * F.lit(THRESHOLD) / F.lit(100)).cast("int")
    placed = shared.withColumn("rank", rank).withColumn("own", F.greatest(own, F.lit(0)).cast("int")).withColumn("pos", F.when(late, -1 - F.col("code")).otherwise(F.col("rank") + F.col("own")).cast("int")).withColumn("base", base)
    reach = placed.where(F.col("pos") < F.col("base") + most)
    costs = []
    for k in range(1, most + 1):
        others = F.sum(F.when(F.col("pos") < F.col("base") + k, F.col("df") - 1)).over(one)
        cost = F.when(F.col("base") + k <= F.col("n"), others * (1 + VERIFY_COST / k) + k)
        costs.append(F.struct(F.coalesce(cost, F.lit(float("inf"))).alias("cost"), F.lit(k).alias("k")))
    need = F.array_min(F.array(*costs))["k"] if most > 1 else F.lit(1)
    return reach.withColumn("need", need).where(F.col("pos") < F.col("base") + F.col("need")).select("token", "set_id", "n", "pos", "need", "own")


def _room(n_a: Column, n_b: Column) -> Column:
    """Shingles that two sets of these sizes must share."""
    return F.ceil((n_a + n_b) * F.lit(THRESHOLD) / F.lit(100.0 + THRESHOLD) - F.lit(1e-6))


def _sizes_fit(n_a: Column, n_b: Column) -> Column:
    return F.lit(100) * F.least(n_a, n_b) >= F.lit(THRESHOLD) * F.greatest(n_a, n_b)


def _open(lists: DataFrame) -> DataFrame:
    """The sets that share a list with another."""
    several = lists.groupBy("token").agg(F.min("set_id").alias("lo"), F.max("set_id").alias("hi")).where("lo <> hi").select("token")
    return lists.join(several, "token", "left_semi").select("set_id").distinct()


def _whole(texts: DataFrame) -> DataFrame:
    """set_id, n, first, tokens: all shingles of each set."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in series:
            yield pd.Series([signed(s) for _, part in batches([column.to_frame("text")]) for s in shingle_sets(part)], dtype=object)

    made = texts.select("set_id", F.pandas_udf(lean(run), "array<long>")("text").alias("tokens"))
    return made.select("set_id", F.size("tokens").alias("n"), F.size("tokens").alias("first"), "tokens")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids that are similar, by whole sets.  texts: a text of each set; texts travel, as compressed they are less than half the size of shingles."""
    left = cut(pairs).join(texts.withColumnsRenamed({"set_id": "b", "text": "text_b"}), "b")
    both = left.join(texts.withColumnsRenamed({"set_id": "a", "text": "text_a"}), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict = {}
        for frame in frames:
            for rows, texts_b in batches([frame], "text_b", 1 << 20):
                mine = shingle_sets(texts_b)
                good = []
                for a, t, s in zip(rows["a"], rows["text_a"], mine, strict=True):
                    if a not in last:
                        last = {a: shingle_sets([t.encode("utf-8", "surrogatepass")])[0]}
                    good.append(similar(last[a], s))
                yield rows.loc[good, ["a", "b"]]

    return cut(both.select("a", "b", "text_a", "text_b").mapInPandas(lean(run), "a long, b long"))


def _enough(shared: Column, n_a: Column, n_b: Column, need_a: Column, need_b: Column) -> Column:
    """Whether two sets that share so many prefix shingles may be similar.

    Of the prefix that ends first in global order all common shingles are
    counted; what the set has behind it bounds those that aren't.
    """
    behind = lambda n, need: F.ceil(n * F.lit(THRESHOLD) / F.lit(100.0) - F.lit(1e-6)) - need
    return shared + F.greatest(behind(n_a, need_a), behind(n_b, need_b)) >= _room(n_a, n_b)


def _named(lists: DataFrame, labels: DataFrame | None) -> DataFrame:
    """lists with root, the label of the set or else the set itself."""
    if labels is None:
        return lists.withColumn("root", F.col("set_id"))
    return lists.join(labels.select(F.col("node").alias("set_id"), "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))


def leader_pairs(named: DataFrame, turn: int) -> DataFrame:
    """For each set that stands for its label in a list the leader with which it shares the most, if that is enough to make them likely similar.

    Size classes are moved by half in every other turn.  What this passes
    over stays under different labels and is met by crossing_pairs().
    """
    classed = named.withColumn("size", F.floor(F.log2(F.col("n")) * 6 + 0.5 * turn).cast("int"))
    stands = classed.groupBy("token", "size", "root").agg(F.min(F.struct("own", "set_id", "n", "need")).alias("one")).select("token", "size", "root", "one")
    leaders = stands.groupBy("token", "size").agg(F.min(F.struct("one", "root")).alias("first"), F.count("*").alias("several")).where("several > 1").select("token", "size", "first")
    met = stands.join(leaders, ["token", "size"]).where(F.col("root") != F.col("first.root"))
    pairs = met.groupBy(F.col("one.set_id").alias("b"), F.col("first.one.set_id").alias("a")).agg(F.count("*").alias("shared"), *(F.first(f"{side}.{c}").alias(f"{c}_{name}") for c in ("n", "need") for side, name in (("one", "b"), ("first.one", "a"))))
    likely = pairs.where(_sizes_fit(F.col("n_a"), F.col("n_b")) & _enough(F.col("shared"), F.col("n_a"), F.col("n_b"), F.col("need_a"), F.col("need_b")))
    return likely.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")


def crossing_pairs(named: DataFrame) -> DataFrame:
    """Pairs of sets with different labels that share as many prefix shingles as they must and may be similar by size and position."""
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    open_lists = named.join(mixed, "token", "left_semi").select("token", "set_id", "n", "pos", "need", "root")
    places = open_lists.groupBy("set_id").agg(F.slice(F.array_sort(F.collect_list("pos")), 1, MOST_MATCHES).alias("places"))
    open_lists = keep(open_lists.join(places, "set_id"))
    x, y = open_lists.alias("x"), open_lists.alias("y")
    n_a, n_b = F.col("x.n"), F.col("y.n")
    need = F.least("x.need", "y.need")
    spare = need - _room(n_a, n_b)  # of the first n + spare shingles of either side similar sets share `need`
    inside = (F.col("x.pos") < n_a + spare) & (F.col("y.pos") < n_b + spare)
    inside &= F.coalesce((F.get("x.places", need - 1) < n_a + spare) & (F.get("y.places", need - 1) < n_b + spare), F.lit(False))  # either side has as many there
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.set_id") < F.col("y.set_id")) & (F.col("x.root") != F.col("y.root")) & _sizes_fit(n_a, n_b) & inside)
    counted = met.groupBy(F.col("x.set_id").alias("a"), F.col("y.set_id").alias("b")).agg(F.count("*").alias("shared"), F.first(need).alias("need"))
    return counted.where("shared >= need").select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, row_tag, n_shingles, component_id, class_id (equal in a component, null for empty sets).

    A set is the distinct 5-word shingles of the whole text in lower-case
    ASCII; with fewer words, the whole sequence; a null or empty text or one
    of white space has an empty set, is linked with nothing and is its own
    component.  component_id is the smallest doc_id reachable by links; null
    ids don't count, so it is null only where all ids reached are null.
    Repeated rows are in one component; ties are no matter, as all links
    count.  row_tag tells rows apart.  Other columns aren't read and may have
    any name.  A text of any length is one set.  An empty table gives an
    empty result.
    """
    rows = tagged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    sets = _sets(rows)
    once = _once(sets)
    first = keep(_prefixes(_shared(once), 1).select("token", "set_id"))
    ones = cut(once.select("set_id", "row_tag").join(_open(first), "set_id", "left_semi"))
    texts = keep(rows.where(sieve(ones, "row_tag")).join(ones, "row_tag").select("set_id", "text"))
    lists = keep(_prefixes(_shared(keep(_whole(texts))), MOST_MATCHES))
    labels = None
    for turn in range(LEADER_ROUNDS):
        found = verified(leader_pairs(_named(lists, labels), turn), texts).select(F.col("a").alias("u"), F.col("b").alias("v"))
        labels = connected(found if labels is None else found.unionByName(labels.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    last = verified(crossing_pairs(_named(lists, labels)), texts)
    roots = connected(labels.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(last.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    classes = sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least")).join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    ids = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(ids, "root").select("set_id", F.col("root").alias("class_id"), "component_id")
    return sets.select("doc_id", "row_tag", F.col("n").cast("long").alias("n_shingles"), "set_id").join(named, "set_id", "left").select("doc_id", "row_tag", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class_id")
