"""Benchmark passages in documents, by CGK embedding and bit-sampling LSH.

An item of m words is in a document if some stretch of the document's words
is at most m // 5 word edits away (similarity 0.8).  Words are lower-cased in
ASCII.

* The CGK random walk (Chakraborty, Goldenberg, Koucky, 2016) writes a word
  of its input at each step and then moves on or stays, by a random bit for
  that step and word.  After an edit two walks soon fall in step again, so
  few edits become few differing places.
* A table of the LSH samples places of that output.  Tables share
  walks; the walks' number is set at fitting: items are edited at random as far
  as is allowed, and walks are added until the share of edited copies that share a bucket with their
  item reaches TARGET_RECALL, and then as many again.  Sizes for which that
  would take more than MOST_WALKS are not walked but looked for exactly.
* Items that share a bucket with an item-sized window of a document are
  verified by their exact edit distance around that window.

Which windows are embedded follows from the bound on edits: if m words are
cut in m // 5 + 1 pieces, a match has one of them unchanged, at most m // 5
places off.  All windows for which that holds are embedded; this loses
nothing, whatever the documents are.

Items of fewer than WALKED_WORDS words, and long ones that walks don't serve,
are looked for exactly: an edit changes q runs of q words at most, so a
stretch that matches shares m + 1 - q - q * (m // 5) of them with the item.
Where that many stand close enough together, the edit distance decides.

Items are sent to every task in blocks of at most BLOCK_BYTES of text.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import batches, fixed, keep, lean, row_tag, tagged, unused
from .texthash import U, mix, sequence_hashes, word_hashes

EDITS_PER = 5
#: Items with fewer words have pieces too short for PIECE_WORDS and are found by shared runs of words.
WALKED_WORDS = 8
TARGET_RECALL = 0.99
#: Tables that sample one walk, and walks at most.
PER_WALK = 6
MOST_WALKS = 16
PLACES = 2
TRIALS = 200
BLOCK_BYTES = 8 << 20
PIECE_WORDS = 3
#: Pairs of a run in a text and an item that are held at a time; one text alone may have more.
MOST_PAIRS = 2 << 20
_FILTER_BITS = 20
FOUND = "_loomspan_found"
_PAD = U(0x6A09E667F3BCC909)


def allowed(m: int) -> int:
    return m // EDITS_PER


def walk(words: np.ndarray, seed: int, places: np.ndarray) -> np.ndarray:
    """What the CGK walk writes at the sorted places, for each row of words."""
    n, m = words.shape
    padded = np.concatenate([words, np.full((n, 1), _PAD)], 1)
    at, row = np.zeros(n, np.int64), np.arange(n)
    odd = mix(np.arange(int(places[-1]) + 1, dtype=np.uint64) + U(seed << 32)) | U(1)
    out = np.empty((n, len(places)), np.uint64)
    k = 0
    for j in range(int(places[-1]) + 1):
        now = padded[row, at]
        while k < len(places) and places[k] == j:
            out[:, k] = now
            k += 1
        at = np.minimum(at + ((now * odd[j]) >> U(63)).astype(np.int64), m)
    return out


@functools.cache
def sampled(m: int, group: int) -> np.ndarray:
    """Places of each table of a walk."""
    draw = np.random.default_rng([m, group])
    return np.array([np.sort(draw.choice(2 * m, PLACES, replace=False)) for _ in range(PER_WALK)])


def buckets(words: np.ndarray, group: int) -> np.ndarray:
    """The buckets of each row of words in the tables that share a walk."""
    tables = sampled(words.shape[1], group)
    places = np.unique(tables)
    out = walk(words, group, places)
    total = np.broadcast_to(np.arange(PER_WALK, dtype=np.uint64) + U(PER_WALK * group), (len(words), PER_WALK))
    for k in range(PLACES):
        total = mix(total * U(0x9E3779B97F4A7C15) + out[:, np.searchsorted(places, tables[:, k])])
    return total


def distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least number of word edits between the item and any stretch of text, the end of that stretch)."""
    n = len(text)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, w in enumerate(item):
        step = np.minimum(row[1:] + 1, row[:-1] + (text != w))
        nxt = np.concatenate([[i + 1], step])
        row = np.minimum.accumulate(nxt - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


def shared_runs(m: int) -> tuple[int, int]:
    """(words of a run, PIECE_WORDS at most; runs that an item of m words shares with each stretch that matches, 1 at least)."""
    q = next(q for q in range(PIECE_WORDS, 0, -1) if m + 1 - q - q * allowed(m) > 0)
    return q, m + 1 - q - q * allowed(m)


@dataclass
class Items:
    """A block of items, ready to be looked for."""

    ids: list = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    walks: dict[int, int] = field(default_factory=dict)
    recall: dict[int, float] = field(default_factory=dict)  # by size: share of edited copies met at fitting; 1 where found exactly
    by_bucket: dict[int, dict[int, list[int]]] = field(default_factory=dict)  # by size: item by bucket
    pieces: dict[int, list[tuple[int, int]]] = field(default_factory=dict)  # by hash: (size, place in item)
    known: np.ndarray = field(default_factory=lambda: np.zeros(1 << _FILTER_BITS, bool))
    runs: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by words of a run: sorted hashes, the item of each


def fit(ids: list, texts: list[str | None]) -> Items:
    out = Items()
    coded = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    words, offsets = word_hashes(coded, lower=True)
    sizes = defaultdict(list)
    for i, item_id in enumerate(ids):
        mine = words[offsets[i] : offsets[i + 1]]
        if len(mine):
            sizes[len(mine)].append(len(out.ids))
            out.ids.append(item_id)
            out.words.append(mine)
    pieces, exact = defaultdict(set), []
    for m, mine in sizes.items():
        rows = np.stack([out.words[i] for i in mine])
        walks, out.recall[m] = _walks(rows, m) if m >= WALKED_WORDS else (None, 1.0)
        if walks is None:
            exact += mine
            continue
        out.walks[m] = walks
        found = defaultdict(list)
        for t in range(out.walks[m]):
            for i, each in zip(mine, buckets(rows, t).tolist(), strict=True):
                for b in each:
                    found[b].append(i)
        out.by_bucket[m] = dict(found)
        for i in mine:
            cuts = [m * k // (allowed(m) + 1) for k in range(allowed(m) + 1)]
            hashes, _ = sequence_hashes(out.words[i], np.array([0, m]), PIECE_WORDS)
            for c in cuts:
                pieces[int(hashes[c])].add((m, c))
    out.pieces = {h: sorted(p) for h, p in pieces.items()}
    if out.pieces:
        out.known[(np.array(list(out.pieces), np.uint64) & U((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
    out.runs = _runs(out.words, exact)
    return out


def _runs(words: list[np.ndarray], exact: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of a run the hashes of the runs of these items, each once an item, and the items that have them."""
    made = defaultdict(list)
    for i in exact:
        q, _ = shared_runs(len(words[i]))
        hashes = np.unique(sequence_hashes(words[i], np.array([0, len(words[i])]), q)[0])
        made[q].append((hashes, np.full(len(hashes), i)))
    out = {}
    for q, each in made.items():
        hashes, owners = (np.concatenate(x) for x in zip(*each, strict=True))
        order = np.argsort(hashes, kind="stable")
        out[q] = hashes[order], owners[order]
    return out


def _walks(rows: np.ndarray, m: int) -> tuple[int | None, float]:
    """(twice the walks that bring edited copies of these items to the target recall, the share that all of them meet); (None, 1) if that is more than MOST_WALKS."""
    draw = np.random.default_rng(m)
    of = draw.integers(0, len(rows), TRIALS)
    edited = []
    for i in of:
        words = list(rows[i])
        for _ in range(allowed(m)):
            at, kind = int(draw.integers(0, len(words))), int(draw.integers(0, 3))
            words[at : at + (kind != 1)] = [] if kind == 0 else [U(draw.integers(1, 1 << 62))]
        edited.append((words + [_PAD] * m)[:m])
    edited = np.array(edited, np.uint64)
    met = np.zeros(TRIALS, bool)
    for t in range(MOST_WALKS // 2):
        met |= (buckets(edited, t) == buckets(rows[of], t)).any(1)
        if met.mean() >= TARGET_RECALL:
            for more in range(t + 1, 2 * (t + 1)):
                met |= (buckets(edited, more) == buckets(rows[of], more)).any(1)
            return 2 * (t + 1), float(met.mean())
    return None, 1.0


def look(texts: list[bytes], items: Items) -> list[dict[int, tuple[int, int]]]:
    """For each text the items found: by item its least distance and the word where it ends."""
    found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    words, offsets = word_hashes(texts, lower=True)
    hashes, at = sequence_hashes(words, offsets, PIECE_WORDS)
    hit = np.flatnonzero(items.known[(hashes & U((1 << _FILTER_BITS) - 1)).astype(np.int64)])
    starts = defaultdict(set)
    text_of = np.searchsorted(offsets, at[hit], "right") - 1
    for h, p, i in zip(hashes[hit].tolist(), at[hit].tolist(), text_of.tolist(), strict=True):
        for m, c in items.pieces.get(h, ()):
            e = allowed(m)
            lo, hi = int(offsets[i]) - e, int(offsets[i + 1]) - m + e
            starts[m].update((i, s) for s in range(max(lo, p - c - e), min(hi, p - c + e) + 1))
    padded = np.concatenate([words, [_PAD]])
    for m, places in starts.items():
        every = np.array(sorted(places), np.int64)
        for begin in range(0, len(every), 20_000):
            _embedded(every[begin : begin + 20_000], m, words, padded, offsets, items, found)
    for q in items.runs:
        _counted(q, words, offsets, items, found)
    return found


def _counted(q: int, words: np.ndarray, offsets: np.ndarray, items: Items, found: list[dict]) -> None:
    """Adds the items whose runs have q words, exactly."""
    known, owners = items.runs[q]
    hashes, at = sequence_hashes(words, offsets, q)
    first = np.searchsorted(known, hashes)
    n = np.searchsorted(known, hashes, "right") - first
    hit = np.flatnonzero(n)
    if not len(hit):
        return
    at, first, n = at[hit], first[hit], n[hit]
    who = np.searchsorted(offsets, at, "right") - 1
    part = ((np.cumsum(n) - n) // MOST_PAIRS)[np.searchsorted(who, who)]
    for mine in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
        many = n[mine]
        slot = np.repeat(first[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        order = np.argsort(owners[slot], kind="stable")
        _verified(q, owners[slot][order], np.repeat(at[mine], many)[order], np.repeat(who[mine], many)[order], words, offsets, items, found)


def _verified(q: int, owner: np.ndarray, at: np.ndarray, who: np.ndarray, words: np.ndarray, offsets: np.ndarray, items: Items, found: list[dict]) -> None:
    """Looks for each item around its runs, sorted by item and place, where enough of them are near each other."""
    ones, back = np.unique(owner, return_inverse=True)
    sizes = [len(items.words[k]) for k in ones]
    need = np.array([shared_runs(m)[1] for m in sizes])[back]
    span = np.array([m + allowed(m) for m in sizes])[back]
    last = np.arange(len(owner)) + need - 1
    inside = last < len(owner)
    last = np.minimum(last, len(owner) - 1)
    near = np.flatnonzero(inside & (owner[last] == owner) & (who[last] == who) & (at[last] + q - at <= span))
    if not len(near):
        return
    owner, who, begin, stop = owner[near], who[near], at[last[near]] + q - span[near], at[near] + span[near]
    new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(who) != 0) | (begin[1:] > stop[:-1])) + 1
    begin = np.maximum(begin, offsets[who])[np.concatenate([[0], new])]
    tail = np.concatenate([new, [len(near)]]) - 1
    stop = np.minimum(stop, offsets[who + 1])[tail]
    for item, i, a, b in zip(owner[tail].tolist(), who[tail].tolist(), begin.tolist(), stop.tolist(), strict=True):
        if found[i].get(item, (1,))[0] == 0:
            continue
        d, end = distance(items.words[item], words[a:b])
        if d <= allowed(len(items.words[item])) and (item not in found[i] or d < found[i][item][0]):
            found[i][item] = (d, a + end - int(offsets[i]))


def _embedded(places: np.ndarray, m: int, words: np.ndarray, padded: np.ndarray, offsets: np.ndarray, items: Items, found: list[dict]) -> None:
    who, s = places[:, 0], places[:, 1]
    lo, hi = offsets[who], offsets[who + 1]
    spot = s[:, None] + np.arange(m)
    spot = np.where((spot >= lo[:, None]) & (spot < hi[:, None]), spot, len(words))
    rows, e = padded[spot], allowed(m)
    met = defaultdict(set)
    known = np.sort(np.array(list(items.by_bucket[m]), np.uint64))
    for t in range(items.walks[m]):
        every = buckets(rows, t)
        there = known[np.minimum(np.searchsorted(known, every), len(known) - 1)] == every
        for k, c in zip(*np.nonzero(there), strict=True):
            for item in items.by_bucket[m][int(every[k, c])]:
                met[int(who[k]), item].add(int(s[k]))
    for (i, item), near in met.items():
        near = sorted(near)
        groups = np.split(near, np.flatnonzero(np.diff(near) > m) + 1)
        for g in groups:
            a, b = max(int(offsets[i]), int(g[0]) - e), min(int(offsets[i + 1]), int(g[-1]) + m + e)
            d, end = distance(items.words[item], words[a:b])
            if d <= e and (item not in found[i] or d < found[i][item][0]):
                found[i][item] = (d, a + end - int(offsets[i]))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", found: str = FOUND) -> DataFrame:
    """docs with the column `found` added: array of (item string, distance int, stop int: the word behind the passage), sorted by item.

    Null texts and items have no words.  Items without words are not looked
    for; equal items are each found.  Texts and items of any length are
    looked at whole; of passages that tie, the first counts; repeated rows
    are each judged.  An empty benchmark finds nothing, and an empty table
    gives an empty result.  A column of that name is replaced, others kept.

    Each block of items is one reading of docs, and its items are let go
    before the next, so what tasks hold is bounded by a block.
    """
    docs = docs.drop(found)
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))

    def block(k: int):
        mine = items.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        return docs.sparkSession.sparkContext.broadcast(fit([r["i"] for r in mine], [r["t"] for r in mine]))

    if blocks == 1:
        return docs.withColumn(found, _finder(block(0))(F.col(text)))
    docs, hits = fixed(docs), None
    texts = tagged(docs.select(F.col(text).alias("text")))
    for k in range(blocks):
        sent = block(k)
        one = keep(texts.select("row_tag", _finder(sent)("text").alias("hits")).where(F.size("hits") > 0))
        sent.destroy()
        hits = one if hits is None else hits.unionByName(one)
    every = hits.groupBy("row_tag").agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    tag = unused(docs, "tag")
    joined = docs.withColumn(tag, row_tag(docs.sparkSession)).join(every.withColumnsRenamed({"row_tag": tag, "hits": found}), tag, "left").drop(tag)
    return joined.withColumn(found, F.coalesce(found, F.array().cast(dict(every.dtypes)["hits"])))


def _finder(sent):
    @F.pandas_udf("array<struct<item:string,distance:int,stop:int>>")
    @lean
    def scan(series: pd.Series) -> pd.Series:
        out = []
        for _, texts in batches([series.to_frame("text")], most=1 << 20):
            for hits in look(texts, sent.value):
                out.append([{"item": sent.value.ids[k], "distance": d, "stop": stop} for k, (d, stop) in sorted(hits.items())])
        return pd.Series(out, dtype=object)

    return scan


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance, stop_word: one row for each item that a document holds."""
    kind = dict(benchmark.dtypes)[item_id]
    hits = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), benchmark, "_t", item_id, item_text)
    return hits.select("doc_id", F.explode(FOUND).alias("_h")).select("doc_id", F.col("_h.item").cast(kind).alias("item_id"), F.col("_h.distance").alias("distance"), F.col("_h.stop").alias("stop_word"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold an item; columns stay as they are."""
    found = unused(docs, FOUND)
    return find(docs, benchmark, text, item_id, item_text, found).where(F.size(found) == 0).drop(found)
